"""Single events: filtered, newest first, page by page."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade import schema
from palisade.functions.instants import EPOCH, floor_to, millis
from palisade.operators.filters import check_range, matching

# Up to here a page is one top-k; beyond, the place of the page is counted first.
DEEP_OFFSET = 10_000
_STEPS_MS = [3_600_000, 60_000, 1_000, 1]


def page_bounds(limit: int | None, offset: int | None) -> tuple[int, int]:
    """Effective limit and offset: 20 and 0 when absent, the limit at most 100."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be >= 1")
    if offset is not None and offset < 0:
        raise ValueError("offset must be >= 0")
    limit = schema.SAMPLES_DEFAULT_LIMIT if limit is None else limit
    return min(limit, schema.SAMPLES_MAX_LIMIT), 0 if offset is None else offset


def selection(events, from_=None, to=None, config_id=None, category=None, action=None) -> DataFrame:
    check_range(from_, to, required=False)
    return matching(events, from_, to, config_id, category, action)


def total(events: DataFrame, **filters) -> DataFrame:
    return selection(events, **filters).agg(F.count(F.lit(1)).alias("total"))


def page(
    events: DataFrame,
    limit: int | None = None,
    offset: int | None = None,
    deep_offset: int = DEEP_OFFSET,
    **filters,
) -> DataFrame:
    """One page of stored rows; events of the same instant in order of id."""
    limit, offset = page_bounds(limit, offset)
    chosen = selection(events, **filters)
    if offset > deep_offset:
        chosen, offset = _around_page(chosen, limit, offset, deep_offset)
    return chosen.orderBy(F.desc("timestamp"), "event_id").offset(offset).limit(limit)


def _around_page(chosen: DataFrame, limit: int, offset: int, deep_offset: int) -> tuple[DataFrame, int]:
    """Narrow the events to the time slices the page lies in, and lower the offset to match.

    A deep page would otherwise sort all rows before it. Counts per slice tell
    where the page starts; only one row per narrowing reaches the driver.
    """
    newer = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    for step in _STEPS_MS:
        placed = (
            chosen.groupBy(floor_to(millis(F.col("timestamp")), step).alias("slice"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("slice", "n", F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("before"))
            .where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
            .agg(F.min("slice").alias("low"), F.max("slice").alias("high"), F.min("before").alias("before"))
            .first()
        )
        if placed["low"] is None:
            return chosen.limit(0), 0
        chosen = matching(
            chosen,
            EPOCH + timedelta(milliseconds=placed["low"]),
            EPOCH + timedelta(milliseconds=placed["high"] + step),
        )
        offset -= placed["before"]
        if offset <= deep_offset:
            break
    return chosen, offset


def items(rows: DataFrame) -> DataFrame:
    """The fields of a sample, with the rule's severity and category nested."""
    return rows.select(
        "event_id",
        "timestamp",
        "config_id",
        "client_ip",
        "path",
        F.struct(
            F.col("rule_severity").alias("severity"), F.col("rule_category").alias("category")
        ).alias("rule"),
        "action",
        "attack_type",
        "threat_score",
        "received_at",
    )
