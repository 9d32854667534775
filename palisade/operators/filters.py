"""The filters shared by all queries, and the checks on query arguments."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import schema
from palisade.functions.instants import as_datetime, earlier, instant_lit


def check_range(from_, to, required: bool = True) -> None:
    if required and from_ is None:
        raise ValueError("'from' is required")
    if required and to is None:
        raise ValueError("'to' is required")
    if from_ is not None and to is not None and as_datetime(to) <= as_datetime(from_):
        raise ValueError("'to' must be after 'from'")


def check_member(name: str, value: str | None, allowed: list[str]) -> None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")


def matching(
    events: DataFrame,
    from_=None,
    to=None,
    config_id: int | None = None,
    category: str | None = None,
    action: str | None = None,
) -> DataFrame:
    """Events with ``from_ <= timestamp < to`` and the given values; None means any.

    The bounds are compared with the stored column, so they reach the Parquet
    scan. A table partitioned by day is pruned by the same bounds.
    """
    check_member("category", category, schema.CATEGORIES)
    check_member("action", action, schema.ACTIONS)
    by_day = "event_date" in events.columns
    conditions = []
    if from_ is not None:
        conditions.append(F.col("timestamp") >= instant_lit(from_))
        if by_day:
            conditions.append(F.col("event_date") >= F.lit(as_datetime(from_).date().isoformat()).cast("date"))
    if to is not None:
        conditions.append(F.col("timestamp") < instant_lit(to))
        if by_day:
            last = earlier(as_datetime(to), timedelta(microseconds=1)) or as_datetime(to)
            conditions.append(F.col("event_date") <= F.lit(last.date().isoformat()).cast("date"))
    if config_id is not None:
        conditions.append(F.col("config_id") == F.lit(config_id).cast("bigint"))
    if category is not None:
        conditions.append(F.col("rule_category") == category)
    if action is not None:
        conditions.append(F.col("action") == action)
    for condition in conditions:
        events = events.where(condition)
    return events
