"""Summary aggregates over the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade import schema
from palisade.functions.scoring import one_decimal
from palisade.operators.filters import check_range, matching


def _count() -> Column:
    return F.count(F.lit(1)).alias("count")


def _average(total: Column, count: Column) -> Column:
    return one_decimal(total / count).alias("avg_threat_score")


def selection(events: DataFrame, from_, to, config_id: int | None = None) -> DataFrame:
    check_range(from_, to)
    return matching(events, from_, to, config_id)


def total(events: DataFrame, from_, to, config_id: int | None = None) -> DataFrame:
    return selection(events, from_, to, config_id).agg(F.count(F.lit(1)).alias("total_events"))


def by_category(events: DataFrame, from_, to, config_id: int | None = None) -> DataFrame:
    return (
        selection(events, from_, to, config_id)
        .groupBy("rule_category")
        .agg(_count(), one_decimal(F.avg("threat_score")).alias("avg_threat_score"))
    )


def by_action(events: DataFrame, from_, to, config_id: int | None = None) -> DataFrame:
    return selection(events, from_, to, config_id).groupBy("action").agg(_count())


def top_attackers(
    events: DataFrame, from_, to, config_id: int | None = None, top: int = schema.SUMMARY_TOP
) -> DataFrame:
    """Addresses with the most events; equal counts in order of address."""
    return (
        selection(events, from_, to, config_id)
        .groupBy("client_ip")
        .agg(_count(), one_decimal(F.avg("threat_score")).alias("avg_threat_score"))
        .orderBy(F.desc("count"), "client_ip")
        .limit(top)
    )


def top_paths(
    events: DataFrame, from_, to, config_id: int | None = None, top: int = schema.SUMMARY_TOP
) -> DataFrame:
    """Paths with the most events; equal counts in order of path."""
    return (
        selection(events, from_, to, config_id)
        .groupBy("path")
        .agg(_count())
        .orderBy(F.desc("count"), "path")
        .limit(top)
    )


def count_by_category(events: DataFrame, category: str, from_, to, config_id: int | None = None) -> DataFrame:
    return matching(events, from_, to, config_id, category).agg(_count())


def sections(
    events: DataFrame, from_, to, config_id: int | None = None, top: int = schema.SUMMARY_TOP
) -> DataFrame:
    """The whole summary in long form: ``section, key, count, avg_threat_score``.

    One scan: each event counts under a key of every section, and what is
    shuffled are partial sums per section and key. The top lists are cut where the
    sums are, before they are brought together; the other sections are small.
    """
    def entry(section: str, key: Column, score: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), key.alias("key"), score.cast("bigint").alias("score"))

    nothing, score = F.lit(None), F.col("threat_score")
    entries = F.array(
        entry("total", F.lit("all"), nothing),
        entry("category", F.col("rule_category"), score),
        entry("action", F.col("action"), nothing),
        entry("attacker", F.col("client_ip"), score),
        entry("path", F.col("path"), nothing),
    )
    summed = (
        selection(events, from_, to, config_id).select(F.explode(entries).alias("entry"))
        .groupBy("entry.section", "entry.key").agg(_count(), F.sum("entry.score").alias("score"))
    )
    # Keys that all stay are first in a list of their own.
    listed = F.col("section").isin("attacker", "path")
    order = Window.partitionBy("section", F.when(~listed, F.col("key"))).orderBy(F.desc("count"), "key")
    first = summed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(top, 1))
    return first.where(~listed | (F.col("place") <= top)).select(
        "section", "key", "count", _average(F.col("score"), F.col("count"))
    )
