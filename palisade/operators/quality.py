"""Ingest metrics, burst profiles and checks between queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import schema
from palisade.functions.instants import millis
from palisade.operators import aggregates, samples, timeseries
from palisade.operators.trailing import trailing


def ingest_metrics(flagged: DataFrame, batch_id: str = "batch_id") -> DataFrame:
    """Per batch: events, repeat offenders, and the sum and peak of the scores.

    The number of rows is the number of batches, so batch-size statistics are
    plain aggregates of ``events``. A batch without events leaves no row.
    """
    return flagged.groupBy(F.col(batch_id).alias("batch_id")).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(F.col("repeat_offender").cast("bigint")).alias("repeat_offenders"),
        F.sum(F.col("threat_score").cast("bigint")).alias("score_sum"),
        F.max("threat_score").alias("score_max"),
    )


def metric_totals(metrics: DataFrame) -> DataFrame:
    """All batches together: the counters, and count, sum and peak of each distribution."""
    return metrics.agg(
        F.sum("events").alias("events_total"),
        F.sum("repeat_offenders").alias("repeat_offenders_total"),
        F.count(F.lit(1)).alias("batch_count"),
        F.sum("events").alias("batch_size_sum"),
        F.max("events").alias("batch_size_max"),
        F.sum("events").alias("score_count"),
        F.sum("score_sum").alias("score_sum"),
        F.max("score_max").alias("score_max"),
    )


def attack_waves(
    events: DataFrame, min_events: int, within_ms: int = schema.ATTACK_WAVE_MS
) -> DataFrame:
    """Address and path pairs with at least ``min_events`` within ``within_ms``, ends included."""
    keys = ["client_ip", "path"]
    counted = (
        events.select(*keys, millis(F.col("timestamp")).alias("ts_ms"))
        .groupBy(*keys, "ts_ms")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        trailing(counted, keys, -within_ms, 0)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("events"),
            F.min("ts_ms").alias("first_ms"),
            F.max("ts_ms").alias("last_ms"),
            F.max("in_frame").alias("peak"),
        )
        .where(F.col("peak") >= min_events)
        .withColumn("span_ms", F.col("last_ms") - F.col("first_ms"))
    )


def reconcile(events: DataFrame, from_, to, interval: str, config_id: int | None = None) -> DataFrame:
    """``check, lhs, rhs, ok``: the queries must agree with each other.

    Category, action and bucket counts must each add up to the total, and the
    number of samples of a category must be its count in the summary.
    """
    span = (events, from_, to)
    total = aggregates.total(*span, config_id).select(F.col("total_events").alias("n"))
    category = aggregates.by_category(*span, config_id)
    sampled = samples.selection(events, from_, to, config_id).groupBy("rule_category").agg(
        F.count(F.lit(1)).alias("n")
    )

    def side(df: DataFrame, name: str, lhs: str | None = None, rhs: str | None = None) -> DataFrame:
        value = lambda column: F.lit(0).cast("bigint") if column is None else F.col(column)
        return df.select(F.lit(name).alias("check"), value(lhs).alias("lhs"), value(rhs).alias("rhs"))

    parts = [
        side(category, "by_category", lhs="count"),
        side(aggregates.by_action(*span, config_id), "by_action", lhs="count"),
        side(timeseries.counts(*span, interval, config_id), "buckets", lhs="count"),
    ]
    parts += [side(total, name, rhs="n") for name in ("by_category", "by_action", "buckets")]
    label = F.concat(F.lit("samples_"), F.col("rule_category"))
    parts += [
        sampled.select(label.alias("check"), F.col("n").alias("lhs"), F.lit(0).cast("bigint").alias("rhs")),
        category.select(label.alias("check"), F.lit(0).cast("bigint").alias("lhs"), F.col("count").alias("rhs")),
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("check")
        .agg(F.sum("lhs").alias("lhs"), F.sum("rhs").alias("rhs"))
        .withColumn("ok", F.col("lhs") == F.col("rhs"))
    )
