"""Event counts per time bucket, with empty buckets filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import schema
from palisade.functions.instants import epoch_micros, floor_to, instant_lit, millis
from palisade.operators.filters import check_range, matching


def counts(events: DataFrame, from_, to, interval: str, config_id: int | None = None) -> DataFrame:
    """``bucket_from, bucket_to, count`` over ``[from_, to)``, one row per bucket.

    Buckets lie on the epoch grid. The first may begin before ``from_`` but
    counts no earlier events; the last ends at ``to``. The empty grid joins
    the events as rows of weight 0, so one pre-aggregated shuffle does both
    the counting and the filling.
    """
    check_range(from_, to)
    if interval not in schema.INTERVAL_SECONDS:
        raise ValueError(f"interval must be one of {', '.join(schema.INTERVAL_SECONDS)}")
    step = schema.INTERVAL_SECONDS[interval] * 1000
    first = epoch_micros(from_) // (step * 1000) * step
    buckets = -((first * 1000 - epoch_micros(to)) // (step * 1000))
    grid = events.sparkSession.range(buckets).select(
        (F.lit(first).cast("bigint") + F.col("id") * step).alias("bucket"), F.lit(0).alias("n")
    )
    seen = matching(events, from_, to, config_id).select(
        floor_to(millis(F.col("timestamp")), step).alias("bucket"), F.lit(1).alias("n")
    )
    return (
        seen.unionByName(grid)
        .groupBy("bucket")
        .agg(F.sum("n").alias("count"))
        .select(
            F.timestamp_millis("bucket").alias("bucket_from"),
            F.least(F.timestamp_millis(F.col("bucket") + step), instant_lit(to)).alias("bucket_to"),
            "count",
        )
        .orderBy("bucket_from")
    )
