"""Event counts per time bucket, kept current by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from palisade import schema
from palisade.functions.instants import floor_to, millis
from palisade.sources import parts

PACK_EVERY = 50
_COUNTS = T.StructType([
    T.StructField("bucket_from", T.TimestampType()), T.StructField("count", T.LongType()), *parts.PARTITION_FIELDS,
])


def bucket_counts(events: DataFrame, interval: str = "5m") -> DataFrame:
    """``bucket_from, count`` of the non-empty buckets of a batch of events."""
    if interval not in schema.INTERVAL_SECONDS:
        raise ValueError(f"interval must be one of {', '.join(schema.INTERVAL_SECONDS)}")
    start = floor_to(millis(F.col("timestamp")), schema.INTERVAL_SECONDS[interval] * 1000)
    return events.groupBy(F.timestamp_millis(start).alias("bucket_from")).agg(F.count(F.lit(1)).alias("count"))


def store_counts(events: DataFrame, path: str, run: str, batch_id: int, interval: str = "5m") -> None:
    """Store the counts of one micro-batch, replacing those of an earlier try."""
    counted = bucket_counts(events, interval).withColumn("event_date", F.to_date("bucket_from"))
    parts.replace(counted, path, run, batch_id)


def _rolled_up(rows: DataFrame) -> DataFrame:
    summed = rows.groupBy("event_date", "bucket_from").agg(F.sum("count").alias("count"))
    return parts.stamped(summed, "", 0)


def roll_up(spark: SparkSession, path: str, **options) -> int:
    """Add up the counts of finished micro-batches, a row per bucket; returns how many days changed."""
    return parts.pack(spark, path, _COUNTS, ["bucket_from"], combine=_rolled_up, **options)


def start_live_counts(
    events: DataFrame, path: str, checkpoint: str, interval: str = "5m", pack_every: int = PACK_EVERY, **trigger
) -> StreamingQuery:
    """Count a stream of events per bucket, however late they are.

    Each micro-batch stores its own counts under its run and number, and a
    repeated one replaces them. Nothing is held in state, so nothing expires. After
    every ``pack_every`` micro-batches the finished ones are added up, day by day,
    so a reader never opens more files than that beside one or so per day.
    """
    bucket_counts(events, interval)  # a wrong interval fails here

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store_counts(batch, path, spark.sparkContext.getLocalProperty("sql.streaming.queryId"), batch_id, interval)
        if (batch_id + 1) % pack_every == 0:
            roll_up(spark, path)
            parts.vacuum(spark, path)

    return (
        events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def live_counts(spark: SparkSession, path: str, interval: str = "5m") -> DataFrame:
    """``bucket_from, bucket_to, count`` summed over what a stream has stored so far."""
    length = F.make_dt_interval(secs=F.lit(schema.INTERVAL_SECONDS[interval]))
    return parts.read(spark, path, _COUNTS).groupBy("bucket_from").agg(F.sum("count").alias("count")).select(
        "bucket_from", (F.col("bucket_from") + length).alias("bucket_to"), "count"
    )
