"""Alerts evaluated after every micro-batch, from counts per minute instead of events.

Each micro-batch adds its events up by category, configuration and minute, and
stores those cells as a part of its own. Rules are then evaluated at the last
whole minute: an event of minute m has age M - m there, so a window of whole
minutes is a sum of whole cells, and the result is that of ``alerts.firing`` over all
events at that minute. Late events change the windows they belong to. Cells of
finished micro-batches are added up from time to time, and only the days that the
longest window reaches are read.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from palisade.functions.instants import EPOCH, as_datetime, earlier
from palisade.operators import alerts
from palisade.sources import parts

PACK_EVERY = 50
_MINUTE = timedelta(minutes=1)
_CELLS = T.StructType([
    T.StructField("category", T.StringType()), T.StructField("config_id", T.LongType()), T.StructField("minute", T.LongType()),
    T.StructField("n", T.LongType()), *parts.PARTITION_FIELDS,
])
_KEYS = ["event_date", "category", "config_id", "minute"]


def minute_cells(events: DataFrame) -> DataFrame:
    """``category, config_id, minute, n`` of a batch of events, with the day of the minute; minutes count from the epoch."""
    minute = F.floor(F.unix_micros("timestamp") / F.lit(60_000_000))
    return events.groupBy(
        F.to_date("timestamp").alias("event_date"), F.col("rule_category").alias("category"), "config_id", minute.alias("minute")
    ).agg(F.count(F.lit(1)).alias("n"))


def store_cells(events: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Store the cells of one micro-batch, replacing those of an earlier try."""
    parts.replace(minute_cells(events), path, run, batch_id)


def roll_up(spark: SparkSession, path: str, **options) -> int:
    """Add up the cells of finished micro-batches; returns how many days changed."""
    combine = lambda rows: parts.stamped(rows.groupBy(*_KEYS).agg(F.sum("n").alias("n")), "", 0)
    return parts.pack(spark, path, _CELLS, _KEYS[1:], combine=combine, **options)


def whole_minute(now) -> datetime:
    """The minute that ``now`` lies in, from its start."""
    now = as_datetime(now)
    return EPOCH + (now - EPOCH) // _MINUTE * _MINUTE


def evaluate(spark: SparkSession, path: str, rules: DataFrame, now) -> DataFrame:
    """Every rule with its count over the window that ends at the whole minute of ``now``."""
    end = whole_minute(now)
    longest = alerts.longest_window(rules)
    begin = earlier(end, longest)
    last = (end - EPOCH) // _MINUTE
    days = [(begin and begin.date(), end.date())]
    cells = parts.read(spark, path, _CELLS, days).select("category", "config_id", (F.lit(last) - F.col("minute")).alias("age"), "n")
    recent = cells.where((F.col("age") >= 1) & (F.col("age") <= longest)).groupBy("category", "config_id", "age").agg(F.sum("n").alias("n"))
    return alerts.evaluate_cells(alerts.with_all_configurations(recent), rules, end)


def firing(spark: SparkSession, path: str, rules: DataFrame, now) -> DataFrame:
    """The rules whose count is strictly above their threshold."""
    return evaluate(spark, path, rules, now).where(F.col("actual_count") > F.col("threshold"))


def start_live_alerts(
    events: DataFrame,
    cells: str,
    fired: str,
    checkpoint: str,
    rules: Callable[[], DataFrame],
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    pack_every: int = PACK_EVERY,
    **trigger,
) -> StreamingQuery:
    """Evaluate the rules after every micro-batch of a stream of events.

    ``rules`` is asked each time, so that new rules count from the next
    micro-batch on. What fires is stored in ``fired`` under the run and the number of the
    micro-batch; a repeated one replaces its own.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        store_cells(batch, cells, run, batch_id)
        found = firing(spark, cells, rules(), clock())
        parts.replace(found.withColumn("event_date", F.to_date("window_to")), fired, run, batch_id)
        if (batch_id + 1) % pack_every == 0:
            roll_up(spark, cells)
            parts.vacuum(spark, cells)

    return (
        events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
