"""Streaming ingest: requests in, enriched rows, refused requests and metrics out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade import schema
from palisade.functions.instants import instant_lit
from palisade.operators import offenders, quality, validation
from palisade.operators.enrichment import enrich
from palisade.sources import event_table
from palisade.sources.requests import parse_requests


@dataclass(frozen=True)
class Sinks:
    """Folders the stream writes to, all on storage the whole cluster shares."""

    events: str
    refused: str
    metrics: str


def ingest_batch(
    requests: DataFrame,
    batch_id: int,
    sinks: Sinks,
    now: datetime,
    mode: str = "reject_batch",
    max_batch_size: int = schema.MAX_BATCH_SIZE,
    run: str = "manual",
) -> None:
    """Validate, enrich and store the requests of one micro-batch of a run.

    A request sees what other runs and earlier micro-batches stored, and the
    requests before it in its own micro-batch, so that scores do not depend on
    how requests are cut into micro-batches. A repeated batch replaces its own
    rows in every sink, and no other run's, so nothing is stored twice or lost.
    """
    spark = requests.sparkSession
    numbered = in_order(requests)
    judged = validation.judge_requests(parse_requests(numbered), max_batch_size=max_batch_size)
    # Only of refused requests is the text needed again.
    judged = judged.withColumn("text", F.when(F.size("errors") > 0, F.col("text")))
    judged = judged.persist(StorageLevel.MEMORY_AND_DISK)
    rows = None
    try:
        accepted = validation.accepted_events(judged.drop("text"), mode=mode)
        batch = event_table.flatten(accepted, keep=["request_id", F.col("request_id").alias("batch_id")])
        found = offenders.reach(batch)
        history = event_table.read(spark, sinks.events, with_batches=True, days=found.days()).where(
            (F.col("ingest_run") != run) | (F.col("ingest_batch") < batch_id)
        )
        counts = offenders.prior_counts_in_requests(batch, history, found)
        flagged = offenders.with_repeat_offender(batch, counts)
        rows = enrich(flagged, instant_lit(now), keep=["request_id", "repeat_offender"])
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        # The event table comes last: writing to it drops kept frames that read from it.
        _replace(quality.ingest_metrics(rows, "request_id"), sinks.metrics, run, batch_id)
        refused = judged.where(F.size("errors") > 0).select("request_id", F.col("text").alias("body"), "errors")
        _replace(refused, sinks.refused, run, batch_id)
        event_table.replace_batch(rows.drop("request_id", "repeat_offender"), sinks.events, run, batch_id)
    finally:
        if rows is not None:
            rows.unpersist()
        judged.unpersist()


def in_order(requests: DataFrame) -> DataFrame:
    """``request_id, text, body`` with ids from 1 in order of arrival.

    Requests that name their file (``arrived``, ``file``, ``block``, as
    ``stream_requests`` gives them) are ordered by it, and in a file by position.
    The files of a micro-batch are few; only they are ranked.
    """
    position = F.monotonically_increasing_id()
    origin = [c for c in ("arrived", "file", "block") if c in requests.columns]
    if not origin:
        return requests.select((position + 1).alias("request_id"), F.col("body").alias("text"), "body")
    placed = requests.select("*", position.bitwiseAND((1 << 33) - 1).alias("place"))
    files = requests.select(*origin).distinct().withColumn("rank", F.row_number().over(Window.orderBy(*origin)))
    return placed.join(files, origin).select(
        (F.col("rank") * F.lit(1 << 33) + F.col("place")).alias("request_id"), F.col("body").alias("text"), "body"
    )


def _replace(rows: DataFrame, path: str, run: str, batch_id: int) -> None:
    (
        event_table.stamped(rows, run, batch_id)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ingest_run", "ingest_batch")
        .parquet(path)
    )


def start_ingest(
    requests: DataFrame,
    sinks: Sinks,
    checkpoint: str,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    mode: str = "reject_batch",
    max_batch_size: int = schema.MAX_BATCH_SIZE,
    pack_every: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Start ingesting a stream of request bodies (column ``body``).

    After every ``pack_every`` micro-batches the finished ones are packed; with
    None that is left to a job of its own.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The id kept in the checkpoint: the same after a restart, another for a new checkpoint.
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        ingest_batch(batch, batch_id, sinks, clock(), mode, max_batch_size, run)
        if pack_every and (batch_id + 1) % pack_every == 0:
            event_table.pack(batch.sparkSession, sinks.events)
            event_table.vacuum(batch.sparkSession, sinks.events)

    return (
        requests.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_requests(spark: SparkSession, path: str, whole_files: bool = False, max_files: int | None = None) -> DataFrame:
    """New files of a folder as request bodies, one per line or one per file."""
    reader = spark.readStream.option("wholetext", whole_files)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).select(
        F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("arrived"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
    )
