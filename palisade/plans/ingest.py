"""Ingest jobs: one batch against the stored history, and a whole backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators import offenders
from palisade.operators.enrichment import enrich


def flag_batch(batch: DataFrame, history: DataFrame, found: offenders.Reach | None = None) -> DataFrame:
    """Add ``repeat_offender`` to one flat batch, seen against the events stored before it."""
    return offenders.with_repeat_offender(batch, offenders.prior_counts(batch, history, found))


def enrich_batch(
    batch: DataFrame, history: DataFrame, received_at: Column, keep: list[str] = (), scratch: str | None = None
) -> DataFrame:
    """One flat batch to rows of the event table.

    The batch is read for what it reaches, for its points and for its rows.
    ``scratch``, a folder that all executors share, takes it first, so that what
    made it runs once.
    """
    if scratch is not None:
        batch.write.mode("overwrite").parquet(scratch)
        batch = batch.sparkSession.read.schema(batch.schema).parquet(scratch)
    return enrich(flag_batch(batch, history), received_at, keep)


def flag_backfill(events: DataFrame, in_order: bool = False, scratch: str | None = None) -> DataFrame:
    """Add ``repeat_offender`` to many batches, as if ingested one by one in order of ``batch_id``.

    ``in_order`` promises that no batch holds events older than an earlier
    batch's, so that batches need not be told apart within a slice. ``scratch``, a
    folder that all executors share, takes the narrow list of flagged points
    first; its size is then known when the wide events are joined to it, and a
    short list spares them a shuffle.
    """
    counts = offenders.prior_counts_replayed(events, in_order=in_order)
    if scratch is not None:
        offenders.repeat_points(counts).write.mode("overwrite").parquet(scratch)
        return offenders.with_points(events, events.sparkSession.read.parquet(scratch))
    return offenders.with_repeat_offender(events, counts)


def enrich_backfill(
    events: DataFrame,
    in_order: bool = False,
    received_at: Column | None = None,
    keep: list[str] = (),
    scratch: str | None = None,
) -> DataFrame:
    """Many flat batches to rows of the event table."""
    received_at = F.col("received_at") if received_at is None else received_at
    return enrich(flag_backfill(events, in_order, scratch), received_at, keep)
