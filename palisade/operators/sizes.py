"""Broadcast hints given only to frames whose size has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
_ROW_OVERHEAD = 48


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of a flat frame's size in memory; one aggregate job."""
    width = F.lit(_ROW_OVERHEAD).cast("bigint")
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        else:
            width = width + 16
    return df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()["bytes"]


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the frame is proven to fit; else leave the join to shuffle."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df
