"""Ingest requests: JSON text holding one event or an array of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade import schema

# Fixed value: an ISO-8601 instant, with up to nine digits of a second and an offset.
INSTANT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX"


def read_requests(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Request bodies as ``body``: one per line, or one per file."""
    return spark.read.text(path, wholetext=whole_files).withColumnRenamed("value", "body")


def parse_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """Replace ``body`` by ``events``, an array that is null when the body cannot be read.

    A lone object becomes an array of one. Unknown fields are ignored, and a
    value of the wrong type is null.
    """
    others = [c for c in requests.columns if c != body]
    events = F.from_json(body, T.ArrayType(schema.EVENT_JSON), {"timestampFormat": INSTANT_FORMAT})
    return requests.select(*others, events.alias("events"))
