"""The event table: nested events to flat rows, partitioned Parquet, and back."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade import schema
from palisade.functions.instants import to_millis_precision
from palisade.functions.text import or_empty
from palisade.sources import parts
from palisade.sources.parts import PARTITIONS, stamped

# The stored columns that are known before enrichment.
FLAT_COLUMNS = [
    name for name in schema.EVENT_TABLE.fieldNames()
    if name not in ("received_at", "attack_type", "threat_score")
]

SORT_COLUMNS = ["config_id", "timestamp", "client_ip", "event_id"]


def flatten(rows: DataFrame, keep: list[str] = (), event: str = "event") -> DataFrame:
    """Nested events to the flat columns known before enrichment.

    Absent text becomes empty, absent sizes 0, and instants keep milliseconds.
    """
    e = F.col(event)
    rule, geo = e["rule"], e["geoLocation"]
    return rows.select(
        or_empty(e["eventId"]).alias("event_id"),
        to_millis_precision(e["timestamp"]).alias("timestamp"),
        e["configId"].alias("config_id"),
        or_empty(e["policyId"]).alias("policy_id"),
        or_empty(e["clientIp"]).alias("client_ip"),
        or_empty(e["hostname"]).alias("hostname"),
        or_empty(e["path"]).alias("path"),
        or_empty(e["method"]).alias("method"),
        e["statusCode"].alias("status_code"),
        or_empty(e["userAgent"]).alias("user_agent"),
        or_empty(rule["id"]).alias("rule_id"),
        or_empty(rule["name"]).alias("rule_name"),
        or_empty(rule["message"]).alias("rule_message"),
        rule["severity"].alias("rule_severity"),
        rule["category"].alias("rule_category"),
        e["action"].alias("action"),
        or_empty(geo["country"]).alias("geo_country"),
        or_empty(geo["city"]).alias("geo_city"),
        F.coalesce(e["requestSize"].try_cast("bigint"), F.lit(0)).alias("request_size"),
        F.coalesce(e["responseSize"].try_cast("bigint"), F.lit(0)).alias("response_size"),
        *keep,
    )


def nested_event(geo: Column) -> Column:
    """The nested event made of the flat columns."""
    c = F.col
    rule = F.struct(
        c("rule_id").alias("id"),
        c("rule_name").alias("name"),
        c("rule_message").alias("message"),
        c("rule_severity").alias("severity"),
        c("rule_category").alias("category"),
    )
    return F.struct(
        c("event_id").alias("eventId"),
        c("timestamp"),
        c("config_id").alias("configId"),
        c("policy_id").alias("policyId"),
        c("client_ip").alias("clientIp"),
        c("hostname"),
        c("path"),
        c("method"),
        c("status_code").alias("statusCode"),
        c("user_agent").alias("userAgent"),
        rule.alias("rule"),
        c("action"),
        geo.alias("geoLocation"),
        c("request_size").alias("requestSize"),
        c("response_size").alias("responseSize"),
    )


def nest(rows: DataFrame) -> DataFrame:
    """Stored rows back to ``event``, ``attack_type``, ``threat_score``, ``received_at``."""
    geo = F.struct(F.col("geo_country").alias("country"), F.col("geo_city").alias("city"))
    return rows.select(nested_event(geo).alias("event"), "attack_type", "threat_score", "received_at")


def append(rows: DataFrame, path: str, rebalance: bool = False, run: str = "backfill") -> None:
    """Append enriched rows; the same event sent twice is stored twice.

    The table is partitioned by day, run and batch, and files are sorted so
    that row groups can be skipped by configuration and time. Appended rows are
    batch 0 of ``run``. ``rebalance`` is for backfills: it gathers each day into
    files of even size, splitting large days.
    """
    _layout(stamped(rows, run, 0), rebalance).write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def replace_batch(rows: DataFrame, path: str, run: str, ingest_batch: int) -> None:
    """Write the rows of one micro-batch, replacing what an earlier try of the same run left behind."""
    parts.replace(_layout(rows, False), path, run, ingest_batch)


def pack(spark: SparkSession, path: str, target_bytes: int = parts.TARGET_BYTES, now: datetime | None = None) -> int:
    """Rewrite the finished micro-batches of each day as files of about ``target_bytes``; returns how many days."""
    return parts.pack(spark, path, table_schema(with_batches=True), SORT_COLUMNS, target_bytes=target_bytes, now=now)


def vacuum(spark: SparkSession, path: str, now: datetime | None = None, grace: timedelta = parts.GRACE) -> int:
    """Delete what packing has replaced, once no reader can still hold it; returns how many folders."""
    return parts.vacuum(spark, path, now, grace)


def _layout(rows: DataFrame, rebalance: bool) -> DataFrame:
    dated = rows.withColumn("event_date", F.to_date("timestamp"))
    if rebalance:
        dated = dated.hint("rebalance", "event_date")
    return dated.sortWithinPartitions("event_date", *SORT_COLUMNS)


def table_schema(with_batches: bool = False) -> T.StructType:
    fields = schema.EVENT_TABLE.fields + [T.StructField("event_date", T.DateType())]
    if with_batches:
        fields = fields + [T.StructField("ingest_run", T.StringType()), T.StructField("ingest_batch", T.LongType())]
    return T.StructType(fields)


def read(spark: SparkSession, path: str, with_batches: bool = False, days: parts.Days | None = None) -> DataFrame:
    """The event table with its day column; ``with_batches`` also gives the run and batch that stored a row.

    Reading lists all folders of the table. Given ranges of days (first, or None
    for all before, and last), only those days are listed, and a table that is not
    there yet reads as empty.
    """
    rows = parts.read(spark, path, table_schema(with_batches=True), days)
    return rows if with_batches else rows.drop(*PARTITIONS[1:])


def empty(spark: SparkSession, with_batches: bool = False) -> DataFrame:
    return spark.createDataFrame([], table_schema(with_batches))
