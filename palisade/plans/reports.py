"""Results in the shape of one document, for callers that want JSON.

Only results of bounded size take this shape: a summary (categories, actions
and two top lists) and a page of samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import schema
from palisade.functions.instants import instant_lit
from palisade.operators import aggregates, alerts, samples, timeseries


def _echo(config_id: int | None) -> Column:
    return F.lit(config_id).cast("bigint")


def summary(
    events: DataFrame, from_, to, config_id: int | None = None, top: int = schema.SUMMARY_TOP
) -> DataFrame:
    """One row: total, two maps and two ordered lists, with the arguments echoed."""
    parts = aggregates.sections(events, from_, to, config_id, top)
    chosen = lambda section, value: F.collect_list(F.when(F.col("section") == section, value))
    count, average = F.col("count"), F.col("avg_threat_score").alias("avgThreatScore")
    attackers = F.struct(-count, F.col("key"), F.struct(F.col("key").alias("clientIp"), count, average).alias("item"))
    paths = F.struct(-count, F.col("key"), F.struct(F.col("key").alias("path"), count).alias("item"))
    ordered = lambda section, entry: F.transform(
        F.array_sort(chosen(section, entry)), lambda e: e["item"]
    )
    return parts.agg(
        F.coalesce(F.sum(F.when(F.col("section") == "total", count)), F.lit(0)).alias("totalEvents"),
        F.map_from_entries(
            F.array_sort(chosen("category", F.struct(F.col("key"), F.struct(count, average).alias("value"))))
        ).alias("byCategory"),
        F.map_from_entries(F.array_sort(chosen("action", F.struct(F.col("key"), count)))).alias("byAction"),
        ordered("attacker", attackers).alias("topAttackers"),
        ordered("path", paths).alias("topTargetedPaths"),
    ).select(
        _echo(config_id).alias("configId"),
        F.struct(instant_lit(from_).alias("from"), instant_lit(to).alias("to")).alias("timeRange"),
        "totalEvents",
        "byCategory",
        "byAction",
        "topAttackers",
        "topTargetedPaths",
    )


def sample_page(events: DataFrame, limit: int | None = None, offset: int | None = None, **filters) -> DataFrame:
    """One row: the total, the effective limit and offset, and the items, newest first."""
    effective_limit, effective_offset = samples.page_bounds(limit, offset)
    total = samples.total(events, **filters).select("total", F.lit(None).alias("item"))
    rows = samples.items(samples.page(events, limit, offset, **filters))
    item = F.struct(
        F.col("event_id").alias("eventId"),
        "timestamp",
        F.col("config_id").alias("configId"),
        F.col("client_ip").alias("clientIp"),
        "path",
        "rule",
        "action",
        F.col("attack_type").alias("attackType"),
        F.col("threat_score").alias("threatScore"),
        F.col("received_at").alias("receivedAt"),
    )
    order = F.struct((-F.unix_micros("timestamp")).alias("age"), F.col("event_id").alias("id"), item.alias("item"))
    found = rows.select(F.lit(None).cast("bigint").alias("total"), order.alias("item"))
    return (
        total.withColumn("item", F.col("item").cast(found.schema["item"].dataType))
        .unionByName(found)
        .agg(
            F.max("total").alias("total"),
            F.lit(effective_limit).alias("limit"),
            F.lit(effective_offset).alias("offset"),
            F.transform(F.array_sort(F.collect_list("item")), lambda e: e["item"]).alias("items"),
        )
    )


def time_series(events: DataFrame, from_, to, interval: str, config_id: int | None = None) -> DataFrame:
    """One row per bucket, with the arguments echoed."""
    return timeseries.counts(events, from_, to, interval, config_id).select(
        _echo(config_id).alias("configId"),
        F.lit(interval).alias("interval"),
        F.col("bucket_from").alias("from"),
        F.col("bucket_to").alias("to"),
        "count",
    )


def firing_alerts(events: DataFrame, rules: DataFrame, now) -> DataFrame:
    """One row per firing rule, with the time of evaluation."""
    return alerts.firing(events, rules, now).select(
        instant_lit(now).alias("evaluatedAt"),
        F.col("rule_id").alias("ruleId"),
        F.col("config_id").alias("configId"),
        "category",
        "threshold",
        F.col("window_minutes").alias("windowMinutes"),
        F.col("actual_count").alias("actualCount"),
        F.col("window_from").alias("windowFrom"),
        F.col("window_to").alias("windowTo"),
    )


def as_json(documents: DataFrame) -> DataFrame:
    """Each row as a JSON document in ``value``; nulls are left out."""
    return documents.select(F.to_json(F.struct("*")).alias("value"))
