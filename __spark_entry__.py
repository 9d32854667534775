
from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import ORACLE  # noqa: E402
from palisade import schema  # noqa: E402
from palisade.functions.instants import millis  # noqa: E402
from palisade.functions.scoring import attack_type, sensitive_path, threat_score  # noqa: E402
from palisade.operators import (  # noqa: E402
    aggregates,
    alerts,
    offenders,
    quality,
    samples,
    timeseries,
    validation,
)
from palisade.plans import ingest, reports  # noqa: E402
from palisade.session import configure, shared_folder  # noqa: E402
from palisade.sources import driver_events, event_table, requests, rules_table  # noqa: E402
from palisade.streaming import live_alerts, live_counts  # noqa: E402

START = datetime.fromtimestamp(driver_events.BASE_MS / 1000, timezone.utc)
END = START + timedelta(hours=24)
NOW = START + timedelta(hours=12)

_tables: dict[tuple[str, str, str], str] = {}


def _kept(spark: SparkSession, sf_dir: str, table: str, write: Callable[[str], None]) -> str | None:
    """Path of a table derived from the given ones, written once per application.

    It lies in the folder the session names for checkpoints; None where the
    session names none, and the caller then computes the rows in each query.
    """
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _tables:
        folder = shared_folder(spark)
        if folder is None:
            return None
        path = f"{folder}/palisade-{uuid.uuid4().hex}/{table}"
        write(path)
        _tables[key] = path
    return _tables[key]


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table, as a backfill of the mapped events leaves it."""

    def write(path: str) -> None:
        rows = ingest.enrich_backfill(_flat(spark, sf_dir), in_order=True, scratch=f"{path}-points")
        event_table.append(rows, path, rebalance=True)

    path = _kept(spark, sf_dir, "events", write)
    if path is None:
        return ingest.enrich_backfill(_flat(spark, sf_dir), in_order=True)
    return event_table.read(spark, path)


def _landed(spark: SparkSession, sf_dir: str, table: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Raw input as it would lie in a landing folder."""
    path = _kept(spark, sf_dir, table, lambda path: make().write.parquet(path))
    return make() if path is None else spark.read.parquet(path)


def landed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(spark, sf_dir, "requests", lambda: driver_events.requests(_raw(spark, sf_dir)))


def landed_faulty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(
        spark, sf_dir, "faulty_events", lambda: driver_events.with_faults(_raw(spark, sf_dir))
    )


def landed_faulty_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(
        spark, sf_dir, "faulty_requests",
        lambda: driver_events.requests(landed_faulty_events(spark, sf_dir)).unionByName(
            driver_events.odd_requests(_raw(spark, sf_dir))
        ),
    )


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_events.flat_events(spark, sf_dir)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_events.raw_events(spark, sf_dir)


def _in_millis(df: DataFrame) -> DataFrame:
    """Timestamps as epoch milliseconds, for comparison across engines."""
    return df.select(*[
        millis(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name)
        for f in df.schema.fields
    ])


def _last_tenant(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One configuration's events as a late batch, all others as what is stored."""
    return flat.where("config_id = 5203"), flat.where("config_id <> 5203")


# --- ingest ----------------------------------------------------------------

def ingest_parse(spark, sf_dir):
    parsed = requests.parse_requests(landed_requests(spark, sf_dir))
    events = parsed.select("request_id", F.posexplode("events").alias("idx", "event"))
    return _in_millis(event_table.flatten(events, keep=["request_id", "idx"]))


def _judged(spark, sf_dir):
    return validation.judge_requests(requests.parse_requests(landed_faulty_requests(spark, sf_dir)))


def request_verdicts(spark, sf_dir):
    return _judged(spark, sf_dir).select(
        "request_id",
        F.size("events").cast("bigint").alias("events"),
        F.size("errors").cast("bigint").alias("errors"),
        (F.size("errors") == 0).alias("accepted"),
    )


def validation_errors(spark, sf_dir):
    return validation.request_errors(_judged(spark, sf_dir))


def accept_requests(spark, sf_dir):
    accepted = validation.accepted_events(_judged(spark, sf_dir))
    return _in_millis(event_table.flatten(accepted, keep=["request_id", "idx"]))


def quarantine_requests(spark, sf_dir):
    accepted = validation.accepted_events(_judged(spark, sf_dir), mode="quarantine")
    return accepted.select("request_id", "idx", F.col("event.eventId").alias("event_id"))


def validate_events(spark, sf_dir):
    return landed_faulty_events(spark, sf_dir).select(
        "batch_id", "source_id", F.explode(validation.violations()).alias("error")
    ).select("batch_id", "source_id", "error.field", "error.message")


def accept_batches(spark, sf_dir):
    kept = validation.accept_rows(landed_faulty_events(spark, sf_dir))
    return kept.select("batch_id", "source_id")


def accept_quarantine(spark, sf_dir):
    kept = validation.accept_rows(landed_faulty_events(spark, sf_dir), "quarantine")
    return kept.select("batch_id", "source_id")


def batch_limits(spark, sf_dir):
    return validation.batch_sizes(_raw(spark, sf_dir), max_batch_size=40)


def flatten_event(spark, sf_dir):
    return _in_millis(event_table.flatten(_raw(spark, sf_dir), keep=["batch_id", "received_at"]))


# --- enrichment ------------------------------------------------------------

def attack_types(spark, sf_dir):
    return _flat(spark, sf_dir).select(
        "event_id", "rule_category", attack_type(F.col("rule_category")).alias("attack_type")
    )


def threat_scores(spark, sf_dir):
    score = lambda repeat: threat_score(
        F.col("rule_severity"), F.col("action"), F.col("path"), F.lit(repeat)
    )
    return _flat(spark, sf_dir).select(
        "event_id",
        sensitive_path(F.col("path")).alias("sensitive"),
        score(False).alias("score"),
        score(True).alias("repeat_score"),
    )


def repeat_offender_history(spark, sf_dir):
    flat = _flat(spark, sf_dir)
    counted = offenders.with_prior_count(flat, offenders.prior_counts_replayed(flat))
    return counted.select(
        "event_id", "client_ip", "batch_id", "prior_count",
        offenders.is_repeat_offender(F.col("prior_count")).alias("repeat_offender"),
    )


def repeat_offender_disordered(spark, sf_dir):
    """Each configuration sends its day in hourly batches, one configuration after the other."""
    hour = F.floor((millis(F.col("timestamp")) - driver_events.BASE_MS) / 3_600_000)
    flat = _flat(spark, sf_dir).withColumn("batch_id", (F.col("config_id") - 5201) * 24 + hour)
    counted = offenders.with_prior_count(flat, offenders.prior_counts_replayed(flat))
    return counted.select("event_id", "batch_id", "prior_count")


def repeat_offender_batch(spark, sf_dir):
    batch, history = _last_tenant(_flat(spark, sf_dir))
    counted = offenders.with_prior_count(batch, offenders.prior_counts(batch, history))
    return counted.select(
        "event_id", "prior_count",
        offenders.is_repeat_offender(F.col("prior_count")).alias("repeat_offender"),
    )


def history_by_ip(spark, sf_dir):
    flat = _flat(spark, sf_dir)
    noon = (NOW - START) // timedelta(milliseconds=driver_events.BATCH_MS)
    batch = flat.where(F.col("batch_id") == noon)
    return offenders.history_for_batch(flat.where(F.col("batch_id") < noon), batch)


def repeat_offender_scattered(spark, sf_dir):
    """A batch of one configuration's events of three hours of the day, so that it reaches ranges far apart."""
    flat = _flat(spark, sf_dir)
    hour = F.floor((millis(F.col("timestamp")) - driver_events.BASE_MS) / 3_600_000)
    late = (F.col("config_id") == 5202) & hour.isin(2, 11, 20)
    batch, history = flat.where(late), flat.where(~late)
    counted = offenders.with_prior_count(batch, offenders.prior_counts(batch, history))
    return counted.select("event_id", "prior_count")


def enrich(spark, sf_dir):
    rows = ingest.enrich_backfill(_flat(spark, sf_dir), in_order=True, keep=["batch_id"])
    return _in_millis(rows)


def enrich_batch(spark, sf_dir):
    batch, history = _last_tenant(_flat(spark, sf_dir))
    rows = ingest.enrich_batch(batch, history, F.timestamp_millis(F.lit(driver_events.BASE_MS + 90_000_000)))
    return _in_millis(rows.select("event_id", "received_at", "attack_type", "threat_score"))


def _flagged(spark, sf_dir):
    flagged = ingest.flag_backfill(_flat(spark, sf_dir), in_order=True)
    return ingest.enrich(flagged, F.col("received_at"), keep=["batch_id", "repeat_offender"])


def ingest_metrics(spark, sf_dir):
    return quality.ingest_metrics(_flagged(spark, sf_dir))


def ingest_metric_totals(spark, sf_dir):
    return quality.metric_totals(quality.ingest_metrics(_flagged(spark, sf_dir)))


# --- what streams keep ------------------------------------------------------

_MICRO_BATCHES = 6


def _in_micro_batches(spark: SparkSession, sf_dir: str, table: str, store: Callable, pack: Callable) -> str | None:
    """Path of a table to which the day's events were added in micro-batches, in no order of time.

    All but the last micro-batch are packed, and one of them is then repeated.
    """

    def write(path: str) -> None:
        events = stored_events(spark, sf_dir)
        turn = F.pmod(F.xxhash64("event_id"), F.lit(_MICRO_BATCHES))
        for n in range(_MICRO_BATCHES):
            store(events.where(turn == n).drop("event_date"), path, "live", n)
        pack(spark, path)
        store(events.where(turn == 2).drop("event_date"), path, "live", 2)

    return _kept(spark, sf_dir, table, write)


def packed_events(spark, sf_dir):
    path = _in_micro_batches(spark, sf_dir, "packed_events", event_table.replace_batch, event_table.pack)
    events = stored_events(spark, sf_dir) if path is None else event_table.read(spark, path)
    return _in_millis(events.select("event_id", "timestamp", "received_at", "attack_type", "threat_score"))


def live_buckets(spark, sf_dir):
    path = _in_micro_batches(spark, sf_dir, "live_buckets", live_counts.store_counts, live_counts.roll_up)
    if path is None:
        return _in_millis(live_counts.bucket_counts(stored_events(spark, sf_dir)))
    return _in_millis(live_counts.live_counts(spark, path).select("bucket_from", "count"))


def alerts_live(spark, sf_dir):
    path = _in_micro_batches(spark, sf_dir, "alert_cells", live_alerts.store_cells, live_alerts.roll_up)
    rules = stored_rules(spark, sf_dir)
    if path is None:
        return _in_millis(alerts.firing(stored_events(spark, sf_dir), rules, NOW))
    return _in_millis(live_alerts.firing(spark, path, rules, NOW + timedelta(seconds=17)))


def rules_appended(spark, sf_dir):
    """Two writers define half of the rules each; ids go on from the first to the second."""
    definitions = _definitions(spark, sf_dir)

    def write(path: str) -> None:
        for half in (0, 1):
            rules_table.define_into(definitions.where(F.col("seq") % 2 == half), path)

    path = _kept(spark, sf_dir, "rules_appended", write)
    if path is not None:
        return rules_table.read(spark, path)
    first = rules_table.define(definitions.where(F.col("seq") % 2 == 0))
    return first.unionByName(rules_table.define(definitions.where(F.col("seq") % 2 == 1), existing=first))


# --- statistics ------------------------------------------------------------

def summary_total(spark, sf_dir):
    return aggregates.total(stored_events(spark, sf_dir), START, END)


def summary_total_config(spark, sf_dir):
    return aggregates.total(stored_events(spark, sf_dir), START, END, config_id=5201)


def summary_by_category(spark, sf_dir):
    return aggregates.by_category(stored_events(spark, sf_dir), START, END)


def summary_by_category_config(spark, sf_dir):
    return aggregates.by_category(
        stored_events(spark, sf_dir), START + timedelta(hours=6), START + timedelta(hours=18), 5202
    )


def summary_by_action(spark, sf_dir):
    return aggregates.by_action(stored_events(spark, sf_dir), START, END)


def top_attackers(spark, sf_dir):
    return aggregates.top_attackers(stored_events(spark, sf_dir), START, END)


def top_paths(spark, sf_dir):
    return aggregates.top_paths(stored_events(spark, sf_dir), START, END, top=5)


def summary_document(spark, sf_dir):
    return aggregates.sections(stored_events(spark, sf_dir), START, END, config_id=5201, top=5)


def summary_json(spark, sf_dir):
    return reports.as_json(reports.summary(stored_events(spark, sf_dir), START, END, config_id=5201, top=5))


def count_by_category(spark, sf_dir):
    return aggregates.count_by_category(
        stored_events(spark, sf_dir), "INJECTION", NOW - timedelta(hours=1), NOW, 5201
    )


def timeseries_1m(spark, sf_dir):
    return _in_millis(timeseries.counts(stored_events(spark, sf_dir), START, END, "1m"))


def timeseries_5m(spark, sf_dir):
    ten = START + timedelta(hours=10)
    return _in_millis(timeseries.counts(
        stored_events(spark, sf_dir), ten + timedelta(seconds=90), ten + timedelta(minutes=17), "5m"
    ))


def timeseries_1h(spark, sf_dir):
    return _in_millis(timeseries.counts(stored_events(spark, sf_dir), START, END, "1h"))


def timeseries_1m_config(spark, sf_dir):
    return _in_millis(timeseries.counts(
        stored_events(spark, sf_dir), START - timedelta(minutes=30), END + timedelta(minutes=30), "1m", 5203
    ))


def timeseries_json(spark, sf_dir):
    return reports.as_json(reports.time_series(stored_events(spark, sf_dir), START, END, "1h", config_id=5203))


# --- samples ---------------------------------------------------------------

def _sample(rows: DataFrame) -> DataFrame:
    return _in_millis(samples.items(rows).withColumn("rule", F.to_json("rule")))


def samples_page(spark, sf_dir):
    return _sample(samples.page(stored_events(spark, sf_dir)))


def samples_filtered(spark, sf_dir):
    return _sample(samples.page(
        stored_events(spark, sf_dir), limit=500, offset=7, config_id=5202, from_=START + timedelta(hours=3),
        to=START + timedelta(hours=21), category="XSS", action="ALERT",
    ))


def samples_page_past_end(spark, sf_dir):
    return _sample(samples.page(stored_events(spark, sf_dir), offset=10_000_000, category="BOT"))


def samples_deep_page(spark, sf_dir):
    return _sample(samples.page(stored_events(spark, sf_dir), limit=50, offset=7_777, deep_offset=500))


def samples_total(spark, sf_dir):
    return samples.total(stored_events(spark, sf_dir), category="BOT")


def samples_nested(spark, sf_dir):
    nested = event_table.nest(samples.page(stored_events(spark, sf_dir), limit=100, action="DENY"))
    flat = event_table.flatten(nested, keep=["attack_type", "threat_score", "received_at"])
    return _in_millis(flat)


def samples_json(spark, sf_dir):
    return reports.as_json(reports.sample_page(stored_events(spark, sf_dir), limit=30, offset=4, category="BOT"))


# --- alerts ----------------------------------------------------------------

def _rules(spark):
    return spark.createDataFrame(
        [
            ("rule-1", 5201, "INJECTION", 5, 60),
            ("rule-2", None, "BOT", 100_000, 60),
            ("rule-3", None, "DOS", 3, 30),
        ],
        schema.ALERT_RULE,
    )


def _definitions(spark, sf_dir):
    """Every event as a rule definition; some of them do not hold up."""
    return _flat(spark, sf_dir).select(
        F.substring("event_id", 5, 20).cast("bigint").alias("seq"),
        (F.col("rule_id").cast("bigint") - 700).alias("k"),
        "config_id",
        "rule_category",
    ).select(
        "seq",
        F.when(F.col("k") % 4 != 0, F.col("config_id")).alias("config_id"),
        F.when(F.col("k") % 10 == 9, "UNKNOWN").otherwise(F.col("rule_category")).alias("category"),
        (F.col("k") % 7).cast("int").alias("threshold"),
        F.when(F.col("k") == 5, 2_000_000_000).otherwise(F.col("seq") % 61).cast("int").alias("window_minutes"),
    )


def _defined_rules(spark, sf_dir):
    return rules_table.define(_definitions(spark, sf_dir))


def stored_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defined rules, kept in a table beside the event table."""
    rules = _defined_rules(spark, sf_dir)
    path = _kept(spark, sf_dir, "rules", lambda path: rules_table.append(rules, path))
    return rules if path is None else rules_table.read(spark, path)


def rules_define(spark, sf_dir):
    return _defined_rules(spark, sf_dir)


def rule_errors(spark, sf_dir):
    return rules_table.definition_errors(_definitions(spark, sf_dir))


def alerts_firing(spark, sf_dir):
    return _in_millis(alerts.firing(stored_events(spark, sf_dir), _rules(spark), NOW))


def alerts_evaluated(spark, sf_dir):
    return _in_millis(alerts.evaluate(stored_events(spark, sf_dir), stored_rules(spark, sf_dir), NOW))


def alerts_json(spark, sf_dir):
    rules = stored_rules(spark, sf_dir).where("config_id is not null")
    return reports.as_json(reports.firing_alerts(stored_events(spark, sf_dir), rules, NOW))


# --- quality ---------------------------------------------------------------

def attack_waves(spark, sf_dir):
    return quality.attack_waves(_flat(spark, sf_dir), min_events=3)


def reconcile(spark, sf_dir):
    return quality.reconcile(stored_events(spark, sf_dir), START, END, "1h", config_id=5201)


_QUERIES = {
    "ingest_parse": ingest_parse,
    "request_verdicts": request_verdicts,
    "validation_errors": validation_errors,
    "accept_requests": accept_requests,
    "quarantine_requests": quarantine_requests,
    "validate_events": validate_events,
    "accept_batches": accept_batches,
    "accept_quarantine": accept_quarantine,
    "batch_limits": batch_limits,
    "flatten_event": flatten_event,
    "attack_type": attack_types,
    "threat_score": threat_scores,
    "repeat_offender_history": repeat_offender_history,
    "repeat_offender_disordered": repeat_offender_disordered,
    "repeat_offender_batch": repeat_offender_batch,
    "repeat_offender_scattered": repeat_offender_scattered,
    "history_by_ip": history_by_ip,
    "enrich": enrich,
    "enrich_batch": enrich_batch,
    "ingest_metrics": ingest_metrics,
    "ingest_metric_totals": ingest_metric_totals,
    "summary_total": summary_total,
    "summary_total_config": summary_total_config,
    "summary_by_category": summary_by_category,
    "summary_by_category_config": summary_by_category_config,
    "summary_by_action": summary_by_action,
    "top_attackers": top_attackers,
    "top_paths": top_paths,
    "summary_document": summary_document,
    "summary_json": summary_json,
    "count_by_category": count_by_category,
    "timeseries_1m": timeseries_1m,
    "timeseries_5m": timeseries_5m,
    "timeseries_1h": timeseries_1h,
    "timeseries_1m_config": timeseries_1m_config,
    "timeseries_json": timeseries_json,
    "samples_page": samples_page,
    "samples_filtered": samples_filtered,
    "samples_page_past_end": samples_page_past_end,
    "samples_deep_page": samples_deep_page,
    "samples_total": samples_total,
    "samples_nested": samples_nested,
    "samples_json": samples_json,
    "rules_define": rules_define,
    "rule_errors": rule_errors,
    "alerts_firing": alerts_firing,
    "alerts_evaluated": alerts_evaluated,
    "alerts_json": alerts_json,
    "packed_events": packed_events,
    "live_buckets": live_buckets,
    "alerts_live": alerts_live,
    "rules_appended": rules_appended,
    "attack_waves": attack_waves,
    "reconcile": reconcile,
}


def _configured(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(configure(spark), sf_dir)


def entry(spark: SparkSession) -> DataFrame:
    """Summary by category over the ingested events of the smallest data set."""
    return summary_by_category(configure(spark), "/root/testdata/sf0.001")


def _corpus() -> tuple[dict[str, Callable], dict[str, str]]:
    """Queries and SQL of the corpus operators, where that subpackage is installed."""
    try:
        import corpus_pipeline  # noqa: F401
        from palisade.llm import queries as corpus
    except ImportError:
        return {}, {}
    return corpus.QUERIES, corpus.ORACLE


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _configured(query) for name, query in (_QUERIES | _corpus()[0]).items()}


def oracle_sql() -> dict[str, str]:
    return ORACLE | _corpus()[1]
