"""Alerts kept by a stream equal those over all events, after every micro-batch."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

from conftest import at, stored
from palisade import schema
from palisade.operators import alerts
from palisade.sources import event_table
from palisade.streaming import live_alerts, live_counts

NOW = at("15:00:37")
RULES = [
    ("rule-1", 5201, "BOT", 3, 60), ("rule-2", None, "BOT", 9, 60), ("rule-3", None, "XSS", 1, 1),
    ("rule-4", 5202, "DOS", 1, 100_000), ("rule-5", None, "XSS", 1000, 5), ("rule-6", 5201, "BOT", 3, 60),
]


def rules(spark):
    return spark.createDataFrame(RULES, schema.ALERT_RULE)


def some(spark, seed, n=60):
    rng = random.Random(seed)
    late = [timedelta(seconds=rng.choice([0, 1, 37, 59, 60, 97, rng.randrange(9000), rng.randrange(400_000)])) for _ in range(n)]
    return stored(spark, *[
        {"event_id": f"{seed}-{i}", "timestamp": NOW - late[i], "config_id": rng.choice([5201, 5202]),
         "rule_category": rng.choice(["BOT", "XSS", "DOS"])} for i in range(n)
    ])


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_cells_equal_all_events_after_every_batch(spark, tmp_path):
    path, seen = str(tmp_path / "cells"), None
    for n in range(5):
        batch = some(spark, n)
        seen = batch if seen is None else seen.unionByName(batch)
        live_alerts.store_cells(batch, path, "live", n)
        if n == 3:
            live_alerts.store_cells(batch, path, "live", n)  # a repeat
            assert live_alerts.roll_up(spark, path, now=NOW) > 0
        minute = live_alerts.whole_minute(NOW)
        assert minute == at("15:00:00")
        assert rows(live_alerts.firing(spark, path, rules(spark), NOW)) == rows(alerts.firing(seen, rules(spark), minute))
        assert rows(live_alerts.evaluate(spark, path, rules(spark), NOW)) == rows(alerts.evaluate(seen, rules(spark), minute))
    assert rows(live_alerts.firing(spark, path, rules(spark), NOW))


def test_a_stream_evaluates_after_each_micro_batch(spark, tmp_path):
    source = str(tmp_path / "events")
    names = ["cells", "fired", "checkpoint"]
    for n in range(3):
        event_table.replace_batch(some(spark, n).coalesce(1), source, "live", n)
        stream = spark.readStream.schema(event_table.table_schema(with_batches=True)).parquet(source)
        query = live_alerts.start_live_alerts(
            stream, *[str(tmp_path / name) for name in names], rules=lambda: rules(spark), clock=lambda: NOW, pack_every=2
        )
        assert query.awaitTermination(240)
        seen = event_table.read(spark, source)
        expected = alerts.firing(seen, rules(spark), at("15:00:00"))
        fired = spark.read.parquet(str(tmp_path / "fired")).where(F.col("ingest_batch") == n)
        assert rows(fired.select(expected.columns)) == rows(expected)


def test_live_counts_stay_few_files(spark, tmp_path):
    path = str(tmp_path / "counts")
    for n in range(12):
        live_counts.store_counts(some(spark, n, 30).coalesce(1), path, "live", n)
        if n % 4 == 3:
            live_counts.roll_up(spark, path, now=NOW + timedelta(seconds=n))
    found = rows(live_counts.live_counts(spark, path))
    seen = some(spark, 0, 30)
    for n in range(1, 12):
        seen = seen.unionByName(some(spark, n, 30))
    counted = live_counts.bucket_counts(seen)
    assert [(a, c) for a, _, c in found] == rows(counted)
    # A packed file a day, and the parts of the newest micro-batch.
    days = seen.select(F.to_date("timestamp")).distinct().count()
    newest = some(spark, 11, 30).select(F.to_date("timestamp")).distinct().count()
    packed = [p for p in (tmp_path / "counts-packed").rglob("*.parquet")]
    assert len(packed) <= 3 * days
    from palisade.sources import parts
    parts.vacuum(spark, path, NOW + timedelta(days=1))
    left = [p for name in ("counts", "counts-packed") for p in (tmp_path / name).rglob("*.parquet")]
    assert len(left) <= days + 4 * newest
    assert rows(live_counts.live_counts(spark, path)) == found


def test_an_empty_stream(spark, tmp_path):
    path = str(tmp_path / "cells")
    assert {r["actual_count"] for r in live_alerts.evaluate(spark, path, rules(spark), NOW).collect()} == {0}
    live_alerts.store_cells(some(spark, 0).limit(0), path, "live", 0)
    assert live_alerts.firing(spark, path, rules(spark), NOW).count() == 0
