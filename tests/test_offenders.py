import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import at, plan_of, stored
from palisade.functions.instants import instant_lit
from palisade.operators import offenders
from palisade.plans import ingest

WINDOW = timedelta(minutes=10)
LOGIN = {"rule_severity": "CRITICAL", "action": "DENY", "path": "/members/login", "rule_category": "INJECTION"}
NOW = at("14:32:10")


def counts(spark, batch, history):
    b, h = stored(spark, *batch), stored(spark, *history) if history else stored(spark, {"timestamp": NOW}).limit(0)
    rows = offenders.with_prior_count(b, offenders.prior_counts(b, h)).collect()
    return {r["event_id"]: r["prior_count"] for r in rows}


def prior(spark, batch_times, history_times, **history):
    batch = [{"event_id": str(i), "timestamp": t} for i, t in enumerate(batch_times)]
    found = counts(spark, batch, [{"timestamp": t, **history} for t in history_times])
    return [found[str(i)] for i in range(len(batch_times))]


def enriched(spark, history_size):
    batch = stored(spark, {"timestamp": NOW, **LOGIN})
    history = stored(spark, *[{"timestamp": NOW - timedelta(seconds=70)}] * max(history_size, 1))
    history = history.limit(history_size)
    return ingest.enrich_batch(batch, history, instant_lit(at("14:32:11"))).first()


def test_no_history(spark):
    row = enriched(spark, 0)
    assert (row["attack_type"], row["threat_score"]) == ("SQL/Command Injection", 75)
    assert row["received_at"].timestamp() == at("14:32:11").timestamp()


def test_bonus_starts_above_five(spark):
    assert enriched(spark, 5)["threat_score"] == 75
    assert enriched(spark, 6)["threat_score"] == 90


def test_window_edges(spark):
    ms = timedelta(milliseconds=1)
    assert prior(spark, [NOW], [NOW - WINDOW]) == [1]
    assert prior(spark, [NOW], [NOW - WINDOW - ms]) == [0]
    assert prior(spark, [NOW], [NOW]) == [0]
    assert prior(spark, [NOW], [NOW - ms]) == [1]
    assert prior(spark, [NOW], [NOW + ms]) == [0]


def test_same_batch_does_not_count(spark):
    times = [NOW + timedelta(seconds=i) for i in range(8)]
    assert prior(spark, times, []) == [0] * 8
    assert prior(spark, times, [NOW - timedelta(seconds=1)]) == [1] * 8


def test_other_addresses_do_not_count_and_other_configurations_do(spark):
    assert prior(spark, [NOW], [NOW - timedelta(minutes=1)], client_ip="10.0.0.1") == [0]
    assert prior(spark, [NOW], [NOW - timedelta(minutes=1)], config_id=1) == [1]


def test_empty_batch(spark):
    nothing = stored(spark, {"timestamp": NOW}).limit(0)
    assert ingest.enrich_batch(nothing, stored(spark, {"timestamp": NOW}), instant_lit(NOW)).count() == 0


def _random_rows(seed, size, batch_of):
    rng = random.Random(seed)
    start = at("00:00:00")
    rows = []
    for i in range(size):
        # A third of all events comes from one address, many at the same instant.
        ip = "hot" if rng.random() < 0.34 else f"ip-{rng.randrange(4)}"
        ts = start + timedelta(milliseconds=rng.choice([rng.randrange(3_600_000), 1000 * rng.randrange(900), 600_000]))
        rows.append({"event_id": str(i), "client_ip": ip, "timestamp": ts, "batch": batch_of(rng, ts - start)})
    return rows


def _brute(rows):
    by_ip = {}
    for r in rows:
        by_ip.setdefault(r["client_ip"], []).append(r)
    return {
        r["event_id"]: sum(
            1 for h in by_ip[r["client_ip"]]
            if h["batch"] < r["batch"] and r["timestamp"] - WINDOW <= h["timestamp"] < r["timestamp"]
        )
        for r in rows
    }


def _replayed(spark, rows, **kwargs):
    ids = spark.createDataFrame([(r["event_id"], r["batch"]) for r in rows], "event_id string, batch_id bigint")
    events = stored(spark, *[{k: v for k, v in r.items() if k != "batch"} for r in rows]).join(ids, "event_id")
    found = offenders.with_prior_count(events, offenders.prior_counts_replayed(events, **kwargs)).collect()
    assert len(found) == len(rows)
    return {r["event_id"]: r["prior_count"] for r in found}


@pytest.mark.parametrize("name,batch_of", [
    ("in order", lambda rng, t: int(t.total_seconds()) // 300),
    ("late ones", lambda rng, t: int(t.total_seconds()) // 300 + (rng.randrange(5) if rng.random() < 0.1 else 0)),
    ("any order", lambda rng, t: rng.randrange(40)),
    ("backwards", lambda rng, t: 12 - int(t.total_seconds()) // 300),
    ("sparse ids", lambda rng, t: rng.choice([0, 1, 7, 2**20, 2**40 + 3])),
    ("one batch", lambda rng, t: 5),
])
def test_replay_equals_brute_force(spark, name, batch_of):
    rows = _random_rows(name, 700, batch_of)
    expected = _brute(rows)
    assert _replayed(spark, rows) == expected
    if name in ("in order", "one batch"):
        assert _replayed(spark, rows, in_order=True) == expected


def test_replay_equals_batch_after_batch(spark):
    rows = _random_rows(3, 200, lambda rng, t: rng.randrange(4))
    replayed = _replayed(spark, rows)
    plain = lambda chosen: [{k: v for k, v in r.items() if k != "batch"} for r in chosen]
    for batch in range(4):
        mine = [r for r in rows if r["batch"] == batch]
        found = counts(spark, plain(mine), plain([r for r in rows if r["batch"] < batch]))
        assert found == {r["event_id"]: replayed[r["event_id"]] for r in mine}


def test_times_before_1970(spark):
    old = at("1969-12-31T23:59:59")
    assert prior(spark, [old], [old - timedelta(minutes=9), old - timedelta(minutes=11)]) == [1]


def test_backfill_through_scratch_table(spark, tmp_path):
    rows = _random_rows(9, 400, lambda rng, t: int(t.total_seconds()) // 60)
    ids = spark.createDataFrame([(r["event_id"], r["batch"]) for r in rows], "event_id string, batch_id bigint")
    events = stored(spark, *[{k: v for k, v in r.items() if k != "batch"} for r in rows]).join(ids, "event_id")
    flags = lambda df: {r["event_id"]: r["repeat_offender"] for r in df.collect()}
    expected = {k: v > 5 for k, v in _brute(rows).items()}
    assert any(expected.values())
    assert flags(ingest.flag_backfill(events)) == expected
    assert flags(ingest.flag_backfill(events, scratch=str(tmp_path / "points"))) == expected


def test_hot_address_is_spread_over_slices(spark):
    """One address with all of 400 000 events: linear work, and counts as by hand."""
    start = int(at("00:00:00").timestamp() * 1000)
    events = spark.range(400_000).select(
        F.lit("hot").alias("client_ip"),
        F.timestamp_millis(F.lit(start) + F.col("id") * 5).alias("timestamp"),
        F.floor(F.col("id") / 1000).alias("batch_id"),
    )
    found = offenders.prior_counts_replayed(events).agg(
        F.count("*"), F.sum("prior_count"), F.max("prior_count")
    ).first()
    each = lambda i: min(i, 120_000) - i % 1000
    expected = [each(i) for i in range(400_000)]
    assert tuple(found) == (sum(e > 0 for e in expected), sum(expected), max(expected))


def test_replay_out_of_order_reads_events_once_and_shuffles_twice(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = _random_rows(11, 300, lambda rng, t: rng.randrange(13))
    ids = spark.createDataFrame([(r["event_id"], r["batch"]) for r in rows], "event_id string, batch_id bigint")
    stored(spark, *[{k: v for k, v in r.items() if k != "batch"} for r in rows]).join(ids, "event_id").write.parquet(path)
    physical = plan_of(offenders.prior_counts_replayed(spark.read.parquet(path)))
    assert physical.count("FileScan parquet") == 1
    # To cells, and to slices; numbering, sums and answers stay there.
    assert physical.count("Exchange hashpartitioning") == 2


def test_replay_of_many_batches_in_one_slice(spark):
    """Batches backwards in time, each of one event: only the events of lower batches before it count, so none does."""
    rows = [
        {"event_id": str(i), "client_ip": "hot", "timestamp": NOW + timedelta(milliseconds=i), "batch": 300 - i}
        for i in range(300)
    ]
    assert set(_replayed(spark, rows).values()) == {0}
    for r in rows:
        r["batch"] = 300 - r["batch"]
    assert _replayed(spark, rows) == {str(i): i for i in range(300)}
