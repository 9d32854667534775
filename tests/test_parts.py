"""Packing the parts of a stream: few files, the same rows, and no one who reads or repeats is disturbed."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import at, stored
from palisade.sources import event_table, parts

NOW = at("15:00:00")


def batch(spark, number, days=1, size=4):
    rows = [
        {"event_id": f"{number}-{i}", "timestamp": at("10:00:00") + timedelta(days=i % days, seconds=number), "config_id": 5201 + i % 2}
        for i in range(size)
    ]
    return stored(spark, *rows)


def store(spark, path, numbers, days=1, run="live"):
    for n in numbers:
        event_table.replace_batch(batch(spark, n, days), path, run, n)


def ids(spark, path, **options):
    return sorted(r["event_id"] for r in event_table.read(spark, path, **options).select("event_id").collect())


def files(df):
    return len(df.inputFiles())


def test_packed_rows_are_the_same_in_few_files(spark, tmp_path):
    path = str(tmp_path / "events")
    event_table.append(batch(spark, 900, 2), path)
    store(spark, path, range(8), days=2)
    store(spark, path, range(3), run="other/run: ä+")
    before = sorted(map(tuple, event_table.read(spark, path, with_batches=True).collect()))
    assert event_table.pack(spark, path, now=NOW) == 2
    rows = event_table.read(spark, path, with_batches=True)
    assert sorted(map(tuple, rows.collect())) == before
    assert rows.where("ingest_batch = 0 and ingest_run = 'backfill'").count() == 4
    assert event_table.pack(spark, path, now=NOW) == 0
    event_table.vacuum(spark, path, NOW + timedelta(days=1))
    # Per day: a packed file, the newest batch of each run, and what was appended.
    kept = {p.name for p in (tmp_path / "events" / "event_date=2026-05-20").iterdir()}
    assert len(kept) == 3 and len(list((tmp_path / "events-packed").rglob("*.parquet"))) == 2
    assert files(event_table.read(spark, path)) < files(rows)
    assert sorted(p.name for p in (tmp_path / "events" / "event_date=2026-05-20" / "ingest_run=live").iterdir()) == ["ingest_batch=7"]
    assert sorted(map(tuple, event_table.read(spark, path, with_batches=True).collect())) == before


def test_a_repeat_of_a_packed_batch_doubles_nothing(spark, tmp_path):
    path = str(tmp_path / "events")
    store(spark, path, range(4))
    expected = ids(spark, path)
    event_table.pack(spark, path, now=NOW)
    store(spark, path, [1])
    assert ids(spark, path) == expected
    event_table.vacuum(spark, path, NOW + timedelta(days=1))
    store(spark, path, [2, 3])
    assert ids(spark, path) == expected
    # Nor after the next pack, which has a later batch to take in.
    store(spark, path, [4])
    assert event_table.pack(spark, path, now=NOW + timedelta(minutes=1)) == 1
    assert ids(spark, path) == sorted(expected + [f"4-{i}" for i in range(4)])


def test_a_reader_goes_on_while_it_is_packed(spark, tmp_path):
    path = str(tmp_path / "events")
    store(spark, path, range(3))
    reader = event_table.read(spark, path)
    reader.count()
    event_table.pack(spark, path, now=NOW)
    assert event_table.vacuum(spark, path, NOW + timedelta(hours=1)) == 0
    assert reader.count() == 12
    assert event_table.vacuum(spark, path, NOW + timedelta(days=1)) == 2


def test_generations_take_in_older_ones(spark, tmp_path):
    path = str(tmp_path / "events")
    store(spark, path, range(3))
    event_table.pack(spark, path, now=NOW)
    store(spark, path, range(3, 6))
    event_table.pack(spark, path, now=NOW + timedelta(minutes=1))
    assert ids(spark, path) == sorted(f"{n}-{i}" for n in range(6) for i in range(4))
    folder = tmp_path / "events-packed" / "event_date=2026-05-20"
    assert len(list(folder.iterdir())) == 2
    event_table.vacuum(spark, path, NOW + timedelta(days=1))
    assert len(list(folder.iterdir())) == 1
    assert ids(spark, path) == sorted(f"{n}-{i}" for n in range(6) for i in range(4))


def test_a_pack_that_died_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "events")
    store(spark, path, range(3))
    monkeypatch.setattr(parts, "_LOG", "no such type")
    with pytest.raises(Exception):
        event_table.pack(spark, path, now=NOW)
    monkeypatch.undo()
    assert ids(spark, path) == sorted(f"{n}-{i}" for n in range(3) for i in range(4))
    event_table.pack(spark, path, now=NOW)
    assert ids(spark, path) == sorted(f"{n}-{i}" for n in range(3) for i in range(4))


def test_days_are_packed_by_their_bytes(spark, tmp_path):
    path = str(tmp_path / "events")
    rng = random.Random(1)
    rows = [{"event_id": f"{rng.random()}", "timestamp": at("10:00:00"), "path": f"/{rng.random()}"} for _ in range(4000)]
    for n in range(2):
        event_table.replace_batch(stored(spark, *rows).coalesce(1), path, "live", n)
    size = sum(p.stat().st_size for p in (tmp_path / "events").rglob("ingest_batch=0/*.parquet"))
    event_table.pack(spark, path, target_bytes=size // 3, now=NOW)
    assert len(list((tmp_path / "events-packed").rglob("*.parquet"))) == 4
    assert event_table.read(spark, path).count() == 8000


def test_only_the_days_asked_for_are_listed(spark, tmp_path):
    path = str(tmp_path / "events")
    store(spark, path, range(3), days=4)
    event_table.pack(spark, path, now=NOW)
    day = at("2026-05-22T00:00:00Z").date()
    some = event_table.read(spark, path, days=[(day, day)])
    assert sorted({r["event_date"] for r in some.collect()}) == [day] and some.count() == 3
    assert all("event_date=2026-05-22" in f for f in some.inputFiles())
    assert event_table.read(spark, path, days=[]).count() == 0
    assert event_table.read(spark, path, days=[(None, day)]).count() == 9


def test_nothing_to_pack(spark, tmp_path):
    path = str(tmp_path / "events")
    assert event_table.pack(spark, path) == 0 and event_table.vacuum(spark, path) == 0
    store(spark, path, [0])
    assert event_table.pack(spark, path) == 0
    with pytest.raises(Exception):
        event_table.read(spark, str(tmp_path / "none")).count()


def test_filters_reach_both_scans(spark, tmp_path):
    path = str(tmp_path / "events")
    store(spark, path, range(3), days=2)
    event_table.pack(spark, path, now=NOW)
    found = event_table.read(spark, path).where(F.col("config_id") == 5201).select("event_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(config_id,5201)") == 2 and "user_agent" not in plan
