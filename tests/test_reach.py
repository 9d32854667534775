"""What a batch reaches: short ranges however far apart, and the same counts as over all history."""

import random
from datetime import timedelta

import pytest

from conftest import at, plan_of, stored
from palisade.operators import offenders
from palisade.sources import event_table

NOW = at("14:32:10")
WINDOW = timedelta(minutes=10)


def test_far_events_reach_short_ranges(spark):
    old = NOW - timedelta(days=3 * 365)
    found = offenders.reach(stored(spark, {"timestamp": NOW}, {"timestamp": NOW + timedelta(minutes=3)}, {"timestamp": old}))
    assert found.ranges == [(old - WINDOW, old), (NOW - WINDOW, NOW + timedelta(minutes=3))]
    assert found.days() == [(old.date(), old.date()), (NOW.date(), NOW.date())]


def test_an_empty_batch_reaches_nothing(spark):
    empty = stored(spark, {"timestamp": NOW}).limit(0)
    assert offenders.reach(empty).ranges == []
    assert offenders.prior_counts(empty, stored(spark, {"timestamp": NOW})).count() == 0


def test_the_first_and_last_instants(spark):
    first, last = at("0001-01-01T00:00:00Z"), at("9999-12-31T23:59:59Z")
    found = offenders.reach(stored(spark, {"timestamp": first}, {"timestamp": last}))
    assert found.ranges == [(None, first), (last - WINDOW, last)]
    assert found.days()[1] == (last.date(), last.date())


@pytest.mark.parametrize("most", [1, 2, 3, 10])
def test_ranges_are_joined_where_they_are_nearest(most):
    spans = [(0, 10), (5, 12), (12, 13), (20, 30), (31, 40), (90, 99)]
    merged = offenders._merged(spans, most)
    expected = {
        1: [(0, 99)], 2: [(0, 40), (90, 99)], 3: [(0, 13), (20, 40), (90, 99)], 10: [(0, 13), (20, 30), (31, 40), (90, 99)],
    }
    assert merged == expected[most]
    assert offenders._merged([], most) == []


@pytest.mark.parametrize("units, ranges", [(500, 48), (3, 2), (1, 1)])
def test_counts_do_not_depend_on_how_ranges_are_told_apart(spark, monkeypatch, units, ranges):
    monkeypatch.setattr(offenders, "MOST_UNITS", units)
    monkeypatch.setattr(offenders, "MOST_RANGES", ranges)
    rng = random.Random(3)
    when = lambda: NOW - timedelta(days=rng.choice([0, 0, 1, 40, 800]), seconds=rng.randrange(3000), milliseconds=rng.randrange(3))
    make = lambda kind, n: [
        {"event_id": f"{kind}{i}", "timestamp": when(), "client_ip": f"ip-{rng.randrange(3)}"} for i in range(n)
    ]
    batch, history = make("b", 40), make("h", 300)
    counted = offenders.with_prior_count(
        stored(spark, *batch), offenders.prior_counts(stored(spark, *batch), stored(spark, *history))
    )
    expected = {
        b["event_id"]: sum(
            h["client_ip"] == b["client_ip"] and b["timestamp"] - WINDOW <= h["timestamp"] < b["timestamp"] for h in history
        ) for b in batch
    }
    assert {r["event_id"]: r["prior_count"] for r in counted.collect()} == expected
    assert len(set(expected.values())) > 2


def test_two_days_of_three_years_are_scanned(spark, tmp_path):
    path = str(tmp_path / "events")
    days = [NOW - timedelta(days=d) for d in (0, 1, 300, 700, 1095)]
    event_table.append(stored(spark, *[{"event_id": str(d), "timestamp": d - timedelta(minutes=1)} for d in days]), path)
    batch = stored(spark, {"event_id": "new", "timestamp": NOW}, {"event_id": "old", "timestamp": days[-1]})
    found = offenders.reach(batch)
    history = event_table.read(spark, path, days=found.days())
    assert {f.split("event_date=")[1][:10] for f in history.inputFiles()} == {NOW.date().isoformat(), days[-1].date().isoformat()}
    rows = offenders.history_in_reach(event_table.read(spark, path), batch, found)
    assert sorted(r["event_id"] for r in rows.collect()) == sorted([str(NOW), str(days[-1])])
    # The same from the whole table: partitions and row groups are pruned by the ranges.
    plan = plan_of(rows)
    assert "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "Or(" in plan.split("PushedFilters: [")[1].split("]\n")[0]
    counts = offenders.prior_counts(batch, history, found)
    assert {r["prior_count"] for r in counts.collect()} == {1} and counts.count() == 2


def test_a_batch_is_made_once(spark, tmp_path):
    from palisade.functions.instants import instant_lit
    from palisade.plans import ingest

    made = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            made.add(batch.num_rows)
            yield batch

    plain = stored(spark, *[{"event_id": str(i), "timestamp": NOW} for i in range(5)])
    batch = plain.mapInArrow(count, plain.schema)
    history = stored(spark, *[{"timestamp": NOW - timedelta(seconds=5)}] * 6)
    rows = ingest.enrich_batch(batch, history, instant_lit(NOW), scratch=str(tmp_path / "batch"))
    assert [r["threat_score"] for r in rows.collect()] == [25] * 5 and made.value == 5
