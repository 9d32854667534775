import json
import os
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import at, event
from palisade.operators import offenders, timeseries, validation
from palisade.sources import event_table
from palisade.sources.requests import parse_requests
from palisade.streaming.ingest import Sinks, ingest_batch, start_ingest, stream_requests
from palisade.streaming.live_counts import live_counts, start_live_counts

NOW = at("15:00:00")


def sinks_in(folder) -> Sinks:
    return Sinks(*[str(folder / name) for name in ("events", "refused", "metrics")])


def bodies(spark, *requests):
    return spark.createDataFrame([(json.dumps(r),) for r in requests], "body string")


def wave(first, size):
    """``size`` events of one address, one a second."""
    return [
        event(eventId=f"w{first + i}", timestamp=(at("14:00:00") + timedelta(seconds=first + i)).isoformat().replace("+00:00", "Z"))
        for i in range(size)
    ]


def test_history_is_what_was_stored_before(spark, tmp_path):
    sinks = sinks_in(tmp_path)
    for batch_id in range(3):
        ingest_batch(bodies(spark, wave(4 * batch_id, 4)), batch_id, sinks, NOW)
    rows = event_table.read(spark, sinks.events, with_batches=True)
    scores = {r["ingest_batch"]: r["s"] for r in rows.groupBy("ingest_batch").agg(F.sort_array(F.collect_set("threat_score")).alias("s")).collect()}
    # Four, then eight stored events before: only the third batch is above five.
    assert scores == {0: [55], 1: [55], 2: [70]}
    assert rows.count() == 12
    metrics = spark.read.parquet(sinks.metrics).orderBy("ingest_batch").select("events", "repeat_offenders", "score_sum", "score_max")
    assert [tuple(r) for r in metrics.collect()] == [(4, 0, 220, 55), (4, 0, 220, 55), (4, 4, 280, 70)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    sinks = sinks_in(tmp_path)
    ingest_batch(bodies(spark, wave(0, 6), event(path=" ")), 0, sinks, NOW)
    for _ in range(2):
        ingest_batch(bodies(spark, wave(6, 3), event(rule=None)), 1, sinks, NOW)
    rows = event_table.read(spark, sinks.events, with_batches=True)
    assert rows.count() == 9
    assert rows.where("ingest_batch = 1 and threat_score = 70").count() == 3
    assert spark.read.parquet(sinks.metrics).count() == 2
    refused = spark.read.parquet(sinks.refused).orderBy("ingest_batch").select("ingest_batch", F.col("errors.field").alias("f"))
    assert [tuple(r) for r in refused.collect()] == [(0, ["[0].path"]), (1, ["[0].rule"])]


def test_a_request_is_refused_as_a_whole(spark, tmp_path):
    sinks = sinks_in(tmp_path)
    requests = bodies(spark, wave(0, 2) + [event(statusCode=1)], wave(10, 3))
    ingest_batch(requests, 0, sinks, NOW)
    assert event_table.read(spark, sinks.events).count() == 3
    assert spark.read.parquet(sinks.metrics).select("events").first()["events"] == 3
    other = sinks_in(tmp_path / "q")
    ingest_batch(requests, 0, other, NOW, mode="quarantine")
    assert event_table.read(spark, other.events).count() == 5


def test_a_batch_with_nothing_accepted(spark, tmp_path):
    sinks = sinks_in(tmp_path)
    ingest_batch(bodies(spark, []), 0, sinks, NOW)
    ingest_batch(bodies(spark, wave(0, 2)), 1, sinks, NOW)
    assert event_table.read(spark, sinks.events, with_batches=True).count() == 2


def test_stream_equals_replay(spark, tmp_path):
    rng = random.Random(1)
    source = tmp_path / "in"
    source.mkdir()
    everything = []
    for batch in range(4):
        sent = []
        for i in range(40):
            second = batch * 100 + rng.randrange(400)
            e = event(eventId=f"{batch}-{i}", clientIp=f"ip-{rng.randrange(3)}",
                      timestamp=(at("14:00:00") + timedelta(seconds=second)).strftime("%Y-%m-%dT%H:%M:%SZ"))
            sent.append(e)
            everything.append((batch, json.dumps(e)))
        (source / f"{batch}.json").write_text(json.dumps(sent))
        sinks = sinks_in(tmp_path / "out")
        query = start_ingest(
            stream_requests(spark, str(source), max_files=1), sinks, str(tmp_path / "checkpoint"), clock=lambda: NOW)
        assert query.awaitTermination(120)
    found = event_table.read(spark, sinks.events, with_batches=True)
    assert {r["received_at"].timestamp() for r in found.select("received_at").distinct().collect()} == {NOW.timestamp()}
    streamed = {r["event_id"]: r["threat_score"] for r in found.collect()}
    parsed = parse_requests(spark.createDataFrame(everything, "batch_id int, body string"))
    flat = event_table.flatten(
        validation.accepted_events(validation.judge_requests(parsed)), keep=["batch_id"])
    replayed = offenders.with_prior_count(flat, offenders.prior_counts_replayed(flat))
    expected = {r["event_id"]: 70 if r["prior_count"] > 5 else 55 for r in replayed.collect()}
    assert len(set(expected.values())) == 2
    assert streamed == expected


def test_live_counts_equal_the_batch_query(spark, tmp_path):
    sinks = sinks_in(tmp_path)
    for batch_id in range(2):
        ingest_batch(bodies(spark, wave(400 * batch_id, 300)), batch_id, sinks, NOW)
    stream = spark.readStream.schema(event_table.table_schema(with_batches=True)).parquet(sinks.events)
    path, checkpoint = str(tmp_path / "live"), str(tmp_path / "live-checkpoint")
    assert start_live_counts(stream, path, checkpoint).awaitTermination(120)
    # Hours late, and still counted.
    late = event(eventId="late", timestamp="2026-05-20T14:00:30Z"), event(eventId="later", timestamp="2026-05-20T03:00:00Z")
    ingest_batch(bodies(spark, *late), 2, sinks, NOW)
    assert start_live_counts(stream, path, checkpoint).awaitTermination(120)
    live = sorted((r["bucket_from"], r["bucket_to"], r["count"]) for r in live_counts(spark, path).collect())
    batch = timeseries.counts(event_table.read(spark, sinks.events), at("03:00:00"), at("14:15:00"), "5m")
    assert live == sorted(tuple(r) for r in batch.where("count > 0").collect())
    assert sum(n for *_, n in live) == 602
    with pytest.raises(ValueError):
        start_live_counts(stream, path, checkpoint, "7m")


def test_a_new_checkpoint_keeps_what_is_stored_and_sees_it(spark, tmp_path):
    sinks = sinks_in(tmp_path / "out")
    for run, (first, size) in enumerate([(0, 6), (6, 3)]):
        source = tmp_path / f"in{run}"
        source.mkdir()
        (source / "r.json").write_text(json.dumps(wave(first, size)))
        query = start_ingest(stream_requests(spark, str(source)), sinks, str(tmp_path / f"checkpoint{run}"), clock=lambda: NOW)
        assert query.awaitTermination(120)
    rows = event_table.read(spark, sinks.events, with_batches=True)
    assert rows.count() == 9 and rows.select("ingest_run").distinct().count() == 2
    assert rows.where("threat_score = 70").count() == 3
    assert spark.read.parquet(sinks.metrics).count() == 2


@pytest.mark.parametrize("files", [1, 5, None])
def test_scores_do_not_depend_on_the_trigger(spark, tmp_path, files):
    source = tmp_path / "in"
    source.mkdir()
    for i, e in enumerate(wave(0, 12)):
        (source / f"{i:02}.json").write_text(json.dumps(e))
        os.utime(source / f"{i:02}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    sinks = sinks_in(tmp_path / "out")
    query = start_ingest(stream_requests(spark, str(source), max_files=files), sinks, str(tmp_path / "c"), clock=lambda: NOW)
    assert query.awaitTermination(240)
    scores = [r.threat_score for r in event_table.read(spark, sinks.events).orderBy("timestamp").collect()]
    assert scores == [55] * 6 + [70] * 6


def test_backfilled_events_are_history(spark, tmp_path):
    sinks = sinks_in(tmp_path)
    ingest_batch(bodies(spark, wave(0, 6)), 0, sinks_in(tmp_path / "other"), NOW)
    event_table.append(event_table.read(spark, str(tmp_path / "other" / "events")).drop("event_date"), sinks.events, rebalance=True)
    ingest_batch(bodies(spark, wave(6, 2)), 0, sinks, NOW)
    rows = event_table.read(spark, sinks.events, with_batches=True)
    assert rows.count() == 8
    assert [r.threat_score for r in rows.where("ingest_run = 'manual'").collect()] == [70, 70]


def test_events_of_the_first_and_last_year(spark, tmp_path):
    sinks = sinks_in(tmp_path)
    times = ["0001-01-01T00:00:00Z", "0001-01-01T00:00:01Z", "9999-12-31T23:59:59Z"]
    for batch_id, time in enumerate(times):
        ingest_batch(bodies(spark, event(eventId=time, timestamp=time)), batch_id, sinks, NOW)
    ingest_batch(bodies(spark, *[event(eventId=f"again {t}", timestamp=t) for t in times]), 3, sinks, NOW)
    assert event_table.read(spark, sinks.events).count() == 6
