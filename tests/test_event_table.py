import glob
import json

from pyspark.sql import functions as F

from conftest import at, event, plan_of, stored
from palisade import schema
from palisade.operators import aggregates, filters, validation
from palisade.sources import event_table
from palisade.sources.requests import parse_requests


def sample(spark):
    return stored(spark, *[
        {"event_id": f"e{i}", "timestamp": at(f"2026-05-{day}T10:00:00Z"), "config_id": 1 + i % 3}
        for i, day in enumerate((19, 20, 20, 21))
    ])


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    event_table.append(sample(spark), path)
    found = event_table.read(spark, path)
    assert sorted(map(tuple, found.drop("event_date").collect())) == sorted(map(tuple, sample(spark).collect()))
    assert found.schema.fieldNames() == schema.EVENT_TABLE.fieldNames() + ["event_date"]
    assert len(glob.glob(path + "/event_date=*")) == 3


def test_the_same_event_twice_is_stored_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    event_table.append(sample(spark), path)
    event_table.append(sample(spark), path, rebalance=True)
    assert event_table.read(spark, path).count() == 8


def test_bounds_reach_partitions_and_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    event_table.append(sample(spark), path)
    found = filters.matching(event_table.read(spark, path), at("00:00:00"), at("2026-05-21T00:00:00Z"), 2)
    assert found.count() == 1
    plan = plan_of(found.select("path"))
    assert "event_date#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThan(timestamp" in pushed
    assert "EqualTo(config_id,2)" in pushed


def test_summary_reads_only_its_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    event_table.append(sample(spark), path)
    plan = plan_of(aggregates.by_action(event_table.read(spark, path), at("00:00:00"), at("23:00:00")))
    read = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert read == "timestamp:timestamp,action:string"


def test_a_range_that_ends_at_midnight_leaves_the_next_day_out(spark, tmp_path):
    path = str(tmp_path / "t")
    event_table.append(sample(spark), path)
    found = filters.matching(event_table.read(spark, path), to=at("2026-05-21T00:00:00Z"))
    assert found.count() == 3
    assert "2026-05-20" in plan_of(found).split("PartitionFilters: [")[1].split("]")[0]


def test_reading_some_days(spark, tmp_path):
    path = str(tmp_path / "t")
    day = lambda text: at(f"{text}T00:00:00Z").date()
    ids = lambda df: sorted(r["event_id"] for r in df.collect())
    some, later, all_time = [
        (day(a), day(b)) for a, b in
        [("2026-05-20", "2026-05-25"), ("2026-06-01", "2026-06-02"), ("1970-01-01", "2200-01-01")]
    ]
    assert event_table.read(spark, path, days=[some]).count() == 0
    event_table.append(sample(spark), path)
    found = event_table.read(spark, path, days=[some])
    assert ids(found) == ["e1", "e2", "e3"]
    assert len(found.inputFiles()) < len(event_table.read(spark, path).inputFiles())
    assert event_table.read(spark, path, days=[later]).count() == 0
    assert ids(event_table.read(spark, path, days=[all_time])) == ["e0", "e1", "e2", "e3"]


def test_nested_and_flat_forms(spark):
    body = json.dumps(event(policyId="p", geoLocation={"country": "US"}, requestSize=7, rule_name="n"))
    parsed = parse_requests(spark.createDataFrame([(0, body)], "request_id int, body string"))
    flat = event_table.flatten(validation.accepted_events(validation.judge_requests(parsed)))
    row = flat.first()
    assert (row["policy_id"], row["geo_country"], row["geo_city"], row["request_size"]) == ("p", "US", "", 7)
    whole = flat.withColumns({"attack_type": F.lit("t"), "threat_score": F.lit(1), "received_at": F.lit(at("00:00:00"))})
    nested = event_table.nest(whole)
    assert nested.select("event.rule.name", "event.geoLocation.country").first() == ("n", "US")
    assert event_table.flatten(nested).collect() == flat.collect()
