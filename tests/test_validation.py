import json

import pytest
from pyspark.sql import functions as F

from conftest import event
from palisade.operators import validation
from palisade.sources import event_table
from palisade.sources.requests import parse_requests, read_requests


def judged(spark, *bodies, **kwargs):
    bodies = [b if isinstance(b, str) else json.dumps(b) for b in bodies]
    rows = spark.createDataFrame(list(enumerate(bodies)), "request_id int, body string")
    return validation.judge_requests(parse_requests(rows), **kwargs)


def errors(spark, *bodies, **kwargs):
    found = validation.request_errors(judged(spark, *bodies, **kwargs)).collect()
    return {(r["field"], r["message"]) for r in found}


def fields(spark, *bodies, **kwargs):
    return {field for field, _ in errors(spark, *bodies, **kwargs)}


def test_single_object_and_array_are_accepted(spark):
    both = judged(spark, event(), [event(), event(eventId="evt-002")])
    rows = validation.accepted_events(both).select("request_id", "idx", "event.eventId").collect()
    assert sorted(map(tuple, rows)) == [(0, 0, "gate-17"), (1, 0, "gate-17"), (1, 1, "evt-002")]


def test_missing_rule(spark):
    assert errors(spark, event(drop=("rule",))) == {("[0].rule", "must not be null")}


def test_unknown_enum_values(spark):
    assert fields(spark, event(rule_category="NOT_A_CATEGORY")) == {"[0].rule.category"}
    assert fields(spark, event(rule_severity="critical")) == {"[0].rule.severity"}
    assert fields(spark, event(action="BLOCK")) == {"[0].action"}


def test_empty_request(spark):
    assert errors(spark, []) == {("events", "must not be empty")}


def test_request_above_the_limit(spark):
    many = [event(eventId="e")] * 10_001
    assert errors(spark, many) == {("events", "batch must not exceed 10000 events")}
    assert errors(spark, many[:10_000]) == set()
    assert fields(spark, [event()] * 4, max_batch_size=3) == {"events"}


def test_numbers_out_of_range(spark):
    assert errors(spark, event(statusCode=99999, configId=-5)) == {
        ("[0].statusCode", "must be less than or equal to 599"),
        ("[0].configId", "must be greater than or equal to 0"),
    }
    assert fields(spark, event(statusCode=99)) == {"[0].statusCode"}
    assert fields(spark, event(requestSize=-1, responseSize=-1)) == {"[0].requestSize", "[0].responseSize"}
    assert errors(spark, [event(statusCode=100, configId=0, requestSize=0), event(statusCode=599)]) == set()


@pytest.mark.parametrize("field", ["eventId", "clientIp", "path", "method"])
@pytest.mark.parametrize("text", ["", "  ", "\t\n", None])
def test_blank_text(spark, field, text):
    assert errors(spark, event(**{field: text})) == {(f"[0].{field}", "must not be blank")}


@pytest.mark.parametrize("field", ["timestamp", "configId", "statusCode", "action"])
def test_required_fields(spark, field):
    assert errors(spark, event(drop=(field,))) == {(f"[0].{field}", "must not be null")}


def test_rule_parts(spark):
    assert fields(spark, event(rule={"id": " "})) == {"[0].rule.id", "[0].rule.severity", "[0].rule.category"}


@pytest.mark.parametrize("text", ["2026-05-20", "2026-05-20T14:32:10", "yesterday", "2026-13-40T14:32:10Z"])
def test_what_is_not_an_instant(spark, text):
    assert fields(spark, event(timestamp=text)) == {"[0].timestamp"}


@pytest.mark.parametrize("text,micros", [
    ("2026-05-20T14:32:10Z", 0), ("2026-05-20T14:32:10.5Z", 500_000),
    ("2026-05-20T14:32:10.123456789Z", 123_000), ("2026-05-20T16:32:10.042+02:00", 42_000),
])
def test_instants_keep_milliseconds(spark, text, micros):
    rows = event_table.flatten(validation.accepted_events(judged(spark, event(timestamp=text))))
    got = rows.select(F.unix_micros("timestamp").alias("t")).first()["t"]
    assert got == 1_779_287_530_000_000 + micros


def test_wrong_types(spark):
    assert fields(spark, event(statusCode="forbidden")) == {"[0].statusCode"}
    assert errors(spark, event(requestSize="big")) == {("[0].requestSize", "must be a whole number")}
    assert fields(spark, event(rule="701")) == {"[0].rule"}


@pytest.mark.parametrize("body", ["nonsense", '"text"', "17", "", "[{", "null"])
def test_unreadable_bodies(spark, body):
    assert fields(spark, body) & {"body", "events", "[0].rule"}
    assert validation.accepted_events(judged(spark, body)).count() == 0


def test_one_bad_event_refuses_its_request_only(spark):
    bodies = [event(), event(statusCode=1)], [event(eventId="other")]
    assert [r["eventId"] for r in validation.accepted_events(judged(spark, *bodies)).select("event.eventId").collect()] == ["other"]
    kept = validation.accepted_events(judged(spark, *bodies), mode="quarantine")
    assert sorted(r["eventId"] for r in kept.select("event.eventId").collect()) == ["gate-17", "other"]
    with pytest.raises(ValueError):
        validation.accepted_events(judged(spark, *bodies), mode="lenient")


def test_error_index_is_the_place_in_the_request(spark):
    assert fields(spark, [event(), event(), event(path=" ")]) == {"[2].path"}


def test_unknown_fields_are_ignored_and_absent_ones_filled(spark):
    row = event_table.flatten(validation.accepted_events(judged(spark, event(drop=("policyId", "hostname", "requestSize"), rule_name=None, extra=1)))).first()
    assert (row["policy_id"], row["hostname"], row["user_agent"], row["rule_name"]) == ("", "", "", "")
    assert (row["geo_country"], row["geo_city"]) == ("", "")
    assert (row["request_size"], row["response_size"]) == (0, 0)


def test_rows_of_batches(spark):
    parsed = parse_requests(spark.createDataFrame(
        [(b, json.dumps(event(eventId=f"{b}-{i}", statusCode=200 if ok else 7)))
         for b, i, ok in [(1, 0, True), (1, 1, False), (2, 0, True), (3, 0, True), (3, 1, True)]],
        "batch_id int, body string",
    ))
    rows = parsed.select("batch_id", F.explode("events").alias("event")).select(
        "batch_id", F.col("event").withField("requestSize", F.lit(0).cast("bigint")).alias("event"))
    ids = lambda df: sorted(r["eventId"] for r in df.select("event.eventId").collect())
    assert ids(validation.accept_rows(rows)) == ["2-0", "3-0", "3-1"]
    assert ids(validation.accept_rows(rows, max_batch_size=1)) == ["2-0"]
    assert ids(validation.accept_rows(rows, mode="quarantine")) == ["1-0", "2-0", "3-0", "3-1"]


def test_requests_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(event()) + "\n" + json.dumps([event(), event()]) + "\n")
    assert read_requests(spark, str(tmp_path)).count() == 2
    other = tmp_path / "whole"
    other.mkdir()
    (other / "b.json").write_text(json.dumps([event(), event()], indent=2))
    parsed = parse_requests(read_requests(spark, str(other), whole_files=True))
    assert parsed.select(F.size("events")).first()[0] == 2
