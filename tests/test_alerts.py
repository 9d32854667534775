from datetime import timedelta

import pytest

from conftest import at, stored
from palisade import schema
from palisade.operators import alerts
from palisade.sources import rules_table

NOW = at("15:00:00")
MINUTE = timedelta(minutes=1)


def rules(spark, *rows):
    return spark.createDataFrame([(f"rule-{i + 1}", *r) for i, r in enumerate(rows)], schema.ALERT_RULE)


def injections(spark, count, age, config_id=1):
    return stored(spark, *[
        {"timestamp": NOW - age, "rule_category": "INJECTION", "config_id": config_id} for _ in range(count)])


def test_fires_above_the_threshold(spark):
    found = alerts.firing(injections(spark, 6, MINUTE), rules(spark, (1, "INJECTION", 5, 5)), NOW).collect()
    assert len(found) == 1
    row = found[0]
    assert (row["rule_id"], row["actual_count"], row["threshold"], row["window_minutes"]) == ("rule-1", 6, 5, 5)
    assert row["window_to"].timestamp() == NOW.timestamp()
    assert row["window_from"].timestamp() == (NOW - 5 * MINUTE).timestamp()


def test_silent_at_the_threshold(spark):
    assert alerts.firing(injections(spark, 5, MINUTE), rules(spark, (1, "INJECTION", 5, 5)), NOW).count() == 0


def test_silent_outside_the_window(spark):
    assert alerts.firing(injections(spark, 6, 10 * MINUTE), rules(spark, (1, "INJECTION", 0, 5)), NOW).count() == 0


@pytest.mark.parametrize("age,expected", [
    (timedelta(0), 0), (timedelta(microseconds=1), 1), (5 * MINUTE, 1),
    (5 * MINUTE + timedelta(microseconds=1), 0), (-MINUTE, 0),
])
def test_window_edges(spark, age, expected):
    found = alerts.evaluate(injections(spark, 1, age), rules(spark, (1, "INJECTION", 1, 5)), NOW).first()
    assert found["actual_count"] == expected


def test_scopes(spark):
    events = injections(spark, 3, MINUTE, 1).union(injections(spark, 4, 2 * MINUTE, 2))
    chosen = rules(spark, (1, "INJECTION", 1, 5), (2, "INJECTION", 1, 5), (None, "INJECTION", 1, 5),
                   (None, "INJECTION", 1, 1), (3, "INJECTION", 1, 5), (None, "DOS", 1, 5))
    found = {r["rule_id"]: r["actual_count"] for r in alerts.evaluate(events, chosen, NOW).collect()}
    assert found == {"rule-1": 3, "rule-2": 4, "rule-3": 7, "rule-4": 3, "rule-5": 0, "rule-6": 0}


def test_same_rule_twice_is_two_rules(spark):
    chosen = rules(spark, (1, "INJECTION", 5, 5), (1, "INJECTION", 5, 5))
    assert alerts.firing(injections(spark, 6, MINUTE), chosen, NOW).count() == 2


def test_no_rules(spark):
    assert alerts.firing(injections(spark, 6, MINUTE), rules(spark, (1, "DOS", 1, 1)).limit(0), NOW).count() == 0


def definitions(spark, *rows):
    return spark.createDataFrame(list(rows), "seq bigint, config_id bigint, category string, threshold int, window_minutes int")


def test_definitions_are_checked(spark):
    asked = definitions(spark, (0, 1, "BOT", 1, 1), (1, 1, None, 1, 1), (2, 1, "SPAM", 1, 1),
                        (3, 1, "BOT", 0, 1), (4, 1, "BOT", 1, 0), (5, 1, "BOT", None, 1), (6, None, "DOS", 9, 9))
    found = [tuple(r) for r in rules_table.define(asked).orderBy("id").collect()]
    assert found == [("rule-1", 1, "BOT", 1, 1), ("rule-2", None, "DOS", 9, 9)]


def test_ids_go_on_in_order_across_runs(spark):
    asked = definitions(spark, *[(seq, seq, "BOT", 1, 1) for seq in (5, 4095, 4096, 9000, 70_000)])
    found = {r["config_id"]: r["id"] for r in rules_table.define(asked, rules(spark, *[(1, "BOT", 1, 1)] * 11)).collect()}
    assert found == {5: "rule-12", 4095: "rule-13", 4096: "rule-14", 9000: "rule-15", 70_000: "rule-16"}


def test_ids_of_sparse_numbers(spark):
    places = [-9 * 10**18, -5000, -1, 0, 4096, 5_000_000, 10**12, 10**12 + 1, 2**53 + 1, 2**53 + 2, 9 * 10**18]
    asked = definitions(spark, *[(seq, i, "BOT", 1, 1) for i, seq in enumerate(places)])
    found = {r["config_id"]: r["id"] for r in rules_table.define(asked).collect()}
    assert found == {i: f"rule-{i + 1}" for i in range(len(places))}


def test_no_definition_is_no_rule(spark):
    assert rules_table.define(definitions(spark, (0, 1, "BOT", 0, 1))).count() == 0


def test_refused_definitions_are_told_why(spark):
    asked = definitions(spark, (0, 1, "BOT", 1, 1), (1, 1, None, 1, 1), (2, 1, "SPAM", None, 0))
    found = sorted(map(tuple, rules_table.definition_errors(asked).collect()))
    known = "INJECTION, XSS, PROTOCOL_VIOLATION, DATA_LEAKAGE, BOT, DOS, RATE_LIMIT"
    least = "must be greater than or equal to 1"
    assert found == [(1, "category", "must not be null"), (2, "category", f"must be one of {known}"),
                     (2, "threshold", least), (2, "windowMinutes", least)]


def test_errors_and_rules_share_no_definition(spark):
    asked = definitions(spark, *[(i, 1, c, t, w) for i, (c, t, w) in enumerate(
        (c, t, w) for c in ("BOT", "SPAM", None) for t in (1, 0, None) for w in (1, 0, None))])
    refused = {r["seq"] for r in rules_table.definition_errors(asked).collect()}
    sound = {r["seq"] for r in rules_table.valid_definitions(asked).collect()}
    assert not refused & sound and len(refused | sound) == 27


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "rules")
    rules_table.append(rules_table.define(definitions(spark, (0, 5201, "INJECTION", 100, 5))), path)
    second = rules_table.define(definitions(spark, (0, None, "BOT", 50, 10)), rules_table.read(spark, path))
    rules_table.append(second, path)
    found = sorted(map(tuple, rules_table.read(spark, path).collect()))
    assert found == [("rule-1", 5201, "INJECTION", 100, 5), ("rule-2", None, "BOT", 50, 10)]


def test_one_long_window_does_not_stop_the_others(spark):
    asked = rules(spark, (1, "INJECTION", 5, 1), (1, "INJECTION", 5, 2_000_000_000))
    found = alerts.firing(injections(spark, 6, 10 * MINUTE), asked, NOW)
    assert [r.rule_id for r in found.select("rule_id").collect()] == ["rule-2"]
