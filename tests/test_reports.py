import json

from conftest import at, visits
from palisade import schema
from palisade.plans import reports

DAY = at("00:00:00"), at("2026-05-21T00:00:00Z")


def document(df):
    return [json.loads(r["value"]) for r in reports.as_json(df).collect()]


def test_summary_of_one_configuration_with_ties(spark):
    [found] = document(reports.summary(visits(spark), *DAY, config_id=12))
    assert (found["configId"], found["totalEvents"]) == (12, 4)
    assert found["timeRange"] == {"from": "2026-05-20T00:00:00.000Z", "to": "2026-05-21T00:00:00.000Z"}
    assert found["byCategory"] == {"XSS": {"count": 3, "avgThreatScore": 42.3}, "DOS": {"count": 1, "avgThreatScore": 20.0}}
    assert found["byAction"] == {"ALERT": 2, "DENY": 1, "MONITOR": 1}
    assert [(a["clientIp"], a["count"], a["avgThreatScore"]) for a in found["topAttackers"]] == [
        ("192.0.2.4", 2, 27.0), ("192.0.2.9", 2, 46.5),
    ]
    assert [(p["path"], p["count"]) for p in found["topTargetedPaths"]] == [("/rake", 2), ("/hoe", 1), ("/seed", 1)]


def test_summary_of_all_configurations(spark):
    [found] = document(reports.summary(visits(spark), *DAY))
    assert "configId" not in found and found["totalEvents"] == 6
    assert [(a["clientIp"], a["count"], a["avgThreatScore"]) for a in found["topAttackers"]] == [
        ("192.0.2.4", 3, 33.0), ("192.0.2.9", 2, 46.5), ("192.0.2.77", 1, 21.0),
    ]
    assert [p["path"] for p in found["topTargetedPaths"]] == ["/hoe", "/rake", "/seed"]


def test_summary_of_nothing(spark):
    [found] = document(reports.summary(visits(spark), *DAY, config_id=13))
    assert (found["totalEvents"], found["byCategory"], found["topAttackers"]) == (0, {}, [])


def test_sample_page(spark):
    [found] = document(reports.sample_page(visits(spark), limit=3, offset=2))
    assert (found["total"], found["limit"], found["offset"]) == (6, 3, 2)
    assert [i["eventId"] for i in found["items"]] == ["g4", "g2", "g3"]
    assert found["items"][0]["rule"] == {"severity": "HIGH", "category": "XSS"}
    assert found["items"][2]["timestamp"] == "2026-05-20T09:20:00.000Z"
    [empty] = document(reports.sample_page(visits(spark), offset=6))
    assert (empty["total"], empty["items"]) == (6, [])
    [none] = document(reports.sample_page(visits(spark), category="BOT"))
    assert (none["total"], none["limit"], none["items"]) == (0, 20, [])


def test_time_series_by_the_hour(spark):
    found = document(reports.time_series(visits(spark), at("09:10:00"), at("10:10:00"), "1h"))
    assert [(b["interval"], b["from"][11:16], b["to"][11:16], b["count"]) for b in found] == [
        ("1h", "09:00", "10:00", 3), ("1h", "10:00", "10:10", 2),
    ]


def test_firing_alerts(spark):
    rules = spark.createDataFrame(
        [("rule-2", 12, "XSS", 2, 90), ("rule-3", 31, "XSS", 1, 90), ("rule-9", None, "DOS", 1, 60)], schema.ALERT_RULE
    )
    found = sorted(document(reports.firing_alerts(visits(spark), rules, at("10:10:00"))), key=lambda d: d["ruleId"])
    assert [(d["ruleId"], d.get("configId"), d["actualCount"], d["windowFrom"][11:16]) for d in found] == [
        ("rule-2", 12, 3, "08:40"), ("rule-9", None, 2, "09:10"),
    ]
    assert {d["evaluatedAt"] for d in found} == {d["windowTo"] for d in found} == {"2026-05-20T10:10:00.000Z"}
