import json
import os
import sys
from datetime import datetime, timezone

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from palisade import schema  # noqa: E402
from palisade.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "4000")
        .config("spark.default.parallelism", "2")
        .config("spark.sql.debug.maxToStringFields", "200")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def at(text: str) -> datetime:
    """A time of 20 May 2026, or a whole ISO instant."""
    if "T" not in text:
        text = f"2026-05-20T{text}"
    return datetime.fromisoformat(text.replace("Z", "")).replace(tzinfo=timezone.utc)


EVENT = {
    "eventId": "gate-17",
    "timestamp": "2026-05-20T06:08:51.250Z",
    "configId": 88,
    "policyId": "night",
    "clientIp": "2001:db8::5",
    "hostname": "depot.test",
    "path": "/staff/admin",
    "method": "PUT",
    "statusCode": 451,
    "rule": {"id": "950", "name": "odd hours", "severity": "HIGH", "category": "DATA_LEAKAGE"},
    "action": "ALERT",
    "requestSize": 64,
}


def event(drop: tuple = (), **changes) -> dict:
    made = json.loads(json.dumps(EVENT))
    for name, value in changes.items():
        if name.startswith("rule_"):
            made["rule"][name[5:]] = value
        else:
            made[name] = value
    for name in drop:
        del made[name]
    return made


_STORED = {
    "event_id": "e", "timestamp": None, "received_at": at("23:00:00"), "config_id": 88,
    "policy_id": "night", "client_ip": "2001:db8::5", "hostname": "depot.test", "path": "/tools", "method": "PUT",
    "status_code": 451, "user_agent": "", "rule_id": "950", "rule_name": "odd hours", "rule_message": "",
    "rule_severity": "LOW", "rule_category": "BOT", "action": "MONITOR", "geo_country": "",
    "geo_city": "", "request_size": 64, "response_size": 0, "attack_type": "Bot Activity", "threat_score": 10,
}


def stored(spark, *rows: dict):
    """Rows of the event table; each row needs a ``timestamp``."""
    full = [{**_STORED, **row} for row in rows]
    for row in full:
        if isinstance(row["timestamp"], str):
            row["timestamp"] = at(row["timestamp"])
    names = schema.EVENT_TABLE.fieldNames()
    return spark.createDataFrame([tuple(row[n] for n in names) for row in full], schema.EVENT_TABLE)


def visits(spark):
    """Six events of two configurations: equal times, equal counts of addresses and of paths."""
    names = "event_id", "timestamp", "config_id", "client_ip", "path", "rule_severity", "rule_category", "action", "threat_score"
    rows = [
        ("g1", "09:00:00", 12, "192.0.2.9", "/rake", "HIGH", "XSS", "ALERT", 33),
        ("g2", "09:20:00", 12, "192.0.2.4", "/seed", "MEDIUM", "DOS", "MONITOR", 20),
        ("g3", "09:20:00", 31, "192.0.2.4", "/seed", "MEDIUM", "DOS", "DENY", 45),
        ("g4", "09:41:00", 12, "192.0.2.9", "/hoe", "HIGH", "XSS", "DENY", 60),
        ("g5", "10:02:00", 12, "192.0.2.4", "/rake", "HIGH", "XSS", "ALERT", 34),
        ("g6", "10:02:00", 31, "192.0.2.77", "/hoe", "LOW", "RATE_LIMIT", "ALERT", 21),
    ]
    return stored(spark, *[dict(zip(names, row)) for row in rows])


def plan_of(df) -> str:
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()
