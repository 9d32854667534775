import pytest
from pyspark.sql import functions as F

from palisade import schema
from palisade.functions.scoring import attack_type, one_decimal, threat_score


def score(spark, severity, action, path, repeat=False):
    row = spark.createDataFrame([(severity, action, path, repeat)], "s string, a string, p string, r boolean")
    return row.select(threat_score(F.col("s"), F.col("a"), F.col("p"), F.col("r")).alias("x")).first()["x"]


@pytest.mark.parametrize("severity,expected", [("CRITICAL", 40), ("HIGH", 30), ("MEDIUM", 20), ("LOW", 10)])
def test_severity(spark, severity, expected):
    assert score(spark, severity, "MONITOR", "/") == expected


@pytest.mark.parametrize("action,expected", [("DENY", 30), ("ALERT", 20), ("MONITOR", 10)])
def test_action(spark, action, expected):
    assert score(spark, "LOW", action, "/") == expected


@pytest.mark.parametrize("path,expected", [
    ("/members/login", 25), ("/admin/users", 25), ("/health", 10), (None, 10),
    ("/wp-login.php", 10), ("/LOGIN", 10), ("/admin/login", 25),
])
def test_sensitive_path(spark, path, expected):
    assert score(spark, "LOW", "MONITOR", path) == expected


def test_repeat_offender_and_highest_score(spark):
    assert score(spark, "LOW", "MONITOR", "/", True) == 25
    assert score(spark, "CRITICAL", "DENY", "/login", True) == 90


def test_every_category_has_an_attack_type(spark):
    rows = spark.createDataFrame([(c,) for c in schema.CATEGORIES + ["OTHER"]], "c string")
    found = {r["c"]: r["t"] for r in rows.select("c", attack_type(F.col("c")).alias("t")).collect()}
    assert found.pop("OTHER") is None
    assert found == schema.ATTACK_TYPE and len(found) == 7


def test_one_decimal_rounds_half_up(spark):
    values = [(0.0, 0.0), (66.65, 66.7), (66.64, 66.6), (0.25, 0.3), (75.0, 75.0)]
    rows = spark.createDataFrame(values, "x double, y double")
    assert all(r["z"] == r["y"] for r in rows.select("y", one_decimal(F.col("x")).alias("z")).collect())
