"""All registered queries against their SQL, and what their plans may hold."""

import duckdb
import pytest

import __spark_entry__ as app
from conftest import plan_of
from oracle import ORACLE
from tools.compare import rows, types

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    return connection


def test_every_query_has_its_sql():
    """The library's own queries; those of the corpus subpackage are tested with it."""
    assert set(app._QUERIES) == set(ORACLE)
    assert set(ORACLE) <= set(app.queries()) and set(app.oracle_sql()) <= set(app.queries())


@pytest.mark.parametrize("name", list(ORACLE))
def test_equals_sql(spark, db, name):
    mine = app.queries()[name](spark, SF_DIR)
    plan = plan_of(mine)
    for unwanted in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan
    found = mine.toArrow()
    twin = db.sql(app.oracle_sql()[name]).to_arrow_table()
    assert types(found) == types(twin)
    assert rows(found) == rows(twin)


def test_flagship_query(spark):
    assert app.entry(spark).count() == 7


def test_anchor_counts(spark):
    query = app.queries()["repeat_offender_history"]
    found = query(spark, "/root/testdata/sf0.01")
    assert found.where("repeat_offender").count() == 1205
    assert found.agg({"prior_count": "max"}).first()[0] == 12


def test_replay_sorts_no_whole_address(spark):
    """Windows run per time slice, never per address alone."""
    plan = plan_of(app.queries()["repeat_offender_history"](spark, SF_DIR))
    windows = [line for line in plan.splitlines() if "windowspecdefinition(" in line]
    assert windows
    for line in windows:
        keys = line.split("windowspecdefinition(")[1]
        assert "slice#" in keys or "ts_ms#" in keys


def test_rules_take_part_in_no_window(spark):
    """Only the distinct windows asked for do, and the rules are joined to the answers."""
    plan = plan_of(app.queries()["alerts_firing"](spark, SF_DIR))
    assert plan.count("Join") == 1
    [window] = [line for line in plan.splitlines() if "windowspecdefinition(" in line]
    assert "threshold" not in window and "rule" not in window.split("windowspecdefinition(")[0]
