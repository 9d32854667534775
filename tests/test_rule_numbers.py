"""Rule numbers reserved by several writers at once: disjoint, without a gap."""

from concurrent.futures import ThreadPoolExecutor

from palisade import schema
from palisade.sources import rules_table

KIND = "seq long, config_id long, category string, threshold int, window_minutes int"


def wanted(spark, n, first=0):
    return spark.createDataFrame([(first + i, 5201, "BOT" if i % 5 else "none", 1 + i % 3, 5) for i in range(n)], KIND)


def numbers(spark, path):
    return sorted(int(r["id"].removeprefix("rule-")) for r in rules_table.read(spark, path).collect())


def test_numbers_go_on(spark, tmp_path):
    path = str(tmp_path / "rules")
    first = rules_table.define_into(wanted(spark, 10), path)
    assert [r["id"] for r in first.orderBy("id").collect()] == [f"rule-{n}" for n in range(1, 9)]
    rules_table.define_into(wanted(spark, 5), path)
    assert numbers(spark, path) == list(range(1, 13))


def test_a_table_without_reservations_goes_on_from_its_rules(spark, tmp_path):
    path = str(tmp_path / "rules")
    rules_table.append(spark.createDataFrame([("rule-41", None, "BOT", 1, 5)], schema.ALERT_RULE), path)
    rules_table.define_into(wanted(spark, 3), path)
    assert numbers(spark, path) == [41, 42, 43]


def test_nothing_valid_reserves_nothing(spark, tmp_path):
    path = str(tmp_path / "rules")
    assert rules_table.define_into(wanted(spark, 1), path).count() == 0
    assert rules_table.reserve(spark, path, 0) == 0
    assert rules_table.reserve(spark, path, 2) == 0 and rules_table.reserve(spark, path, 1) == 2


def test_concurrent_writers_get_disjoint_numbers(spark, tmp_path):
    path = str(tmp_path / "rules")
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda n: (rules_table.reserve(spark, path, n), n), [1 + k % 7 for k in range(80)]))
    taken = sorted(n for base, size in got for n in range(base + 1, base + size + 1))
    assert taken == list(range(1, sum(size for _, size in got) + 1))


def test_concurrent_definitions_are_all_there(spark, tmp_path):
    path = str(tmp_path / "rules")
    frames = [wanted(spark, 10, 100 * k) for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda df: rules_table.define_into(df, path).count(), frames))
    assert numbers(spark, path) == list(range(1, 33))


def test_a_range_appears_once(spark, tmp_path):
    ranges = rules_table._Ranges(spark, str(tmp_path / "rules"))
    assert ranges.last() is None
    assert ranges.publish(1, 5) and not ranges.publish(1, 9) and ranges.last() == 5
    assert [p.name for p in (tmp_path / "rules-ids").iterdir() if not p.name.startswith(".")] == [f"{1:020d}"]
