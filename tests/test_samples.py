import random
from datetime import timedelta

import pytest

from conftest import at, stored
from palisade.operators import samples


@pytest.fixture(scope="module")
def three(spark):
    return stored(
        spark,
        {"event_id": "a1", "timestamp": "10:00:00", "rule_category": "INJECTION", "action": "DENY"},
        {"event_id": "a2", "timestamp": "10:05:00", "rule_category": "INJECTION", "action": "DENY"},
        {"event_id": "a3", "timestamp": "10:10:00", "config_id": 2},
    )


def ids(df):
    return [r["event_id"] for r in df.collect()]


def test_newest_first(three):
    assert ids(samples.page(three)) == ["a3", "a2", "a1"]


def test_second_page_and_total(three):
    assert ids(samples.page(three, limit=2, offset=2)) == ["a1"]
    assert samples.total(three).first()["total"] == 3


def test_page_past_the_end(three):
    assert ids(samples.page(three, offset=3)) == []
    assert ids(samples.page(three, offset=30_000)) == []


def test_filters(three):
    assert ids(samples.page(three, category="BOT")) == ["a3"]
    assert ids(samples.page(three, action="DENY", from_=at("10:01:00"))) == ["a2"]
    assert ids(samples.page(three, to=at("10:05:00"))) == ["a1"]
    assert ids(samples.page(three, config_id=2, category="INJECTION")) == []
    assert samples.total(three, category="INJECTION").first()["total"] == 2


def test_limits():
    assert samples.page_bounds(None, None) == (20, 0)
    assert samples.page_bounds(500, 7) == (100, 7)
    for limit, offset in [(0, 0), (-1, 0), (1, -1)]:
        with pytest.raises(ValueError):
            samples.page_bounds(limit, offset)


def test_bad_arguments(three):
    with pytest.raises(ValueError):
        samples.page(three, from_=at("10:00:00"), to=at("10:00:00"))
    with pytest.raises(ValueError):
        samples.page(three, category="SPAM")
    with pytest.raises(ValueError):
        samples.page(three, action="BLOCK")


def test_items(three):
    row = samples.items(samples.page(three, limit=1)).first()
    assert row["rule"].asDict() == {"severity": "LOW", "category": "BOT"}
    assert len(row) == 10


def test_deep_pages_equal_plain_ones(spark):
    rng = random.Random(5)
    start = at("00:00:00")
    times = [start + timedelta(milliseconds=rng.choice([rng.randrange(9_000_000), 3_600_000])) for _ in range(600)]
    rows = stored(spark, *[{"event_id": f"e{i:03d}", "timestamp": t} for i, t in enumerate(times)]).cache()
    order = [f"e{i:03d}" for i in sorted(range(600), key=lambda i: (-times[i].timestamp(), i))]
    for offset in (11, 240, 299, 450, 590, 600, 700):
        assert ids(samples.page(rows, limit=30, offset=offset, deep_offset=10)) == order[offset:offset + 30]
