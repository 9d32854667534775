"""Connected components: results against a plain search, and how many steps they take."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from palisade.llm import common


def plain(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            if (at := todo.pop()) not in found:
                found[at] = start
                todo += near[at]
    return found


def tangle(seed):
    """A long chain in random order, stars, pairs, and a sparse random part."""
    rng = random.Random(seed)
    ids = list({rng.randrange(-(1 << 62), 1 << 62) for _ in range(1600)})[:1500]
    rng.shuffle(ids)
    chain = list(zip(ids[:599], ids[1:600]))
    stars = [(ids[600 + 100 * k], ids[600 + 100 * k + j]) for k in range(4) for j in range(1, 90)]
    return chain + stars + [(rng.choice(ids[1000:]), rng.choice(ids[1000:])) for _ in range(250)]


def run(spark, edges, parts):
    found = common.components(spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()
    assert len({r.id for r in found}) == len(found)
    return {r.id: r.component for r in found}


def test_components_are_those_of_a_plain_search(spark):
    for seed, parts in ((1, 1), (2, 7)):
        edges = tangle(seed)
        loops = [(5, 5), (6, 6)] + [(None, 7), (8, None)]
        assert run(spark, edges + edges[:50] + loops, parts) == plain([e for e in edges if e[0] != e[1]])
    assert run(spark, [(3, 3)], 1) == {}


def test_chains_within_a_task_take_no_round(spark, monkeypatch):
    written, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda *a, **b: written.append(1) or stored(*a, **b))
    edges = tangle(3)
    assert run(spark, edges, 1) == plain([e for e in edges if e[0] != e[1]])
    assert len(written) <= 3


def test_a_task_holds_few_edges_at_a_time(monkeypatch):
    edges = [e for e in tangle(4) if e[0] != e[1]]
    for held in (1, 40, 300, 10_000):
        monkeypatch.setattr(common, "HELD_EDGES", held)
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*edges[k : k + 30])], ["a", "b"]) for k in range(0, len(edges), 30)]
        out = list(common._forests(iter(batches)))
        rows = [r for x in out for r in zip(x.column("a").to_pylist(), x.column("b").to_pylist())]
        assert plain(rows) == plain(edges) and len(rows) <= len(edges) and all(a > b for a, b in rows)
    a, b = common.forest(np.array([], np.int64), np.array([], np.int64))
    assert len(a) == len(b) == 0
