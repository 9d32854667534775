"""Whitening against plain arithmetic on whole numbers, on awkward vectors and on nothing at all."""

from __future__ import annotations

import random
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from palisade.llm import whitening

KIND = "vec_id long, embedding array<float>, label int, n string, x string"


def plain(rows):
    """x-vectors, exact covariance as floats, deviations."""
    x = [[floor(64 * c) + 1_000_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    q = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    v = [[float(Fraction(sum(r[i] * r[j] for r in q), n**3)) for j in range(d)] for i in range(d)]
    return x, np.array(v), [sum(c * c for c in r) for r in q], sums


def frame(spark, vectors, parts=3):
    rows = [(i, v, i % 2, "clash", None) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, KIND).repartition(parts)


def some(n=60, d=5, seed=2):
    rng = random.Random(seed)
    return [[float(np.float32(rng.gauss(0, 1) * (k + 1) + (k == 2) * 5)) for k in range(d)] for _ in range(n)]


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e12])
def test_covariances_are_exact_and_rows_are_white(spark, scale):
    vectors = [[float(np.float32(c * scale)) for c in v] for v in some()] * 2
    awkward = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf")] + [0.0] * 4, [1.0, 2.0], [3e38] + [0.0] * 4]
    data = frame(spark, vectors + awkward)
    x, v, deviations, sums = plain(vectors)
    model = whitening.fit(whitening.whole(data))
    assert (model.covariance == v).all() and model.sums == sums and model.n == len(vectors)
    found = {}
    for r in whitening.by_component(whitening.whiten(data)).collect():
        found.setdefault(r.vec_id, []).append(r)
    assert sorted(found) == list(range(len(vectors)))
    y = np.array([[c.whitened for c in sorted(found[i], key=lambda r: r.component)] for i in range(len(vectors))])
    assert np.abs(y.T @ y / len(y) - np.eye(5)).max() < 1e-8
    for i, rows in found.items():
        fits = deviations[i] if deviations[i] < 1 << 63 else None
        assert {r.deviation for r in rows} == {fits} and {r.n for r in rows} == {len(vectors)}
        assert rows[0].identity_error < 1e-8
    values, basis = np.linalg.eigh(v)
    share = [r.explained for r in sorted(found[0], key=lambda r: r.component)]
    assert share == pytest.approx((values[::-1] / np.trace(v)).tolist(), rel=1e-9)
    centred = np.array([[float(Fraction(c) - Fraction(s, len(x))) for c, s in zip(r, sums)] for r in x])
    expected = centred @ basis[:, ::-1] / np.sqrt(values[::-1])
    assert np.abs(np.abs(y) - np.abs(expected)).max() < 1e-6


def test_deviations_pass_64_bits_as_null_and_stay_exact_below(spark):
    vectors = [[0.0, 0.0], [1.0, -1.0], [2.0**40, 2.0**41]] * 3
    rows = whitening.whiten(frame(spark, vectors)).collect()
    _, _, deviations, _ = plain(vectors)
    assert {r.vec_id: r.deviation for r in rows} == {i: d if d < 1 << 63 else None for i, d in enumerate(deviations)}
    wide = whitening.fit(whitening.whole(frame(spark, vectors)))
    assert wide.deviations(np.array([[1_000_000 + (1 << 58)] * 2])) == [None]


def test_alike_vectors_have_no_white_components(spark):
    rows = whitening.by_component(whitening.whiten(frame(spark, [[0.5, 0.25, 1.0]] * 4))).collect()
    assert len(rows) == 12 and all(r.whitened is None and r.explained == 0 and r.identity_error == 0 and r.deviation == 0 for r in rows)
    one = whitening.whiten(frame(spark, [[0.5, 0.25]])).collect()
    assert len(one) == 1 and one[0].whitened == [None, None]
    # Fewer rows than dimensions: the rest do not vary.
    few = whitening.whiten(frame(spark, some(n=3, d=6))).collect()
    assert all([c is None for c in r.whitened] == [False, False, True, True, True, True] for r in few)
    assert few[0].identity_error < 1e-8


def test_components_are_limited_and_ids_kept(spark):
    vectors = some(n=50, d=40, seed=5)
    rows = [(None if i == 7 else i % 3, v, 0, "", "") for i, v in enumerate(vectors)]
    found = whitening.by_component(whitening.whiten(spark.createDataFrame(rows, KIND))).collect()
    assert len(found) == 50 * 32 and {r.component for r in found} == set(range(1, 33))
    assert sum(r.vec_id is None for r in found) == 32


def test_nothing_gives_nothing(spark):
    assert whitening.by_component(whitening.whiten(spark.createDataFrame([], KIND))).collect() == []
    assert whitening.whiten(frame(spark, [None, [], [None]])).collect() == []
