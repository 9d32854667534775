"""Whitening of embeddings, with every covariance recovered from variances (polarisation).

Components become whole numbers: x = floor(64 c) + 1000000. With z = x - m, m the
floor of the mean, the centred value of one dimension or of the sum of two is
q / n, q = n z - r, where r = S - n m is what the floor left over. As z sums to r,
sum q^2 = n^2 sum z^2 - n r^2: tasks add up whole squares of z for every dimension
and every sum of two dimensions, and the exact sums of squared centred values
follow. cov(i, j) is half of var(i + j) - var(i) - var(j), a quotient of whole
numbers rounded once. The matrix has the size of the dimension squared,
whatever the number of rows; ``eigh`` decomposes it on the driver.

Tasks send sums as limbs of ``LIMB`` bits, so nothing overflows; values too large
for 64-bit products take Python integers.

Rows whose vector is null, empty, or holds null or non-finite entries, or
entries whose x does not fit ``BITS`` bits, have no result, nor have rows of
another length than the commonest one (of equally common ones the
shortest). A null vec_id is kept as it is, repeated rows count and return as
often as they occur, and other columns are not read. ``deviation`` is null where
it passes 64 bits. A component along which nothing varies (all rows alike, or fewer
rows than dimensions) has a null ``whitened``, and ``identity_error`` is over the
others, 0 where there are none. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import configure

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
BITS = 60
LIMB = 48
LIMBS = 4
#: Up to this size, squares of sums of two values add up in 64 bits over a block of rows.
_NARROW = 1 << 20
_BLOCK = 4096
_MASK = (1 << LIMB) - 1


def whole(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x, the whole-number vector, of the rows that take part."""
    v = F.col(vector)
    scaled = lambda c: c.cast("double") * SCALE
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(scaled(c)) < float(1 << BITS))
    usable = vectors.where(F.coalesce((F.size(v) > 0) & F.forall(v, fits), F.lit(False)))
    return usable.select("vec_id", F.transform(v, lambda c: F.floor(scaled(c)) + SHIFT).cast("array<bigint>").alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _limbs(total: int) -> list[int]:
    """A whole number as limbs, the last with the sign."""
    return [*((total >> (LIMB * k)) & _MASK for k in range(LIMBS - 1)), total >> (LIMB * (LIMBS - 1))]


def _joined(limbs: list[int]) -> int:
    return sum(int(part) << (LIMB * k) for k, part in enumerate(limbs))


def _summed(rows: DataFrame, dimension: int, add: Callable[[list[int], np.ndarray], None], width: int) -> list[int]:
    """Sums of ``width`` whole numbers over all rows; ``add`` adds the rows of a matrix to a list of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * width
        for batch in batches:
            if batch.num_rows:
                add(totals, _matrix(batch.column("x")))
        parts = np.array([_limbs(t) for t in totals], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width)), *(pa.array(parts[:, k]) for k in range(LIMBS))],
            ["place", *(f"limb{k}" for k in range(LIMBS))],
        )

    sent = rows.where(F.size("x") == dimension).select("x").mapInArrow(
        run, "place long, " + ", ".join(f"limb{k} long" for k in range(LIMBS))
    )
    added = sent.groupBy("place").agg(*[F.sum(F.col(f"limb{k}").cast("decimal(38,0)")).alias(f"limb{k}") for k in range(LIMBS)])
    out = [0] * width
    for row in added.collect():
        out[row["place"]] = _joined(row[1:])
    return out


def _add_sums(totals: list[int], x: np.ndarray) -> None:
    # High and low halves apart, so that a batch of large values stays within 64 bits.
    low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
    for i, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
        totals[i] += a + (b << 32)


def _add_squares(floor: np.ndarray) -> Callable[[list[int], np.ndarray], None]:
    """Adds z_i^2 per dimension, then (z_i + z_j)^2 per pair i < j in order."""
    d = len(floor)

    def add(totals: list[int], x: np.ndarray) -> None:
        z = x - floor
        wide = (np.abs(z) >= _NARROW).any(axis=1)
        for part in (z[~wide], z[wide].astype(object)):
            for at in range(0, len(part), _BLOCK):
                block = np.ascontiguousarray(part[at : at + _BLOCK].T)
                place = d
                for i in range(d):
                    totals[i] += int((block[i] * block[i]).sum())
                    if i + 1 < d:
                        both = block[i + 1 :] + block[i]
                        sums = np.einsum("ij,ij->i", both, both) if both.dtype != object else (both * both).sum(axis=1)
                        for value in sums.tolist():
                            totals[place] += int(value)
                            place += 1

    return add


@dataclass(frozen=True)
class Whitening:
    """Mean and components of a fit list, and its exact covariance as floats."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def floor(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        return [s % self.n for s in self.sums]

    @property
    def varies(self) -> np.ndarray:
        """Which components have a variance beyond rounding."""
        return self.values > self.values.max(initial=0) * len(self.values) * np.finfo(float).eps

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - np.array(self.rest, np.float64) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue, for the components that vary; nan for the others."""
        root = np.where(self.varies, np.sqrt(np.maximum(self.values, 0)), np.nan)
        return self.centred(x) @ self.vectors / root

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, None beyond 64 bits."""
        z, rest = x - self.floor, self.rest
        most = (int(np.abs(z).max(initial=0)) + 1) * self.n
        if len(rest) * most * most < 1 << 62:
            q = z * self.n - np.array(rest, np.int64)
            return (q * q).sum(axis=1).tolist()
        kind = object if int(np.abs(z).max(initial=0)) ** 2 * len(rest) >= 1 << 62 else np.int64
        squares = (z.astype(kind) ** 2).sum(axis=1).tolist()
        mixed = z.astype(object) @ np.array(rest, object)
        fixed = sum(r * r for r in rest)
        found = (self.n * self.n * int(s) - 2 * self.n * int(t) + fixed for s, t in zip(squares, mixed.tolist()))
        return [v if v < 1 << 63 else None for v in found]


def covariance(n: int, sums: list[int], squares: list[int]) -> np.ndarray:
    """The matrix of all covariances (divisor n) from sums and from squares in the order of ``_add_squares``."""
    d = len(sums)
    rest = [s % n for s in sums]
    spread = lambda total, r: n * total - r * r  # n times the sum of squared centred values
    own = [spread(squares[i], rest[i]) for i in range(d)]
    out = np.empty((d, d))
    place = d
    for i in range(d):
        out[i, i] = float(Fraction(own[i], n * n))
        for j in range(i + 1, d):
            both = spread(squares[place], rest[i] + rest[j])
            out[i, j] = out[j, i] = float(Fraction(both - own[i] - own[j], 2 * n * n))
            place += 1
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the rows of ``whole``; None where there are none."""
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if common is None:
        return None
    d, n = common["d"], common["count"]
    sums = _summed(rows, d, _add_sums, d)
    floor = np.array([s // n for s in sums], np.int64)
    squares = _summed(rows, d, _add_squares(floor), d + d * (d - 1) // 2)
    matrix = covariance(n, sums, squares)
    values, vectors = np.linalg.eigh(matrix)
    kept = slice(None, -min(components, d) - 1, -1)
    return Whitening(n, sums, matrix, values[kept], vectors[:, kept])


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on all of them."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(model)
    k = int(model.varies.sum())
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        varies = model.varies
        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                y = model.whiten(_matrix(batch.column("x")))[:, varies]
                products += y.T @ y
                sums += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k * k + k)), pa.array(np.concatenate([products.ravel(), sums]))], ["place", "total"]
        )

    sent = rows.where(F.size("x") == len(model.sums)).select("x").mapInArrow(run, "place long, total double")
    totals = np.zeros(k * k + k)
    for row in sent.groupBy("place").agg(F.sum("total").alias("total")).collect():
        totals[row["place"]] = row["total"]
    products, mean = totals[: k * k].reshape(k, k) / model.n, totals[k * k :] / model.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vec_id, n, deviation, whitened (array, largest component first), explained (array), identity_error."""
    spark = configure(vectors.sparkSession)
    rows = whole(vectors, vector)
    identity = vectors.schema["vec_id"].dataType.simpleString()
    kind = f"vec_id {identity}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    model = fit(rows, components)
    if model is None:
        return spark.createDataFrame([], kind)
    error = identity_error(rows, model)
    held = spark.sparkContext.broadcast(model)
    total = float(np.trace(model.covariance))
    explained = (model.values / total if total else np.zeros(len(model.values))).clip(0).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            y = model.whiten(x)
            offsets = np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)
            flat = y.ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), pa.array(model.deviations(x), pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=np.isnan(flat))),
            ], ["vec_id", "deviation", "whitened"])

    made = rows.where(F.size("x") == len(model.sums)).mapInArrow(run, f"vec_id {identity}, deviation long, whitened array<double>")
    return made.select(
        "vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(v) for v in explained]).alias("explained"), F.lit(error).alias("identity_error"),
    )


def by_component(whitened: DataFrame) -> DataFrame:
    """A row per vector and component, numbered from 1."""
    return whitened.select(
        "vec_id", "n", "deviation", F.posexplode("whitened").alias("place", "value"), "explained", "identity_error"
    ).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", F.col("value").alias("whitened"),
        F.element_at("explained", F.col("place") + 1).alias("explained"), "identity_error",
    )
