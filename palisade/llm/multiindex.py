"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors are centred, rotated so that the signs of their coordinates lose least
(iterative quantisation on a sample), and coded as those signs. A code is split
into substrings, each with its own table of buckets. Two codes within Hamming
distance r agree in some substring up to r // m bits, so looking up, per table,
the buckets within that many bits finds every code within r; these are checked
on the whole code and ranked by the float inner product, in double precision.

The radius is learned too: on the sample, the distance within which ``RECALL``
of the true neighbours lie. A query with fewer than ``k`` vectors in its radius
is searched again without one, so each gets k neighbours if there are so many.

For inner products of vectors of unequal length a coordinate is added that
makes the lengths equal; neighbours are then the same as by angle.

The index covers every vector; only rotation and radius come from a sample, of
``SAMPLE`` rows with the smallest hashes. Vectors are dealt at random to blocks
of about ``ROWS``, queries to blocks of ``QUERIES``, and each pair of blocks is
one group: a bounded task, however often one vector is repeated.

Vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do those of another dimension than most of the sample. Null ids take
no part. Of repeated rows each is a candidate. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import configure, stored

BITS = 128
SUBSTRINGS = BITS // 8
SAMPLE = 4096
RECALL = 0.985
ROWS = 16384
QUERIES = 4096
NEAREST = 20
#: Per reach, the byte values with at most so many bits: what a substring is changed by to name its probed buckets.
NEAR = [np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) <= t) for t in range(9)]


def usable(column: str = "embedding") -> Column:
    """True for vectors that can be searched."""
    v = F.col(column)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


class Codes:
    """Rotation, code length and radius learned from a sample."""

    def __init__(self, sample: np.ndarray, longest: float, k: int, seed: int = 5):
        self.longest = longest
        lifted = self._lift(sample)
        self.centre = lifted.mean(axis=0)
        centred = lifted - self.centre
        d = centred.shape[1]
        rng = np.random.default_rng(seed)
        # As many bits as a whole number of bytes holds; directions are repeated, rotated anew, where d is smaller.
        self.rotations = []
        _, vectors = np.linalg.eigh(centred.T @ centred)
        vectors = vectors[:, ::-1]
        left = BITS
        while left > 0:
            take = min(left, d)
            basis = vectors[:, :take]
            projected = centred @ basis
            turn = np.linalg.qr(rng.standard_normal((take, take)))[0]
            for _ in range(30):
                u, _, w = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
                turn = (u @ w).T
            self.rotations.append(basis @ turn)
            left -= take
        self.projection = np.concatenate(self.rotations, axis=1)
        self.radius = self._learn_radius(sample, k)

    def _lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest**2 - (x * x).sum(axis=1), 0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as bytes (n, BITS / 8); each byte is a substring."""
        return np.packbits((self._lift(x) - self.centre) @ self.projection > 0, axis=1)

    def encode_queries(self, q: np.ndarray) -> np.ndarray:
        """A query has no length of its own: it is scaled to the longest, where nothing is added."""
        scale = self.longest / np.maximum(np.sqrt((q * q).sum(axis=1, keepdims=True)), 1e-300)
        zero = np.zeros((len(q), 1))
        return np.packbits((np.concatenate([q * scale, zero], axis=1) - self.centre) @ self.projection > 0, axis=1)

    def _learn_radius(self, sample: np.ndarray, k: int) -> int:
        asked = sample[: max(1, len(sample) // 8)]
        near = asked @ sample.T
        np.fill_diagonal(near, -np.inf)
        k = min(k, len(sample) - 1)
        if k < 1:
            return BITS
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        codes, own = self.encode(sample), self.encode_queries(asked)
        distance = np.bitwise_count(codes[best] ^ own[:, None]).sum(axis=2)
        return int(np.quantile(distance, RECALL))


class Tables:
    """One table per substring of a block of codes: rows sorted by its value, and where each value's bucket begins."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes.view(np.uint64)
        self.rows = [np.argsort(codes[:, s], kind="stable").astype(np.int32) for s in range(SUBSTRINGS)]
        self.begin = [
            np.concatenate([[0], np.cumsum(np.bincount(codes[:, s], minlength=256))]) for s in range(SUBSTRINGS)
        ]

    def probe(self, query: np.ndarray, radius: int) -> np.ndarray:
        """All rows within the radius of a code: the buckets of each table that can hold one, then the whole code.

        Radius r is spread over m substrings as r = m * t + e. A code farther than t
        in the first e + 1 tables and farther than t - 1 in the others would be
        farther than r, so only those few tables are asked as far as t.
        """
        reach, rest = divmod(radius, SUBSTRINGS)
        seen = np.zeros(len(self.codes), bool)
        for s in range(SUBSTRINGS):
            within = reach if s <= rest else reach - 1
            if within >= 0:
                for value in NEAR[min(within, 8)] ^ int(query[s]):
                    seen[self.rows[s][self.begin[s][value] : self.begin[s][value + 1]]] = True
        found = np.flatnonzero(seen)
        apart = np.bitwise_count(self.codes[found] ^ query.view(np.uint64)).sum(axis=1)
        return found[apart <= radius]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _search(model: Codes, radius: int, k: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids = table.column("vec_id").to_numpy()
        vectors = _matrix(table.column("embedding"))
        q, x = vectors[asks], vectors[~asks]
        q_ids, x_ids = ids[asks], ids[~asks]
        out = []
        if len(q) and len(x):
            tables, own = Tables(model.encode(x)), model.encode_queries(q)
            for at, code in enumerate(own):
                row = tables.probe(code, radius)
                row = row[x_ids[row] != q_ids[at]]
                score = np.einsum("ij,j->i", x[row], q[at])
                best = np.lexsort((x_ids[row], -score))[:k]
                out.append((np.full(len(best), q_ids[at]), x_ids[row[best]], score[best]))
        parts = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    return run


def fit(rows: DataFrame, k: int) -> tuple[Codes, int] | None:
    """The codes for usable rows (vec_id, embedding), and the dimension they take."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    if not len(sample):
        return None
    sizes = [len(v) for v in sample]
    dimension = max(set(sizes), key=sizes.count)
    longest = rows.where(F.size("embedding") == dimension).agg(F.max(length)).first()[0]
    return Codes(np.array([v for v in sample if len(v) == dimension], np.float64), longest, k), dimension


def search(vectors: DataFrame, queries: Column, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row for which ``queries`` holds."""
    spark = configure(vectors.sparkSession)
    rows = vectors.where(F.col("vec_id").isNotNull() & usable()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), queries.alias("asks")
    )
    learned = fit(rows, k)
    empty = "query_id long, vec_id long, score double"
    if learned is None:
        found = spark.createDataFrame([], empty)
    else:
        model, dimension = learned
        rows = rows.where(F.size("embedding") == dimension)
        found = stored(_run(rows, rows.where("asks"), model, model.radius, k))
        if model.radius < BITS:
            # Whoever has too few neighbours in the radius asks all rows.
            full = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
            rest = stored(rows.where("asks").join(full, "vec_id", "left_anti"))
            again = _run(rows, rest, model, BITS, k)
            found = found.join(rest.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _run(rows: DataFrame, asking: DataFrame, model: Codes, radius: int, k: int) -> DataFrame:
    n, q = rows.count(), asking.count()
    blocks, parts = max(1, -(-n // ROWS)), max(1, -(-q // QUERIES))
    if not q:
        parts = 1
    deal = lambda salt, m: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = rows.select("vec_id", "embedding", F.lit(False).alias("asks"), deal(1, blocks).alias("block"), each(parts).alias("part"))
    asked = asking.select("vec_id", "embedding", F.lit(True).alias("asks"), deal(2, parts).alias("part"), each(blocks).alias("block"))
    return held.unionByName(asked).groupBy("block", "part").applyInArrow(
        _search(model, radius, k), "query_id long, vec_id long, score double"
    )
