"""Shared folder, written tables and connected components."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python tasks take whole texts in batches of about 2 MB.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
    "spark.sql.session.timeZone": "UTC",
    # What a finished step shuffled is not read again: its result is in the shared folder.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

EDGE = "a long, b long"
#: Edges that a task joins at a time.
HELD_EDGES = 500_000


@cache
def _ship(application: str) -> None:
    """Give Python workers this package, whatever folder they start in; once per application."""
    spark = SparkSession.getActiveSession()
    package = Path(__file__).resolve().parent.parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='palisade-code-')}/palisade", "zip", package.parent, package.name
    )
    spark.sparkContext.addPyFile(archive)


def configure(spark: SparkSession) -> SparkSession:
    """Settings the Python tasks rely on, and the package on the workers' path."""
    _ship(spark.sparkContext.applicationId)
    for key, value in ARROW_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="palisade-llm-")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``.

    A local session without the setting, as in tests, gets a folder of its own;
    a cluster without it has no shared place, which is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """The rows written to the shared folder and read back, which cuts their lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size(text: Column | str = "text") -> Column:
    """Words of a text, counted without building them: spots where a word begins."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join each vertex of the given ones to the smallest it is connected to by them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    least = np.arange(len(ids))
    while len(left):
        low, high = np.minimum(left, right), np.maximum(left, right)
        np.minimum.at(least, high, low)
        while (further := least[least] != least).any():
            least[further] = least[least[further]]
        left, right = least[left], least[right]
        apart = left != right
        left, right = left[apart], right[apart]
    out = np.flatnonzero(least < np.arange(len(ids)))
    return ids[out], ids[least[out]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as forests, about ``HELD_EDGES`` at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return forest(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")))
        count += batch.num_rows
        if count > HELD_EDGES:
            a, b = joined()
            if 2 * len(a) > HELD_EDGES:
                yield rows(a, b)
                held, count = [], 0
            else:
                held, count = [(a, b)], len(a)
    if count:
        yield rows(*joined())


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id per vertex: (id, component) of the vertices in edges (a, b).

    Alternates joining each vertex's larger neighbours, then its smaller ones,
    to the smallest vertex around it until nothing changes. Each step is one
    grouping by vertex with partial minima; the edge set never grows, and the
    rounds are logarithmic in the length of the longest chain. Before a round,
    each task makes its own edges a forest, so chains within a task take no
    round: every round costs the driver some dozen stages, however few the edges.
    """
    configure(edges.sparkSession)
    step = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .mapInArrow(_forests, EDGE)
    )
    before = _mark(step)
    while True:
        both = step.unionByName(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).where("a <> b").distinct()
        large = stored(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        ).distinct()
        # Stars that nothing changes are the same edges as forests.
        step = stored(small.mapInArrow(_forests, EDGE))
        now = _mark(step)
        if now == before:
            break
        before = now
    roots = step.select("a", "b")
    return roots.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        roots.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
