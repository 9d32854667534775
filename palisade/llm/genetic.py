"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become token ids plus an end id; only those longer than ``capacity``
are cut. The pieces are dealt at random into neighbourhoods of about
``NEIGHBOURHOOD``, and each neighbourhood evolves on ``ISLANDS`` islands. An
individual is a complete packing. A crossover injects whole well-filled bins of
one parent into the other, drops the bins that hold any of those pieces, and
puts the displaced pieces back by best fit; a mutation empties the least filled
bins in the same way. After each epoch every island sends its best packing to
the next island of its neighbourhood, and the best of all islands is the result.
A neighbourhood wastes at most one open bin more than its packing must, so their
size and not the number of pieces sets how close to the least count one gets.

All random choices are seeded by neighbourhood, island and epoch: a task that
is run again gives the same rows. Null text counts as empty; every document
has at least the end id, so that empty ones give a piece of length 1. Repeated
rows and repeated doc_ids are packed as so many documents. An empty table gives
no rows. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import configure, stored
from palisade.llm.flat import Flat, slices
from palisade.llm.vocab import public, word_bpe

CAPACITY = 4096
END_ID = 1
NEIGHBOURHOOD = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
WELL_FILLED = 0.995


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(path)
        for part in coder.during(slices(batches)):
            ids, counts = coder.rows(Flat(part.column("text")))
            ids = ids.astype("<u4")
            end = np.array([end_id], "<u4").tobytes()
            row, piece, start, length, crc = [], [], [], [], []
            at = 0
            for i, n in enumerate(counts.tolist()):
                data = ids[at : at + n].tobytes() + end
                at += n
                for k in range(0, n + 1, capacity):
                    cut = data[4 * k : 4 * (k + capacity)]
                    row.append(i)
                    piece.append(k // capacity)
                    start.append(k)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _fill(items: np.ndarray, lengths: np.ndarray, bins: np.ndarray, room: list[int], capacity: int) -> None:
    """Best fit: put each item, in the given order, into the bin with the least room that holds it."""
    step = len(room)  # room: capacity left per bin, extended here
    free = sorted(r * (1 << 32) + b for b, r in enumerate(room) if 0 < r < capacity or (r == capacity and b < step))
    for i in items.tolist():
        n = int(lengths[i])
        k = bisect_left(free, n << 32)
        if k == len(free):
            b, left = len(room), capacity
            room.append(capacity)
        else:
            slot = free.pop(k)
            b, left = slot & 0xFFFFFFFF, slot >> 32
        bins[i] = b
        room[b] = left - n
        if left > n:
            insort(free, ((left - n) << 32) + b)


def _rebuild(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Close the numbering, and best-fit the items without a bin (-1), longest first."""
    placed = bins >= 0
    names, back = np.unique(bins[placed], return_inverse=True)
    out = np.full(len(bins), -1)
    out[placed] = back
    room = (capacity - np.bincount(back, lengths[placed], len(names))).astype(int).tolist()
    loose = np.flatnonzero(~placed)
    _fill(loose[np.argsort(-lengths[loose], kind="stable")], lengths, out, room, capacity)
    return out


def _score(bins: np.ndarray, lengths: np.ndarray) -> tuple[int, float]:
    fills = np.bincount(bins, lengths)
    return len(fills), -float((fills * fills).sum())


def _cross(one: np.ndarray, two: np.ndarray, lengths: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Whole well-filled bins of ``two``, then the bins of ``one`` they leave intact."""
    fills = np.bincount(two, lengths)
    full = np.flatnonzero(fills >= WELL_FILLED * capacity)
    if not len(full):
        full = np.argsort(-fills)[: max(1, len(fills) // 4)]
    chosen = np.zeros(len(fills), bool)
    chosen[rng.choice(full, max(1, len(full) // 2), replace=False)] = True
    inject = chosen[two]
    broken = np.zeros(one.max() + 1, bool)
    broken[one[inject]] = True
    child = np.where(inject, two + len(broken), np.where(broken[one], -1, one))
    return _rebuild(child, lengths, capacity)


def _mutate(bins: np.ndarray, lengths: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Empty the least filled bins and a few others."""
    fills = np.bincount(bins, lengths)
    drop = np.zeros(len(fills), bool)
    drop[np.argsort(fills, kind="stable")[: max(2, len(fills) // 20)]] = True
    drop[rng.choice(len(fills), max(1, len(fills) // 50), replace=False)] = True
    return _rebuild(np.where(drop[bins], -1, bins), lengths, capacity)


def evolve(lengths: np.ndarray, seeds: list[np.ndarray], capacity: int, rng) -> np.ndarray:
    """The best packing after an epoch on one island, starting from best-fit packings and the given ones."""
    least = -(-int(lengths.sum()) // capacity)
    people = list(seeds)
    while len(people) < POPULATION:
        bins, room = np.full(len(lengths), -1), []
        noise = 0 if not people else 0.2 * lengths.mean()
        _fill(np.argsort(-(lengths + noise * rng.random(len(lengths))), kind="stable"), lengths, bins, room, capacity)
        people.append(bins)
        if bins.max() + 1 == least:
            return bins
    people.sort(key=lambda p: _score(p, lengths))
    for _ in range(GENERATIONS):
        if people[0].max() + 1 == least:
            break
        one, two = rng.choice(len(people), 2, replace=False)
        young = [_cross(people[one], people[two], lengths, capacity, rng), _mutate(people[0], lengths, capacity, rng)]
        people = sorted([*people, *young], key=lambda p: _score(p, lengths))[:POPULATION]
    return people[0]


def _epoch(capacity: int, number: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame[frame["origin"] == 0].sort_values("uid")
        lengths = first["length"].to_numpy()
        seeds = []
        for _, part in frame.sort_values("uid").groupby("origin"):
            if (bins := part["bin"].to_numpy()).min() >= 0:
                seeds.append(np.unique(bins, return_inverse=True)[1])
        hood, island = int(frame["hood"].iloc[0]), int(frame["island"].iloc[0])
        best = evolve(lengths, seeds, capacity, np.random.default_rng([hood, island, number]))
        order = np.argsort(best, kind="stable")
        sizes = lengths[order]
        before = np.cumsum(sizes) - sizes
        new = np.ones(len(order), bool)
        new[1:] = best[order][1:] != best[order][:-1]
        offset = np.empty(len(order), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(new, before, 0))
        return pd.DataFrame({
            "hood": hood, "island": island, "uid": first["uid"].to_numpy(), "length": lengths,
            "bin": best.astype(np.int64), "offset": offset, "bins": int(best.max()) + 1,
        })

    return run


_SCHEMA = "hood long, island int, uid long, length long, bin long, offset long, bins long"


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32: the documents' ids, cut where longer than a sequence."""
    configure(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        _pieces(vocabulary or public("word_bpe_49k.json"), capacity, end_id),
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


def assign(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows uid, sequence_id, offset for items (uid, length); ``items`` is read several times."""
    hoods = max(1, -(-items.count() // NEIGHBOURHOOD))
    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(hoods)).alias("hood"))
    state = dealt.select(
        "hood", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "uid", "length",
        F.lit(-1).cast("bigint").alias("bin"), F.lit(0).alias("origin"),
    )
    for number in range(EPOCHS):
        state = stored(state.groupBy("hood", "island").applyInPandas(_epoch(capacity, number), _SCHEMA))
        if number + 1 < EPOCHS:
            own = state.select("hood", "island", "uid", "length", "bin", F.lit(0).alias("origin"))
            sent = own.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int")).withColumn("origin", F.lit(1))
            state = own.unionByName(sent)
    best = state.groupBy("hood").agg(F.min(F.struct("bins", "island")).alias("best")).select("hood", "best.island")
    return state.join(best, ["hood", "island"]).select(
        "uid", (F.col("hood") * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset"
    )


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stored(pieces(docs, vocabulary, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()))
    full = F.col("length") == capacity
    placed = assign(cut.where(~full).select("uid", "length"), capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    alone = cut.where(full).select(
        "*", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return cut.where(~full).join(placed, "uid").select(*columns).unionByName(alone.select(*columns))
