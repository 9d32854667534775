"""Exact substring deduplication over suffix arrays built by Lyndon grouping.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier
(in a document of smaller id, or earlier in the same one). No suffix array of
all documents is built; equal strings are first brought together:

1. Every string of ``LENGTH`` bytes holds an anchor, the place of its smallest
   16-gram hash, and equal strings hold equal anchors at equal places. An
   anchor's context is all bytes that a string around it can reach.
2. Contexts meet by anchor. Of equal contexts all but the first are repeats
   throughout. An anchor with one context is done.
3. The different contexts of an anchor, each once, form small texts whose
   suffix array ``suffix_order`` builds; neighbours in it that agree in
   ``LENGTH`` bytes are equal strings, the first of which stays.

``suffix_order`` takes suffixes in groups of equal Lyndon prefix. A suffix whose
next suffix lies in a lower group has its whole Lyndon prefix; its previous
smaller ones then grow by it, highest groups moving first, until none can grow.
Each group's own order is that of the suffixes behind the Lyndon prefixes,
which are smaller and so already in place: no text is renamed or recursed on.

Anchors with many different contexts (boilerplate in ever new surroundings)
are split into blocks; every two blocks meet in a task of bounded size.

Null text counts as empty, and as every text under ``LENGTH`` bytes loses
nothing. Rows of one doc_id are taken for one document: repeated rows do not
remove each other, and each gets the same result. Rows without doc_id lose
nothing. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import configure, stored
from palisade.llm.flat import BYTE_VALUES, Flat, mix, powers, slices, within

LENGTH = 100
GRAM = 16
REACH = LENGTH - GRAM  # an anchor lies at most so far into a string
#: Contexts of one anchor in a block, and bytes of contexts in one suffix array.
BLOCK = 4096
SHARD_BYTES = 1_500_000


def anchors(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are smallest in some string of LENGTH bytes of a row."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(flat.bytes) < LENGTH:
        return none
    grams, factor, width = BYTE_VALUES[flat.bytes], 0x9E3779B97F4A7C15, 1
    while width < GRAM:
        grams = grams[:-width] * np.uint64(factor) + grams[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    grams = mix(grams)
    span = REACH + 1
    least, width = grams, 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    n = len(flat.bytes) - LENGTH + 1
    least = np.minimum(least[:n], least[span - width : span - width + n])
    sizes = np.diff(flat.offsets)
    valid = np.zeros(n + 1, np.int32)
    long = sizes >= LENGTH
    np.add.at(valid, flat.offsets[:-1][long], 1)
    np.add.at(valid, np.minimum(flat.offsets[1:][long] - LENGTH + 1, n), -1)
    valid = np.cumsum(valid[:-1]) > 0
    # Along a stretch of strings with one smallest hash, its leftmost places are those that are
    # smallest in the string they begin, and the one of the stretch's last string.
    last = valid.copy()
    last[:-1] &= (least[1:] != least[:-1]) | ~valid[1:]
    starts = np.flatnonzero(last)
    place = np.empty(len(starts), np.int64)
    for at in range(0, len(starts), 4096):
        some = starts[at : at + 4096]
        place[at : at + 4096] = some + grams[some[:, None] + np.arange(span)].argmin(axis=1)
    place = np.unique(np.concatenate([place, np.flatnonzero(valid & (grams[:n] == least))]))
    return place, grams[place]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts (h, c, doc, low, size, left), each once per slice; what a slice repeats goes as spans (left -1)."""
    for part in slices(batches):
        flat = Flat(part.column("text"))
        place, grams = anchors(flat)
        row = np.searchsorted(flat.offsets, place, side="right") - 1
        begin, end = flat.offsets[row], flat.offsets[row + 1]
        low, high = np.maximum(place - REACH, begin), np.minimum(place + LENGTH, end)
        context = mix(flat.hashes(low, high) + (place - low).astype(np.uint64))
        doc = part.column("doc_id").to_numpy(zero_copy_only=False)[row].astype(np.int64)
        size, left, low = high - low, place - low, low - begin
        order = np.lexsort((low, doc, context, grams))
        head = np.ones(len(order), bool)
        head[1:] = (grams[order][1:] != grams[order][:-1]) | (context[order][1:] != context[order][:-1])
        first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        again = order[~head & ((doc[order] != doc[first]) | (low[order] != low[first])) & (size[order] >= LENGTH)]
        first = order[head]
        again = again[np.lexsort((low[again], doc[again]))]
        key, spot, reach = _merged(doc[again], low[again], low[again] + size[again])
        spread = mix(key.view(np.uint64) ^ spot.astype(np.uint64)).view(np.int64)
        both = lambda x, y: pa.array(np.concatenate([x, y]))
        yield pa.RecordBatch.from_arrays([
            both(grams[first].view(np.int64), spread), both(context[first].view(np.int64), spread),
            both(doc[first], key), both(low[first], spot), both(size[first].astype(np.int64), reach - spot),
            both(left[first].astype(np.int32), np.full(len(key), -1, np.int32)),
        ], ["h", "c", "doc", "low", "size", "left"])


def _merged(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order of (key, low), with those that touch made one."""
    if not len(key):
        return key, low, high
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    # Raised by key, ends can only grow from one key to the next.
    rank = np.cumsum(new) - 1
    lift = rank * (int(high.max()) + 1)
    reach = np.maximum.accumulate(high + lift)
    new[1:] |= low[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(key)) - 1
    return key[at], low[at], reach[last] - lift[at]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (h, c, doc, low): spans of repeated contexts (h null), and contexts to compare.

    The first context of an anchor is held back until a second one shows up.
    """
    names = ["h", "c", "doc", "low", "size", "left"]

    def pack(asks: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
        both = np.concatenate([asks, spans])
        return pa.RecordBatch.from_arrays([
            pa.array(both[:, 0], pa.int64(), mask=np.arange(len(both)) >= len(asks)),
            *(pa.array(both[:, k], pa.int64()) for k in (2, 3, 4)), pa.array(both[:, 5].astype(np.int32)),
        ], ["h", "doc", "low", "size", "left"])

    lead = held = None  # first row of the running context; first row of the running anchor, if still held back
    for part in batches:
        if not part.num_rows:
            continue
        rows = np.stack([part.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names], axis=1)
        ready = rows[rows[:, 5] < 0]
        rows = rows[rows[:, 5] >= 0]
        if not len(rows):
            yield pack(rows, ready)
            continue
        head = 0 if lead is None else 1
        if head:
            rows = np.concatenate([lead[None], rows])
        index = np.arange(len(rows))
        anchor = np.ones(len(rows), bool)
        anchor[1:] = rows[1:, 0] != rows[:-1, 0]
        context = anchor.copy()
        context[1:] |= rows[1:, 1] != rows[:-1, 1]
        first = np.maximum.accumulate(np.where(context, index, 0))
        same = (rows[:, 2] == rows[first, 2]) & (rows[:, 3] == rows[first, 3])
        repeat = (index != first) & ~same & (rows[:, 4] >= LENGTH)
        start = np.maximum.accumulate(np.where(anchor, index, 0))
        further = context & (index != start)  # a second or later context of its anchor
        opening = np.zeros(len(rows), bool)
        opening[start[further]] = True
        ask = [rows[further | (opening & (index >= head))]]
        if head and opening[0] and held is not None:
            ask.append(held[None])
        tail = start[-1]
        if tail == 0 and head:
            held = None if opening[0] else held
        else:
            held = None if opening[tail] else rows[tail].copy()
        lead = rows[first[-1]].copy()
        yield pack(np.concatenate(ask), np.concatenate([rows[repeat], ready]))


def suffix_order(text: np.ndarray, ends: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Group numbers that order the suffixes of several strings by their first ``depth`` symbols.

    ``text`` holds the strings one after the other, symbols from 1, each closed
    by a 0 at ``ends``. Suffixes with equal number agree as far as the depth or
    the end of both; otherwise numbers order as the suffixes do. A number is the
    place at which the group begins in the suffix array.
    """
    n = len(text)
    symbols = np.bincount(text)
    group = (np.cumsum(symbols) - symbols)[text].astype(np.int64)
    size = np.zeros(n, np.int64)
    size[np.cumsum(symbols)[symbols > 0] - symbols[symbols > 0]] = symbols[symbols > 0]
    after = np.arange(1, n + 1)  # the suffix behind the Lyndon prefix found so far
    after[ends] = ends
    settled = np.zeros(n, bool)  # the Lyndon prefix is complete
    settled[ends] = True
    growing = np.flatnonzero(~settled)
    while len(growing):
        behind = group[after[growing]]
        complete = behind < group[growing]
        rest, key = growing[~complete], behind[~complete]
        own = group[rest]
        grown = settled[after[rest]]
        order = np.argsort((own << 32) | key)
        rest_o, own_o, key_o = rest[order], own[order], key[order]
        if len(rest_o):
            outer = np.ones(len(rest_o), bool)
            outer[1:] = own_o[1:] != own_o[:-1]
            inner = outer.copy()
            inner[1:] |= key_o[1:] != key_o[:-1]
            at = np.flatnonzero(outer)
            many = np.diff(np.append(at, len(rest_o)))
            # Suffixes with complete prefixes stay at the low end of their group.
            low = own_o[at] + size[own_o[at]] - many
            block = np.cumsum(outer) - 1
            place = low[block] + np.arange(len(rest_o)) - at[block]
            inner_at = np.flatnonzero(inner)
            number = place[inner_at]
            size[own_o[at]] -= many
            size[number] = np.diff(np.append(inner_at, len(rest_o)))
            group[rest_o] = number[np.cumsum(inner) - 1]
            # The previous smaller suffix takes in a complete Lyndon word behind it.
            take = rest[grown]
            after[take] = after[after[take]]
        settled[growing[complete]] = True
        growing = rest
    # Within a group: the order of the suffixes behind, which are smaller.
    tied = np.flatnonzero(size[group] > 1)
    tied = tied[text[tied] > 0]
    while True:
        tied = tied[size[group[tied]] > 1]
        deep = (after[tied] - tied < depth) & (after[after[tied]] != after[tied])
        marked = np.zeros(n, bool)
        marked[group[tied[deep]]] = True
        members = tied[marked[group[tied]]]
        if not len(members):
            return group
        key, own = group[after[members]], group[members]
        order = np.argsort((own << 32) | key)
        members, own, key = members[order], own[order], key[order]
        outer = np.ones(len(members), bool)
        outer[1:] = own[1:] != own[:-1]
        inner = outer.copy()
        inner[1:] |= key[1:] != key[:-1]
        at, inner_at = np.flatnonzero(outer), np.flatnonzero(inner)
        number = (own[at][np.cumsum(outer) - 1] + np.arange(len(members)) - at[np.cumsum(outer) - 1])[inner_at]
        size[number] = np.diff(np.append(inner_at, len(members)))
        group[members] = number[np.cumsum(inner) - 1]
        after[members] = after[after[members]]


def narrowed(data: np.ndarray, sizes: np.ndarray, left: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each context that can hold a string it shares with another of its key: start and size.

    A string that begins HALF or more bytes before the anchor holds the HALF
    bytes before it, any other the LENGTH - HALF bytes from it on. Contexts that
    share neither with another of their key come out empty.
    """
    half = REACH // 2
    begin = np.cumsum(sizes) - sizes
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[data] * _powers(len(data) + 1)[1:])])
    inverse = _inverse_powers(len(data) + 1)
    anchor = begin + left

    def shared(start: np.ndarray, end: np.ndarray, has: np.ndarray) -> np.ndarray:
        value = mix((sums[end[has]] - sums[start[has]]) * inverse[start[has]]) ^ keys[has]
        _, back, count = np.unique(value, return_inverse=True, return_counts=True)
        out = np.zeros(len(has), bool)
        out[has] = count[back] > 1
        return out

    early = shared(np.maximum(anchor - half, 0), anchor + GRAM, left >= half)
    late = shared(anchor, np.minimum(anchor + LENGTH - half, len(data)), sizes - left >= LENGTH - half)
    start = np.where(early, 0, np.maximum(left - half, 0))
    end = np.where(late, sizes, np.minimum(left + LENGTH - half, sizes))
    return start, np.where(early | late, np.maximum(end - start, 0), 0)


def repeats(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings of LENGTH bytes that start earlier too, among contexts (bytes ``data``; document, start).

    Returns the context and the offset in it of each.
    """
    ends = np.cumsum(sizes + 1) - 1
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.zeros(len(data) + len(sizes), np.int64)
    inner = np.ones(len(text), bool)
    inner[ends] = False
    text[inner] = data.astype(np.int64) + 1
    group = suffix_order(text, ends)
    row, place = within(np.maximum(sizes - LENGTH + 1, 0))
    starts = (ends - sizes)[row] + place
    # Only neighbours in the suffix array can be equal; equal they are if their LENGTH bytes are.
    order = np.argsort(group[starts])
    starts, row, place = starts[order], row[order], place[order]
    values = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[np.maximum(text - 1, 0)] * _powers(len(text)))])
    # Compared by position-free hashes of the strings, and by the order itself.
    hashed = mix((values[starts + LENGTH] - values[starts]) * _inverse_powers(len(text))[starts])
    new = np.ones(len(starts), bool)
    new[1:] = hashed[1:] != hashed[:-1]
    # The first of equal strings is that with the least document and start, as one number.
    if not len(starts):
        return row, place
    spot = (np.unique(ids, return_inverse=True)[1][row] << 40) + lows[row] + place
    first = np.minimum.reduceat(spot, np.flatnonzero(new))
    later = spot != first[np.cumsum(new) - 1]
    return row[later], place[later]


def _powers(n: int) -> np.ndarray:
    return powers(max(16, int(n).bit_length()))[0][:n]


def _inverse_powers(n: int) -> np.ndarray:
    return powers(max(16, int(n).bit_length()))[1][:n]


def _spans(rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive strings of a context as byte spans: context, start, end."""
    order = np.lexsort((places, rows))
    rows, places = rows[order], places[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (places[1:] > places[:-1] + LENGTH)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(rows)) - 1
    return rows[at], places[at], places[last] + LENGTH if len(at) else places[at]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in order of (h, i, j); whole keys are gathered to suffix arrays of a bounded size."""

    def work(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        sizes = table.column("size").to_numpy().astype(np.int64)
        ids, lows = table.column("doc").to_numpy(), table.column("low").to_numpy()
        data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
        keys = mix(table.column("h").to_numpy().view(np.uint64) + mix(
            (table.column("i").to_numpy().astype(np.uint64) << np.uint64(32)) + table.column("j").to_numpy().astype(np.uint64)
        ))
        start, kept = narrowed(data, sizes, table.column("left").to_numpy().astype(np.int64), keys)
        fine = kept >= LENGTH
        which, place = within(kept[fine])
        data = data[(np.cumsum(sizes) - sizes + start)[fine][which] + place]
        ids, lows, sizes = ids[fine], (lows + start)[fine], kept[fine]
        row, start, end = _spans(*repeats(data, sizes, ids, lows))
        return pa.RecordBatch.from_arrays([
            pa.array(ids[row]), pa.array(lows[row] + start), pa.array((end - start).astype(np.int64)),
        ], ["doc", "low", "size"])

    pending, held, key = [], 0, None
    for part in batches:
        if not part.num_rows:
            continue
        keys = np.stack([part.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("h", "i", "j")], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        if key is not None and (keys[0] != key).any():
            cuts = np.concatenate([[0], cuts])
        sizes = np.cumsum(part.column("size").to_numpy().astype(np.int64))
        at = 0
        for cut in cuts.tolist():
            total = held + int((sizes[cut - 1] if cut else 0) - (sizes[at - 1] if at else 0))
            if total >= SHARD_BYTES:
                pending.append(part.slice(at, cut - at))
                yield work([p for p in pending if p.num_rows])
                pending, held, at = [], 0, cut
        rest = part.slice(at)
        pending.append(rest)
        held += int(sizes[-1] - (sizes[at - 1] if at else 0))
        key = keys[-1]
    if any(p.num_rows for p in pending):
        yield work([p for p in pending if p.num_rows])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the asked contexts of each document."""
    for part in slices(batches):
        flat = Flat(part.column("text"))
        asks = part.column("asks")
        counts = np.diff(asks.offsets.to_numpy())
        asked = asks.flatten()
        get = lambda n: asked.field(n).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(counts)), counts)
        low, size = get("low"), get("size").astype(np.int64)
        size = np.minimum(size, np.diff(flat.offsets)[row] - low)
        fine = size >= LENGTH
        row, low, size = row[fine], low[fine], size[fine]
        which, place = within(size)
        data = flat.bytes[(flat.offsets[row] + low)[which] + place]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        blob = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([
            pa.array(get("h")[fine]), pa.array(get("i")[fine]), pa.array(get("j")[fine]),
            pa.array(ids[row], pa.int64()), pa.array(low), pa.array(size.astype(np.int32)), pa.array(get("left")[fine]), blob,
        ], ["h", "i", "j", "doc", "low", "size", "left", "bytes"])


def spans(docs: DataFrame) -> DataFrame:
    """Byte spans (doc, low, size) whose union is what goes; spans overlap."""
    configure(docs.sparkSession)
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    rows = texts.mapInArrow(_anchored, "h long, c long, doc long, low long, size long, left int")
    met = stored(
        rows.repartition("h").sortWithinPartitions("h", "c", "doc", "low").mapInArrow(
            _meet, "h long, doc long, low long, size long, left int"
        )
    )
    asks = met.where(F.col("h").isNotNull() & (F.col("size") >= LENGTH))
    many = asks.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK).select(
        "h", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")
    )
    mine = F.pmod(F.xxhash64("doc", "low"), F.col("blocks")).cast("int")
    placed = (
        asks.join(many, "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("blocks = 1 or other <> mine")
        .select("h", "doc", "low", "size", "left", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    )
    wanted = placed.groupBy("doc").agg(F.collect_list(F.struct("h", "i", "j", "low", "size", "left")).alias("asks"))
    contexts = texts.join(wanted, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "asks").mapInArrow(
        _fetch, "h long, i int, j int, doc long, low long, size int, left int, bytes binary"
    )
    found = contexts.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(
        _compare, "doc long, low long, size long"
    )
    return met.where("h is null").select("doc", "low", "size").unionByName(found)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        flat = Flat(part.column("text"))
        cuts = part.column("cuts")
        counts = np.diff(cuts.offsets.to_numpy())
        counts[np.array(cuts.is_null().to_pylist(), bool)] = 0
        cut = cuts.flatten()
        row = np.repeat(np.arange(len(counts)), counts)
        low = cut.field("low").to_numpy(zero_copy_only=False) + flat.offsets[row]
        high = np.minimum(low + cut.field("size").to_numpy(zero_copy_only=False), flat.offsets[row + 1])
        cover = np.zeros(len(flat.bytes) + 1, np.int32)
        np.add.at(cover, low, 1)
        np.add.at(cover, high, -1)
        gone = np.cumsum(cover[:-1]) > 0
        start = gone.copy()
        start[1:] &= ~gone[:-1]
        first = flat.offsets[:-1][np.diff(flat.offsets) > 0]
        start[first] = gone[first]
        per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[flat.offsets])
        removed = per(gone)
        kept = np.concatenate([[0], np.cumsum(np.diff(flat.offsets) - removed)]).astype(np.int32)
        blob = pa.Array.from_buffers(
            pa.binary(), len(counts), [None, pa.py_buffer(kept), pa.py_buffer(np.ascontiguousarray(flat.bytes[~gone]))]
        )
        yield pa.RecordBatch.from_arrays([
            part.column("doc_id"), pa.array(np.diff(flat.offsets)), pa.array(removed), pa.array(per(start)), blob,
        ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the bytes kept, of all documents."""
    cuts = spans(docs).groupBy("doc").agg(F.collect_list(F.struct("low", "size")).alias("cuts"))
    return docs.select("doc_id", "text").join(cuts, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "cuts").mapInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
