"""Near-duplicate passages by compact windows over min-hashes of shingles.

For one hash function, all runs of at least ``LEAST`` shingles of a text whose
smallest hash is at place c form one compact window (l, c, r): the runs that
start in l..c and end in c..r. The windows are the nodes of the text's Cartesian
tree whose span is long enough, about 2 n / LEAST of them, and they stand for
all n * n / 2 runs. Two windows with the same smallest shingle hold runs with
equal min-hash. Windows of all texts meet by that value, each linked first to the
first text that has it (and, where its extent differs from that one's, to the
text before it). A pair of texts whose windows overlap in at least
``AGREE`` of ``HASHES`` functions is verified on the texts: the best stretch of
one that the other holds, and the Jaccard similarity of the two stretches.

The class of a window is the least text found to hold a passage around its smallest
shingle too, so a passage that thousands of texts share gives thousands of links and
not their square. All windows of a value that are of different classes (a common line in
other surroundings) are then compared: ``rest`` lets them meet by the values that
two functions have for one run, or, for runs, by the run and the shingles beside it, and takes
the least text of each class there, and of these every pair whose stretches share as many
shingles as runs that are alike must. They carry their shingles to that, so that a line that is
common to texts which share nothing else makes no pair to be verified on texts. Large groups
are split into blocks, every two of which meet in a task of bounded size.

A value of one shingle hides repeats where that shingle is frequent: the first text
with it may hold a common line in other surroundings. One more function is therefore
taken over runs of ``RUN`` shingles, whose windows span ``LEAST`` shingles in all. Any
exact repeat holds a window's smallest run whole, and only texts with all its
``RUN + WIDTH - 1`` words share it, so lines shorter than that hide nothing. Agreement
in this function is enough for a pair to be verified.

Texts are read as words lower-cased in A-Z; passages count from ``WORDS`` words
up and ``PERCENT`` % similarity of their distinct 5-word shingles.

Null and empty texts, and those under ``WORDS`` words, have no passage. Copies
within a text are not looked for. Repeated rows of a doc_id count as one text.
Only ``doc_id`` and ``text`` are read; ``cut`` keeps the other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import configure, stored
from palisade.llm.flat import Flat, mix, slices, windows, within

_ROW = ["k", "l", "c", "r", "x", "y"]
#: The same as the windows are dealt, two in a number: l and the places from r to ``_LAST``, c and k, x and y.
_PLACES = ["lr", "ck", "xy"]
_LAST = (1 << 31) - 1

WIDTH = 5
WORDS = 50
LEAST = WORDS - WIDTH + 1
HASHES = 5
AGREE = 2
#: Shingles of the runs that exact repeats meet by, as one more function numbered ``HASHES``.
RUN = 23
PERCENT = 80
#: An exact repeat goes on for so many shingles on one side at least of a smallest run in it.
SIDE = -(-(LEAST - RUN) // 2)
#: Windows of one key in a block.
BLOCK = 2048
#: Pairs that a task writes out at once.
_PAIRS = 1 << 17
#: Marks of pairs that are looked up at once.
_MARKS = 1 << 20
#: All numbers of 16 bits in no order, and the place of each.
_SCATTER = mix(np.arange(1 << 16, dtype=np.uint64)).argsort().astype(np.uint64)
_PLACE = _SCATTER.argsort()
#: Members of one text's links that are verified in one run of rows.
SPREAD = 1000


def cartesian(hashes: np.ndarray, counts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows (l, c, r) over rows of hashes, as places in the whole array, ends included.

    A place is the smallest of a long enough window if it is that of some run of ``least``, and
    runs next to each other have mostly the same one. The tree is cut over these alone, level by
    level for all rows at once. Equal hashes are ordered by scattered places, which
    keeps the tree shallow on repetitive texts, and their last bits tell the place.
    """
    if len(hashes) < least:
        return (np.zeros(0, np.int64),) * 3
    lowest = (hashes & ~np.uint64(0xFFFF)) | np.resize(_SCATTER, len(hashes))
    width = 1
    while width < least:
        step = min(width, least - width)
        lowest = np.minimum(lowest[:-step], lowest[step:])
        width += step
    kept = np.maximum(counts - least + 1, 0)
    row, place = within(kept)
    start = (np.cumsum(counts) - counts)[row] + place
    lowest = lowest[start]
    new = np.ones(len(start), bool)
    new[1:] = (lowest[1:] != lowest[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    keys, low = lowest[first], start[first]
    last = start[np.append(first[1:], len(start)) - 1] if len(first) else low
    middle = low + ((_PLACE[keys & np.uint64(0xFFFF)] - low) & 0xFFFF)
    # Runs of starts with one smallest place, row by row, are what the levels cut.
    ends = np.cumsum(np.bincount(row[first], minlength=len(counts)))
    left, right = np.append(0, ends[:-1]), ends
    left, right = left[left < right], right[left < right]
    l, r = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
    while len(left):
        segment, place = within(right - left)
        values = keys[left[segment] + place]
        at = np.cumsum(right - left) - (right - left)
        hit = np.flatnonzero(values == np.minimum.reduceat(values, at)[segment])
        hit = hit[np.append(True, segment[hit[1:]] != segment[hit[:-1]])]
        node = left + place[hit]
        l[node], r[node] = low[left], last[right - 1] + least - 1
        left, right = np.concatenate([left, node + 1]), np.concatenate([node, right])
        left, right = left[left < right], right[left < right]
    return l, middle, r


def _shingles(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, counts = flat.words()
    return windows(flat.hashes(starts, ends, lower=True), counts, WIDTH)


def _sides(hashes: np.ndarray, counts: np.ndarray, row: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Hashes, never 0, of the ``SIDE`` shingles before and behind the runs at these places of their rows; 0 if there are fewer."""
    values, kept = windows(hashes, counts, SIDE)
    base = (np.cumsum(kept) - kept)[row]
    out = []
    for start in (place - SIDE, place + RUN):
        has = (start >= 0) & (start < kept[row])
        side = np.zeros(len(row), np.int32)
        side[has] = (values[(base + start)[has]] >> np.uint64(33)).astype(np.int32) | 1
        out.append(side)
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each text."""

    def of(part: pa.RecordBatch, values: np.ndarray, counts: np.ndarray, width: int) -> pa.RecordBatch:
        """Windows over values that each stand for ``width`` shingles, as places of shingles in their text; rows of one function after those of another."""
        ends = np.cumsum(counts)
        l, c, r = cartesian(values, counts, LEAST - width + 1)
        row = np.searchsorted(ends, c, side="right")
        base = (ends - counts)[row]
        k, text = (np.full(len(row), HASHES), row) if width > 1 else np.divmod(row, part.num_rows)
        sides = _sides(hashes, each, text, c - base) if width > 1 else [np.zeros(len(c), np.int64)] * 2
        return pa.RecordBatch.from_arrays([
            pa.array(values[c].view(np.int64)), part.column("doc_id").take(pa.array(text)),
            *(pa.array(x.astype(np.int64) << 32 | y) for x, y in ((l - base, _LAST + 1 - width - r + base), (c - base, k), sides)),
        ], ["h", "doc", *_PLACES])

    for part in slices(batches):
        hashes, each = _shingles(Flat(part.column("text")))
        salts = (np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
        yield of(part, mix(hashes ^ salts).ravel(), np.tile(each, HASHES), 1)
        yield of(part, *windows(hashes, each, RUN), RUN)


def _packed(table: np.ndarray) -> pa.Array:
    """Each row of integers as one binary value."""
    offsets = np.arange(len(table) + 1, dtype=np.int32) * 4 * table.shape[1]
    data = np.ascontiguousarray(table, "<i4")
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The integers of all binary values, and how many each has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 4
    return np.frombuffer(data, "<u4")[at[0] : at[-1]] if len(column) else np.zeros(0, "<u4"), np.diff(at)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of rows in which all rows of the same values in ``names``, that come in a row, are together."""
    held: list[pa.RecordBatch] = []  # rows whose run may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in names], axis=1)
        cut = np.flatnonzero((keys != keys[-1]).any(axis=1))
        cut = int(cut[-1]) + 1 if len(cut) else 0
        if held and (cut or any(held[-1].column(n)[-1].as_py() != v for n, v in zip(names, keys[-1].tolist()))):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (h, doc), of a text's the earliest and widest first, links of each window to those of earlier texts.

    Links come with the window ``own`` and the ends ``lead`` of the other, those to the first text of a value also with
    their place c; further windows of that text itself come as rows with a = b. Of a value that two texts
    or more have, the first window comes as a row without b, whose ``bit`` tells if three have it.
    """
    names = ["h", "doc", *_PLACES]
    first = last = None  # the first row of the running value, and the last row seen, carried to the next batch
    texts = 0  # of the running value, so far

    def heads(rows: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        return out(rows, pa.nulls(len(rows), pa.int64()), many.astype(np.int32), rows[:, 3] >> 32, None, np.zeros((len(rows), 2)))

    def out(rows, b, bit, c, none, lead) -> pa.RecordBatch:
        own = np.empty((len(rows), 6), "<i4")
        own[:, 0], own[:, 1], own[:, 2] = rows[:, 3], rows[:, 2] >> 32, rows[:, 3] >> 32
        own[:, 3], own[:, 4], own[:, 5] = _LAST - (rows[:, 2] & 0xFFFFFFFF), rows[:, 4] >> 32, rows[:, 4]
        return pa.RecordBatch.from_arrays([
            pa.array(rows[:, 0]), pa.array(rows[:, 1]), b, pa.array(bit), pa.array(c.astype(np.int32), mask=none), _packed(own), _packed(lead),
        ], ["h", "a", "b", "bit", "c", "own", "lead"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
        head = [] if first is None else [first, last]
        rows = np.concatenate([np.array(head, np.int64).reshape(-1, len(names)), rows])
        new = np.ones(len(rows), bool)
        new[1:] = rows[1:, 0] != rows[:-1, 0]
        step = new.copy()
        step[1:] |= rows[1:, 1] != rows[:-1, 1]
        index = np.arange(len(rows))
        starts = np.flatnonzero(new)
        begin = np.maximum.accumulate(np.where(new, index, 0))
        before = np.maximum.accumulate(np.where(step, index, 0)) - 1
        own = index >= len(head)
        held = np.add.reduceat(step.astype(np.int64), starts)
        if head:
            # Of the carried rows, the last may be of the first's text, or of one that was counted.
            held[0] += texts - 1 - (first[1] != last[1])
        apart = rows[begin, 1] != rows[:, 1]
        l, r, c = rows[:, 2] >> 32, _LAST - (rows[:, 2] & 0xFFFFFFFF), rows[:, 3] >> 32
        near = own & apart & (before > begin) & (rows[before, 1] != rows[begin, 1]) & (
            (c - l != c[begin] - l[begin]) | (r - c != r[begin] - c[begin])
        )
        # What one text alone has is no link, as far as it is seen here.
        alone = held == 1
        alone[-1] = False
        far = own & (begin != index) & ~alone[np.cumsum(new) - 1]
        a = np.concatenate([index[far], index[near]])
        b = np.concatenate([begin[far], before[near]])
        if len(a):
            # Windows of one value share place c; what surrounds it in both is what can be alike.
            k = rows[a, 3] & 0xFFFFFFFF
            # Of runs, one function counts as enough.
            bit = np.where(k == HASHES, (1 << AGREE) - 1 << HASHES, 1 << k).astype(np.int32)
            yield out(rows[a], pa.array(rows[b, 1]), bit, c[a], np.arange(len(a)) >= far.sum(), np.stack([l[b], r[b]], axis=1))
        first, last, texts = rows[starts[-1]], rows[-1], int(held[-1])
        done = np.flatnonzero(held[:-1] > 1)
        if len(done):
            yield heads(rows[starts[done]], held[done] > 2)
    if texts > 1:
        yield heads(first[None], np.array([texts > 2]))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of doc, the windows of a text that meet others, the keys by which the rest meets.

    Two windows of different functions have one key if some run has both their smallest shingles, as
    has a run of the last function with either side of it. What such runs hold at least comes as its ends.
    """
    for part in _runs(batches, ["doc"]):
        doc, h, of, busy = (part.column(n).to_numpy() for n in ("doc", "h", "class", "busy"))
        rows = _unpacked(part.column("row"))[0].view("<i4").reshape(-1, len(_ROW)).astype(np.int64)
        text = np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1
        # Texts without a value that different classes have meet nothing.
        kept = (np.bincount(text, weights=busy) > 0)[text]
        doc, text, h, of, busy, rows = doc[kept], text[kept], h[kept], of[kept], busy[kept], rows[kept]
        order = np.lexsort((rows[:, 1], text))
        doc, text, h, of, busy, rows = doc[order], text[order], h[order].view(np.uint64), of[order], busy[order], rows[order]
        k, l, c, r = rows[:, :4].T
        wide = np.where(k == HASHES, RUN - 1, 0)
        lift = int(r.max(initial=0)) + 1
        reach = np.searchsorted(text * lift + l, text * lift + r, side="right")
        at = np.arange(len(h))
        # A few windows at a time, as one text may have many that overlap.
        total = np.cumsum(reach - at - 1)
        cuts = np.searchsorted(total, np.arange(_PAIRS, int(total[-1]) if len(total) else 0, _PAIRS))
        pieces = [(p, None) for p in np.split(at, np.unique(cuts))]
        for side in (4, 5):
            has = np.flatnonzero(busy & (k == HASHES) & (rows[:, side] != 0))
            pieces.append((has, side))
        for some, side in pieces:
            if side is None:
                which, place = within(reach[some] - some - 1)
                i = some[which]
                j = i + 1 + place
                # A run with both smallest shingles lies in both windows.
                low, high = l[j], np.minimum(r[i], r[j])
                kept = (k[i] != k[j]) & (busy[i] | busy[j]) & (high - low + 1 >= LEAST)
                kept &= (np.minimum(c[i], c[j]) >= low) & (np.maximum(c[i], c[j]) <= high)
                i, j, low, high = i[kept], j[kept], low[kept], high[kept]
                i, j = np.where(k[i] < k[j], i, j), np.where(k[i] < k[j], j, i)
                begin, end = np.minimum(c[i], c[j]), np.maximum(c[i] + wide[i], c[j] + wide[j])
                key = mix(h[i] + mix(h[j]))
            else:
                i = j = some
                low, high = l[i], r[i]
                begin, end = (c[i] - SIDE, c[i] + RUN - 1) if side == 4 else (c[i], c[i] + RUN + SIDE - 1)
                key = mix(h[i] ^ mix(rows[i, side].astype(np.uint64) * np.uint64(8) + np.uint64(side)))
            if len(i):
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(doc[i]),
                    _packed(np.stack([k[i], k[j], low, high, begin, end], axis=1)), pa.array(of[i]), pa.array(of[j]),
                ], ["key", "doc", "both", "class", "class2"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the asked stretches of each text, in 32 bits each, and the fewest distinct ones that a run there has."""
    for part in slices(batches):
        hashes, counts = _shingles(Flat(part.column("text")))
        asks = part.column("asks")
        size = np.diff(asks.offsets.to_numpy())
        asked = pa.Table.from_batches([pa.RecordBatch.from_struct_array(asks.flatten())])
        text = np.repeat(np.arange(len(size)), size)
        rows = _unpacked(asked.column("both"))[0].view("<i4").reshape(-1, 6).astype(np.int64)
        # Another text of the same id may be shorter.
        fine = rows[:, 3] < counts[text]
        asked, text, rows = asked.filter(pa.array(fine)).combine_chunks(), text[fine], rows[fine]
        base = (np.cumsum(counts) - counts)[text]
        low, high, begin, end = rows[:, 2] + base, rows[:, 3] + base + 1, rows[:, 4] + base, rows[:, 5] + base
        # A shingle that occurs again so near is missing in all runs of LEAST that hold both places.
        before = _before(mix(hashes + np.repeat(np.arange(len(counts), dtype=np.uint64), counts)))
        place = np.arange(len(hashes))
        again = np.flatnonzero((before >= 0) & (place - before < LEAST))
        fewer = np.zeros(len(hashes) + 2, np.int64)
        np.add.at(fewer, np.maximum(again - LEAST + 1, 0), 1)
        np.add.at(fewer, before[again] + 1, -1)
        distinct = LEAST - np.cumsum(fewer)
        # Runs of LEAST from these places on hold what all alike ones do, or lie in it.
        early = np.maximum(low, end - LEAST + 1)
        early, late = np.minimum(early, begin), np.where(early > begin, begin, np.minimum(begin, high - LEAST)) + 1
        least = np.minimum.reduceat(distinct, np.stack([early, late], axis=1).ravel())[::2] if len(low) else low
        which, at = within(high - low)
        offsets = np.concatenate([[0], np.cumsum(high - low)]).astype(np.int32) * 4
        marks = np.ascontiguousarray((hashes[low[which] + at] >> np.uint64(32)).astype("<u4"))
        yield pa.RecordBatch.from_arrays([
            *(asked.column(n).combine_chunks() for n in ("key", "blocks")), part.column("doc_id").take(pa.array(text)),
            *(asked.column(n).combine_chunks() for n in ("both", "class", "class2")), pa.array(least.astype(np.int32)),
            pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(offsets), pa.py_buffer(marks)]),
        ], ["key", "blocks", "doc", "both", "class", "class2", "least", "marks"])


def _best(row: np.ndarray, size: np.ndarray, ends: np.ndarray, worth: np.ndarray, apart: np.ndarray, pair: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The most that ``LEAST`` or more marks of each pair's ``row`` around its ``ends`` can score.

    One that the other text has counts half of 100 - PERCENT, and another its ``worth``; a mark that
    occurs again lies ``apart`` from its first place. ``pair`` and ``place`` tell the first places of those that both have.
    """
    at = np.cumsum(size) - size
    out = np.empty(len(row), np.int64)
    total = np.cumsum(size[row])
    cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(_MARKS, int(total[-1]), _MARKS)), [len(row)]]))
    if len(cuts) > 2:
        order = pair.argsort(kind="stable")
        pair, place = pair[order], place[order]
    for low, high in zip(cuts[:-1], cuts[1:]):
        mine = slice(*np.searchsorted(pair, [low, high])) if len(cuts) > 2 else slice(None)
        some = row[low:high]
        start = np.cumsum(size[some]) - size[some]
        which, inner = within(size[some])
        where = inner + at[some][which]
        score = worth[where]
        score[(start - at[some])[pair[mine] - low] + place[mine]] = 100 - PERCENT
        again = np.flatnonzero(apart[where])
        # One that occurs again counts once if it is missing in the other, as often as it may be held otherwise.
        score[again] = np.maximum(score[again - apart[where[again]]], 0)
        score = np.cumsum(score)
        # The most from each place to the end of its row, rows kept apart by what is added to them.
        lift = (len(some) - which) * (1 << 32)
        most = np.maximum.accumulate((score + lift)[::-1])[::-1]
        # Runs that hold the ends start at the first of them at most.
        heads = np.minimum(ends[some, 0], size[some] - LEAST) + 1
        fine = np.flatnonzero((heads > 0) & (ends[some, 1] < size[some]))
        out[low:high] = -(1 << 32)
        if len(fine):
            which, inner = within(heads[fine])
            which = fine[which]
            best = most[start[which] + np.maximum(ends[some, 1][which], inner + LEAST - 1)] - (len(some) - which) * (1 << 32)
            before = start[which] + inner - 1
            best -= np.where(before >= 0, score[before], 0)
            out[low + fine] = np.maximum.reduceat(best, np.cumsum(heads[fine]) - heads[fine])
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (key, i, j), pairs of texts of each group; of two blocks, those of one and the other.

    Runs that are alike lie in both stretches, so these share ``PERCENT`` % of the shingles of a run at least.
    What two such runs have in common, counted half in each, outweighs what they have not.
    """
    names = ["key", "i", "j"]
    for part in _runs(batches, names):
        columns = [part.column(n).to_numpy() for n in names]
        doc, mine = part.column("doc").to_numpy(), part.column("mine").to_numpy()
        rows = _unpacked(part.column("both"))[0].view("<i4").reshape(-1, 6)
        one, two, least = (part.column(n).to_numpy() for n in ("class", "class2", "least"))
        marks, size = _unpacked(part.column("marks"))
        new = np.ones(len(doc), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        at = np.arange(len(doc))
        begin = np.maximum.accumulate(np.where(new, at, 0))
        cross = columns[1] != columns[2]
        total = np.cumsum(at - begin)
        ends = rows[:, 4:] - rows[:, 2:3]
        # The distinct marks of all rows in order of (group, mark, row), as one number each.
        row = np.repeat(at, size)
        bits = int((at - begin).max()).bit_length()
        if int(new.sum()).bit_length() + bits > 32:
            raise ValueError("more rows of one group than blocks hold")
        key = (np.cumsum(new).astype(np.uint64) << np.uint64(32))[row] | marks
        key = key << np.uint64(bits) | (at - begin).astype(np.uint64)[row]
        order = np.argsort(key)
        key = key[order]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
        first = np.minimum.reduceat(order, edge) if len(edge) else edge
        apart = np.zeros(len(row), np.int64)
        apart[order] = np.repeat(first, np.diff(np.append(edge, len(key))))
        apart = np.arange(len(row)) - apart
        worth = np.where(apart == 0, -2 * PERCENT, 0)
        # Each meets those of its group and mark before it; they are taken row by row.
        key, owner = key[edge] >> np.uint64(bits), row[first]
        index = np.arange(len(edge))
        start = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1])[: len(key)], index, 0)) if len(edge) else index
        later = np.flatnonzero(index > start)
        later = later[np.argsort(owner[later], kind="stable")]
        met = _sums(later - start[later])[np.searchsorted(owner[later], np.arange(len(doc) + 1))]
        total = total + met[1:]
        for some in np.split(at, np.unique(np.searchsorted(total, np.arange(_PAIRS, int(total[-1]), _PAIRS)))):
            which, place = within(some - begin[some])
            if not len(which):
                continue
            x = some[which]
            y = begin[x] + place
            kept = (doc[x] != doc[y]) & ((one[x] != one[y]) | (two[x] != two[y])) & ~(cross[x] & (mine[x] == mine[y]))
            # All marks that a row has in common with one before it in its group: as those of one, those of the other, and the pair.
            chosen = later[slice(*np.searchsorted(owner[later], [some[0], some[-1] + 1]))]
            i, place = within(chosen - start[chosen])
            i = chosen[i]
            j = start[i] + place
            ahead = some - begin[some]
            pair = (np.cumsum(ahead) - ahead)[owner[i] - some[0]] + owner[j] - begin[owner[j]]
            kept &= 100 * np.bincount(pair, minlength=len(x)) >= PERCENT * np.maximum(least[x], least[y])
            best = np.zeros(len(x), np.int64)
            for mark, this, other in ((i, x, y), (j, y, x)):
                if not kept.any():
                    break
                now, again = np.flatnonzero(kept), kept[pair]
                best[now] += _best(this[now], size, ends, worth, apart, (np.cumsum(kept) - 1)[pair[again]], first[mark[again]])
                kept[now] = best[now] + ((100 - PERCENT) * size[other[now]] if this is x else 0) >= 0
            x, y = x[kept], y[kept]
            a, b = np.where(doc[x] > doc[y], x, y), np.where(doc[x] > doc[y], y, x)
            if len(a):
                spans = np.concatenate([rows[a, 2:4], rows[b, 2:4]], axis=1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc[a]), pa.array(doc[b]),
                    _packed(np.concatenate([rows[a, :1], spans, rows[a, 1:2], spans], axis=1)),
                ], ["a", "b", "spans"])


def _before(values: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """The last place before each that has the same value, or -1."""
    order = values.argsort(kind="stable") if order is None else order
    out = np.full(len(values), -1)
    sorted_ = values[order]
    same = sorted_[1:] == sorted_[:-1]
    if same.any():
        out[order[1:][same]] = order[:-1][same]
    return out


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums before each place, and that of all."""
    out = np.zeros(len(values) + 1, np.int64)
    values.cumsum(out=out[1:])
    return out


def _stretches(x: np.ndarray, y: np.ndarray, percent: int) -> list[tuple]:
    """Stretches of x, none inside another, that y holds: (start, end, start2, end2, similarity), ends included.

    A stretch begins and ends with a run of shingles that both hold side by
    side, as longer ends only make it less alike; one shorter than ``LEAST``
    is filled up with its surroundings. Per start the furthest end is taken at
    which the exact Jaccard similarity suffices. What is tried is bounded from
    above: by prefix sums in which a shared shingle counts 1 - share and
    another, where it first occurs, -share, and by the distinct shingles.
    """
    n = len(x)
    share = percent / 100
    order = y.argsort(kind="stable")
    where = order[np.minimum(y[order].searchsorted(x), len(y) - 1)]
    match = y[where] == x
    places = match.nonzero()[0]
    if n < LEAST or not len(places):
        return []
    first, last = int(places[0]), int(places[-1])
    spots = where[places]
    if LEAST <= len(places) == last - first + 1 and (spots[1:] - spots[:-1] == 1).all():
        # One run that both hold side by side is the whole answer.
        return [(first, last, int(spots[0]), int(spots[-1]), 1.0)]
    before = _before(x)
    if 100 * len(places) < percent * LEAST and before.max() < 0:
        return []
    before2 = _before(y, order)
    firsts, firsts2, shared = _sums(before < 0), _sums(before2 < 0), _sums(match)
    once = firsts2[-1] == len(y)
    score = np.where(match, 1 - share, np.where(before < 0, -share, 0.0)).cumsum()
    score = np.concatenate([[0.0], score])
    best = np.maximum.accumulate(score[::-1])
    tries = [(places, True)]
    if (spots[1:] <= spots[:-1]).any():
        # Shared shingles in another order than in y are tried by what lies around one diagonal.
        apart = spots - places
        sort = apart.argsort(kind="stable")
        apart = apart[sort]
        parts = np.split(places[sort], (apart[1:] - apart[:-1] > LEAST).nonzero()[0] + 1)
        parts = [np.sort(q) for q in parts]
        tries += [(q, False) for q in parts if (np.diff(where[q]) <= 0).any()]
    found = []
    for chosen, ordered in tries:
        spots = where[chosen]
        edge = ((chosen[1:] - chosen[:-1] != 1) | (spots[1:] - spots[:-1] != 1)).nonzero()[0]
        first, last = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(chosen) - 1]])
        # Of a shingle over and over, each place a run of its own, the first place starts and the last one ends all that others do.
        again = (x[chosen[last[:-1]]] == x[chosen[first[1:]]]) & (chosen[first[1:]] - chosen[last[:-1]] == 1)
        alone = first == last
        first, last = first[np.concatenate([[True], ~(again & alone[:-1])])], last[np.concatenate([~(again & alone[1:]), [True]])]
        starts, ends = chosen[first], chosen[last]
        reach = n - 1 - best.searchsorted(score[starts] - 1e-6)
        # Even its whole reach must hold enough of what its first LEAST shingles have.
        filled = np.minimum(starts + LEAST, n)
        most = shared[np.maximum(reach, starts) + 1] - shared[starts]
        hopeful = 100 * most >= percent * (firsts[filled] - firsts[filled - LEAST])
        begins, stops = ends.searchsorted(starts), ends.searchsorted(reach, side="right")
        done = -1
        for i in (hopeful & (stops > begins)).nonzero()[0].tolist():
            start, stop = int(starts[i]), int(stops[i])
            if ends[stop - 1] <= done:
                continue
            tail = slice(max(int(begins[i]), int(ends.searchsorted(done, side="right"))), stop)
            end = ends[tail]
            fresh = before[start : end[-1] + 1] < start
            held = (fresh & match[start : end[-1] + 1]).cumsum()[end - start]
            right = np.maximum(end, min(start + LEAST, n) - 1)
            left = np.maximum(np.minimum(start, right - LEAST + 1), 0)
            if ordered:
                low2, high2 = np.full(len(end), where[start]), where[end]
            else:
                inside = where[chosen[first[i] : last[stop - 1] + 1]]
                low2 = np.minimum.accumulate(inside)[last[tail] - first[i]]
                high2 = np.maximum.accumulate(inside)[last[tail] - first[i]]
            size = np.maximum(fresh.cumsum()[end - start], firsts[right + 1] - firsts[left])
            held = np.minimum(held, high2 - low2 + 1)
            size2 = np.maximum(firsts2[high2 + 1] - firsts2[low2], held)
            likely = (high2 >= low2) & (100 * held >= percent * (size + size2 - held))
            for j in likely.nonzero()[0][::-1].tolist():
                l, r, l2, r2 = int(left[j]), int(right[j]) + 1, int(low2[j]), int(high2[j]) + 1
                new = before[l:r] < l
                if once:
                    spots = where[l:r]
                    both = np.count_nonzero(new & match[l:r] & (spots >= l2) & (spots < r2))
                    union = np.count_nonzero(new) + r2 - l2 - both
                else:
                    both = len(np.intersect1d(x[l:r][new], y[l2:r2][before2[l2:r2] < l2], assume_unique=True))
                    union = np.count_nonzero(new) + np.count_nonzero(before2[l2:r2] < l2) - both
                if 100 * both >= percent * union:
                    done = int(end[j])
                    found.append((start, -done, l, r - 1, l2, r2 - 1, both / union))
                    break
    out, done = [], -1
    for _, end, *item in sorted(found):
        if -end > done:
            out.append(tuple(item))
            done = -end
    return out


def _groups(spans: np.ndarray, agree: int) -> list[np.ndarray]:
    """Spans (k, l, r, l2, r2) that overlap in l..r, where enough hash functions agree, or that of runs."""
    spans = spans[np.argsort(spans[:, 1], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 2])
    cut = [0, *(np.flatnonzero(spans[1:, 1] > reach[:-1]) + 1).tolist(), len(spans)]
    groups = [spans[i:j] for i, j in zip(cut[:-1], cut[1:])]
    kinds = [set(g[:, 0].tolist()) for g in groups]
    return [g for g, k in zip(groups, kinds) if len(k) >= agree or HASHES in k]


def _trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each linked text only the stretches that the agreeing windows cover, each a row of its own."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.binary())]
    for part in slices(batches):
        flat = Flat(part.column("text"))
        starts, ends, counts = flat.words()
        first = np.cumsum(counts) - counts
        data, rows = flat.bytes.tobytes(), []
        for i, (b, block, a, spans) in enumerate(zip(*(part.column(n).to_pylist() for n in ("b", "block", "a", "spans")))):
            table = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 5)
            for group in _groups(table[table[:, 2] + WIDTH <= counts[i]], AGREE):
                low, high = int(group[:, 1].min()), int(group[:, 2].max()) + WIDTH
                piece = data[starts[first[i] + low] : ends[first[i] + high - 1]].decode("utf-8")
                rows.append((b, block, a, low, piece, [(group - np.array([0, low, low, 0, 0])).astype("<i4").tobytes()]))
        columns = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["b", "block", "a", "base", "text", "spans"])


def compare(one: np.ndarray, two: np.ndarray, spans: np.ndarray, agree: int = AGREE, percent: int = PERCENT) -> list[tuple]:
    """Alike stretches of two shingle sequences within the spans (k, l, r, l2, r2).

    Returns (start, end, start2, end2, similarity), in words, ends excluded.
    """
    out = []
    for group in _groups(spans, agree):
        low, low2 = int(group[:, 1].min()), int(group[:, 3].min())
        x, y = one[low : group[:, 2].max() + 1], two[low2 : group[:, 4].max() + 1]
        for start, end, start2, end2, alike in _stretches(x, y, percent):
            out.append((low + start, low + end + WIDTH, low2 + start2, low2 + end2 + WIDTH, alike))
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (b, block, a): the earlier text first (a null), then the texts linked to it."""
    key, earlier = None, None
    for part in slices(batches):
        hashes, counts = _shingles(Flat(part.column("text")))
        ends = np.cumsum(counts)
        found = []
        for i, (a, b, block, base, spans) in enumerate(zip(*(part.column(n).to_pylist() for n in ("a", "b", "block", "base", "spans")))):
            row = hashes[ends[i] - counts[i] : ends[i]]
            if a is None:
                key, earlier = (b, block), row.copy()
            elif key == (b, block):
                table = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 5)
                table = table[(table[:, 2] < len(row)) & (table[:, 4] < len(earlier))]
                found += [(a, base + s[0], base + s[1], b, *s[2:]) for s in compare(row, earlier, table)]
        columns = list(zip(*found)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        names = ["doc_id", "start_word", "end_word", "source_id", "source_start", "source_end", "similarity"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def links(docs: DataFrame) -> DataFrame:
    """Links of windows to the first text of their value and the one before; see ``_stars``."""
    configure(docs.sparkSession)
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(
        _windows, "h long, doc long, lr long, ck long, xy long"
    )
    return rows.repartition("h").sortWithinPartitions("h", "doc", "lr").mapInArrow(
        _stars, "h long, a long, b long, bit int, c int, own binary, lead binary"
    )


def candidates(met: DataFrame) -> DataFrame:
    """Pairs a > b of texts whose linked windows agree, with the packed spans (k, l, r, l2, r2)."""
    part = lambda name, k, n=1: F.substring(name, 4 * k + 1, 4 * n)
    spans = F.concat(part("own", 0, 2), part("own", 3), "lead")
    return met.where("a <> b").groupBy("a", "b").agg(
        F.collect_list(spans).alias("spans"), F.bit_or("bit").alias("bits")
    ).where(F.bit_count("bits") >= AGREE).drop("bits")


def rest(docs: DataFrame, met: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs a > b of the least texts of classes whose windows agree, of values that three texts or more have."""
    rows = met.where("c is not null").select(
        "h", F.col("a").alias("doc"), "c", F.col("own").alias("row"), (F.col("b").isNull() & (F.col("bit") > 0)).alias("many")
    )
    held = found.groupBy(F.col("doc_id").alias("doc")).agg(
        F.collect_set(F.struct("start_word", "end_word", "source_id")).alias("held")
    )
    # A text is linked to those of smaller id alone.
    least = F.aggregate("held", F.col("doc"), lambda m, s: F.when(
        (s["start_word"] <= F.col("c")) & (s["end_word"] >= F.col("c") + WIDTH), F.least(m, s["source_id"])
    ).otherwise(m))
    classed = stored(rows.join(held, "doc", "left").select("h", "doc", "row", "many", F.coalesce(least, F.col("doc")).alias("class")), "zstd")
    mixed = classed.groupBy("h").agg(
        (F.bool_or("many") & (F.min("class") < F.max("class"))).alias("busy"), F.min("doc").alias("low"), F.max("doc").alias("high")
    ).where("low < high").select("h", "busy")
    texts = classed.join(mixed, "h").select("doc", "h", "row", "class", "busy").repartition("doc").sortWithinPartitions("doc")
    keyed = stored(
        texts.mapInArrow(_keys, "key long, doc long, both binary, class long, class2 long")
        .groupBy("key", "class", "class2").agg(F.min(F.struct("doc", "both")).alias("least")).select("key", "class", "class2", "least.*"), "zstd"
    )
    again = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    asks = keyed.join(again, "key").groupBy("doc").agg(F.collect_list(F.struct("key", "blocks", "both", "class", "class2")).alias("asks"))
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    marked = texts.join(asks, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "asks").mapInArrow(
        _marked, "key long, blocks int, doc long, both binary, class long, class2 long, least int, marks binary"
    )
    dealt = (
        marked.withColumn("mine", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", "doc", "both", "class", "class2", "least", "marks", "mine",
            F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        )
    )
    pairs = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(
        _pairs, "a long, b long, spans binary"
    )
    return pairs.groupBy("a", "b").agg(F.collect_set("spans").alias("spans"))


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row per passage that the texts of a pair share; ``pairs`` is read several times."""
    blocks = pairs.groupBy("b").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("blocks"))
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    later = (
        pairs.join(blocks, "b").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
        .join(texts, F.col("a") == F.col("doc_id")).select("b", "block", "a", "text", "spans")
        .mapInArrow(_trim, "b long, block int, a long, base long, text string, spans array<binary>")
    )
    first = (
        blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(texts, F.col("b") == F.col("doc_id"))
        .select("b", "block", F.lit(None).cast("long").alias("a"), F.lit(0).cast("long").alias("base"), "text", F.lit(None).cast("array<binary>").alias("spans"))
    )
    return (
        later.unionByName(first).repartition("b", "block").sortWithinPartitions("b", "block", F.col("a").asc_nulls_first())
        .mapInArrow(
            _verify,
            "doc_id long, start_word long, end_word long, source_id long, source_start long, source_end long, similarity double",
        )
    )


def passages(docs: DataFrame) -> DataFrame:
    """A row per passage of ``doc_id`` that a text of smaller doc_id holds too, in words (ends excluded).

    Texts that hold a passage of the same text around the same place are a class there: their rows
    with that text are their membership, and the class's least text stands for them towards others.
    """
    met = stored(links(docs), "zstd")
    pairs = stored(candidates(met), "zstd")
    found = stored(verified(docs, pairs))
    more = stored(rest(docs, met, found))
    # A pair that comes again is verified with all its spans.
    again = pairs.join(more.select("a", "b"), ["a", "b"], "left_semi").unionByName(more)
    again = stored(again.groupBy("a", "b").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    once = found.join(
        more.select(F.col("a").alias("doc_id"), F.col("b").alias("source_id")), ["doc_id", "source_id"], "left_anti"
    ).select(*found.columns)
    return once.unionByName(verified(docs, again))


def _cut(texts: pa.Array, spans: list) -> tuple[list, list]:
    flat = Flat(texts)
    starts, ends, counts = flat.words()
    first = np.cumsum(counts) - counts
    data = flat.bytes.tobytes()
    out, left = [], []
    for i, (text, cuts) in enumerate(zip(texts.to_pylist(), spans)):
        if not cuts:
            out.append(text)
            left.append(True)
            continue
        parts, at = [], int(flat.offsets[i])
        gone = np.zeros(counts[i], bool)
        for a, b in sorted((s["a"], s["b"]) for s in cuts):
            gone[a:b] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
        for a, b in edges.tolist():
            parts.append(data[at : starts[first[i] + a]])
            at = int(ends[first[i] + b - 1])
        parts.append(data[at : flat.offsets[i + 1]])
        out.append(b"".join(parts).decode("utf-8"))
        left.append(not gone.all())
    return out, left


def cut(docs: DataFrame) -> DataFrame:
    """The documents without passages that an earlier one holds; those left without a word are gone."""
    names = docs.columns
    found = passages(docs).groupBy("doc_id").agg(
        F.collect_set(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))).alias("cuts")
    ).withColumnRenamed("doc_id", "cut_id")
    # The text moves once, beside the other columns.
    others = F.struct(*[n for n in names if n != "text"])
    packed = docs.select("text", others.alias("row"), F.col("doc_id").alias("own_id"))
    kind = packed.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, left = _cut(part.column("text"), part.column("cuts").to_pylist())
            out = pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], ["row", "cut_text"])
            yield out.filter(pa.array(left))

    joined = packed.join(found, F.col("own_id") == F.col("cut_id"), "left").select("text", "row", "cuts")
    done = joined.mapInArrow(run, f"row {kind}, cut_text string")
    return done.select(*[F.col("cut_text").alias("text") if n == "text" else F.col("row")[n].alias(n) for n in names])
