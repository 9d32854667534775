"""Whole texts as flat byte arrays: slicing, words, and 64-bit hashes of spans in numpy.

Python tasks of this subpackage work on a few MB of text at a time. A slice of
rows becomes one byte buffer with row offsets; words and hashes of arbitrary
spans are then found for all rows at once, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000
#: Powers are kept for texts up to this size; those of a longer text are made for it alone.
_KEPT_BITS = 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value per byte, fixed by the seed.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
LOWER_VALUES = BYTE_VALUES[LOWER]


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _MULTIPLIER), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, out=up), np.cumprod(down, out=down)


_kept_powers = cache(_powers)


def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first ``1 << bits`` powers of the multiplier and of its inverse."""
    return _kept_powers(_KEPT_BITS) if bits <= _KEPT_BITS else _powers(bits)


class Flat:
    """The rows of a text column, null as empty, in one UTF-8 byte buffer."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = flat[off[0] : off[-1]] if len(off) else flat[:0]
        self.offsets = off - off[0] if len(off) else np.zeros(1, np.int64)
        self._sums = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and how many each row has."""
        inner = ~WHITE[self.bytes]
        begins, ends = inner.copy(), inner.copy()
        begins[1:] &= ~inner[:-1]
        ends[:-1] &= ~inner[1:]
        filled = self.offsets[:-1] < self.offsets[1:]
        first, last = self.offsets[:-1][filled], self.offsets[1:][filled] - 1
        begins[first] = inner[first]
        ends[last] = inner[last]
        starts = np.flatnonzero(begins)
        counts = np.diff(np.searchsorted(starts, self.offsets))
        return starts, np.flatnonzero(ends) + 1, counts

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of the byte spans; with ``lower``, A-Z count as a-z."""
        up, down = powers(max(16, int(len(self.bytes)).bit_length()))
        if self._sums is None or self._sums[0] != lower:
            sums = np.empty(len(self.bytes) + 1, np.uint64)
            sums[0] = 0
            values = (LOWER_VALUES if lower else BYTE_VALUES)[self.bytes]
            np.cumsum(values * up[: len(values)], out=sums[1:])
            self._sums = (lower, sums)
        sums = self._sums[1]
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has about ``SLICE_BYTES`` of text; a longer text stands alone."""
    for batch in batches:
        lengths = batch.column(column).cast(pa.large_string()).fill_null("")
        sizes = np.diff(np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1])
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if total + size > SLICE_BYTES and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and position in its row of each element, given the rows' counts."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def windows(values: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` values inside each row, and how many each row has."""
    kept = np.maximum(counts - width + 1, 0)
    rows, place = within(kept)
    first = (np.cumsum(counts) - counts)[rows] + place
    total = np.zeros(max(len(values) - width + 1, 0), np.uint64)
    for k in range(width):
        total += values[k : len(total) + k]
        total *= _MULTIPLIER + np.uint64(2 * k)
    return mix(total[first]), kept
