"""Token ids of whole texts, with each distinct piece of text encoded once per worker.

Neither vocabulary used here merges across white space, so a text's ids are
those of its words in order. ``WordBpe`` further splits words where its
pre-tokenizer always splits; ``PieceBpe`` is used on words as they stand. The
cache of a worker holds at most ``CACHE`` pieces, those of a task of 16 MB of text
that has hardly a word twice, and starts anew beyond that; a task empties it when
it ends, as workers live on for other work.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np

from palisade.llm.flat import Flat, within

CACHE = 500_000
_JOIN = 400

# Byte classes: 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 to be left whole.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[0x30:0x3A] = 2
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[ord("'")] = 4


def _classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte; the letters of Latin-1 and Latin Extended-A count as letters."""
    kind = _CLASS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    lead = lead[lead + 1 < len(data)]
    after = data[lead + 1]
    plain = ((data[lead] != 0xC3) | ((after != 0x97) & (after != 0xB7))) & ((data[lead] != 0xC4) | (after != 0xB0))
    kind[lead[plain]] = kind[lead[plain] + 1] = 1
    bar = np.flatnonzero(data[1:] == ord("|"))
    kind[bar[data[bar] == ord("<")]] = 4  # a special token may follow
    return kind


class _Cached:
    """Ids by hash of a piece, in flat arrays."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.slot: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.begin = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int32)

    def during(self, items: Iterator) -> Iterator:
        """The items; when they end, for whatever reason, the cache is emptied."""
        try:
            yield from items
        finally:
            self.clear()

    def _add(self, keys: list[int], lists: list[list[int]]):
        lengths = np.fromiter(map(len, lists), np.int32, len(lists))
        total, first = int(lengths.sum()), len(self.slot)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(keys) > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), np.int32, total)
        self.begin[first : first + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + len(keys)] = lengths
        self.used += total
        self.slot.update(zip(keys, range(first, first + len(keys))))

    def lookup(self, flat: Flat, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Slots of the pieces."""
        distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.slot) + len(distinct) > CACHE:
            self.clear()
        names = distinct.tolist()
        slots = np.array([*map(self.slot.get, names, repeat(-1))], np.int64)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            data = flat.bytes.tobytes()
            where = at[missing]
            texts = [data[a:b].decode("utf-8") for a, b in zip(starts[where].tolist(), ends[where].tolist())]
            slots[missing] = len(self.slot) + np.arange(len(missing))
            self._add(distinct[missing].tolist(), self.encode(texts, plain[where]))
        return slots[back]

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in order, and how many each has."""
        counts = self.length[slots].astype(np.int64)
        rows, place = within(counts)
        return self.ids[self.begin[slots][rows] + place], counts


class WordBpe(_Cached):
    """The byte-pair vocabulary with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        # A task has one core; threads beside it would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def encode(self, texts: list[str], plain: np.ndarray) -> list[list[int]]:
        """Ids of each piece. Plain ones have one pre-token each, so many can go in one text."""
        out: list[list[int] | None] = [None] * len(texts)
        easy = np.flatnonzero(plain).tolist()
        runs = [easy[i : i + _JOIN] for i in range(0, len(easy), _JOIN)]
        coded = self.tokenizer.encode_batch_fast([" ".join(texts[i] for i in run) for run in runs], add_special_tokens=False)
        rest = np.flatnonzero(~plain).tolist()
        for run, code in zip(runs, coded):
            ids = code.ids
            cuts = np.flatnonzero(self.ends[np.array(ids, np.int32)]) + 1
            if len(cuts) != len(run):
                rest += run
                continue
            for i, a, b in zip(run, [0, *cuts[:-1].tolist()], cuts.tolist()):
                out[i] = ids[a:b]
        single = self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        for i, code in zip(rest, single):
            out[i] = code.ids
        return out

    def pieces(self, flat: Flat):
        """Starts, ends, keys, whether plain, and the count per row of the pieces of all rows."""
        starts, ends, counts = flat.words()
        kind = _classes(flat.bytes)
        whole = np.zeros(len(starts), bool)
        if len(starts):
            whole = np.maximum.reduceat(kind, starts) == 4
        rows = np.repeat(np.arange(len(counts)), counts)
        cut = np.zeros(len(flat.bytes), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        cut[kind == 0] = False
        span = np.zeros(len(flat.bytes) + 1, np.int32)
        np.add.at(span, starts[whole], 1)
        np.add.at(span, ends[whole], -1)
        cut &= np.cumsum(span[:-1]) == 0
        cut[starts] = True
        begin = np.flatnonzero(cut)
        word = np.searchsorted(starts, begin, side="right") - 1
        end = np.minimum(ends[word], np.append(begin[1:], len(flat.bytes)))
        keys = flat.hashes(begin, end, lower=True)
        left = whole[word]
        if left.any():
            keys[left] = flat.hashes(begin[left], end[left]) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
        return begin, end, keys, ~left, np.bincount(rows[word], minlength=len(counts))

    def rows(self, flat: Flat) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and how many each row has."""
        starts, ends, keys, plain, counts = self.pieces(flat)
        ids, each = self.gather(self.lookup(flat, starts, ends, keys, plain))
        total = np.concatenate([[0], np.cumsum(each)])
        last = np.cumsum(counts)
        return ids, total[last] - total[last - counts]


class PieceBpe(_Cached):
    """The byte-pair vocabulary with byte fallback, applied word by word."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.is_byte = np.fromiter((self.model.is_byte(i) for i in range(n)), bool, n)

    def encode(self, texts: list[str], plain: np.ndarray) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def words(self, flat: Flat, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each word has."""
        keys = flat.hashes(starts, ends)
        return self.gather(self.lookup(flat, starts, ends, keys, np.ones(len(starts), bool)))


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@cache
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


def public(name: str) -> str:
    """Path of a public vocabulary file of the installed collection."""
    import public_tokenizers

    return public_tokenizers.path(name)
