"""Toxicity of restored text: a noisy channel undone by Viterbi, then a lexicon learned from labels.

Writers hide words: digits and signs for letters, letters set apart, letters said
over and over. A token that shows any of this (``units``) becomes a lattice: each of
its characters, or run of equal ones, has some letters it can stand for, may be
nothing, or may end a word, each at the channel's cost. The path that is likeliest
under a language model over bytes of words is the restored text. The model's trigrams
are counted over the words of all documents, so they grow with the input; the table
has one entry per three byte classes, a fixed size. All other tokens are read as the
runs of letters they hold.

What labels say is learned from at most ``SAMPLE`` documents of each label value, those
whose ids have the smallest hashes. Features are words and their first ``PREFIXES`` bytes.
One enters the lexicon if the documents that hold it are toxic more often than chance
allows (``EVIDENCE``, twice the log likelihood ratio) and than a clean one by the factor
``exp(STRENGTH)``; its weight is the log of that ratio. The evidence of a document is
the sum over its distinct words, each with its heaviest feature, and a logistic curve
fitted on the sample turns it into a score.

Null and empty texts have no evidence. Where a label value has no document, the score
of every text is the share of toxic labels, or 0 without any labels. Labels of one id
count once, as toxic if any says so; ids and labels that are null do not count. Repeated rows get
equal scores. Texts of any length are read in stretches. A token or a row of single
letters over ``LONGEST`` bytes is restored in parts of that length. Other columns are
not read, and ``score`` keeps those it is given but for the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import configure, stored
from palisade.llm.flat import LOWER, SLICE_BYTES, WHITE, Flat, mix, slices

SAMPLE = 30_000
PREFIXES = (4, 5, 6)
LEAST = 3
EVIDENCE = 24.0
STRENGTH = 1.5
MOST_EVIDENCE = 20.0
CANDIDATES = 1 << 19
LEXICON = 20_000
TOXIC_FROM = 0.7
LONGEST = 48
SINGLES = 4
_CACHE = 50_000

# What characters stand for in disguised words.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou",
}
#: Log chances of the channel: a sign for a letter, for nothing, or between words; three signs or more for nothing
#: or between words; a separator for nothing, or between words; a letter said once written twice.
SIGN, NOTHING, PARTING, ROW, APART, BETWEEN, TWICE = -1.0, -8.0, -9.0, -2.0, -0.3, -2.0, -4.0

# Classes of bytes: 0 ends a word, a-z, then those of longer characters.
CLASSES = 27 + 128
_CLASS = np.zeros(256, np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, CLASSES)
_LETTER = _CLASS > 0
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in STANDS_FOR if c != "*"]] = True
_OTHER = ~WHITE & ~_LETTER & ~_SIGN
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


@dataclass
class Tokens:
    """Texts in lower case, a blank after each: which bytes are of plain words, and the spans to restore."""

    flat: Flat
    plain: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


def _lowered(texts: pa.Array) -> Flat:
    flat = Flat(texts)
    rows = np.repeat(np.arange(len(texts)), np.diff(flat.offsets))
    data = np.full(len(flat.bytes) + len(texts), 0x20, np.uint8)
    data[np.arange(len(rows)) + rows] = LOWER[flat.bytes]
    after = data[1:]
    after[(data[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)] += 0x20
    flat.bytes, flat.offsets = data, flat.offsets + np.arange(len(texts) + 1)
    return flat


def _shifted(flags: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros(len(flags), flags.dtype)
    out[: max(len(flags) - by, 0)] = flags[by:]
    return out


def tokens(texts: pa.Array) -> Tokens:
    flat = _lowered(texts)
    data = flat.bytes
    letter, sign, other = _LETTER[data], _SIGN[data], _OTHER[data]
    next_letter, next_byte = _shifted(letter, 1), _shifted(data, 1)
    third_letter = _shifted(letter, 2)
    star = next_byte == ord("*")
    odd = sign & next_letter
    odd |= letter & _shifted(sign, 1) & (next_byte != ord("!"))
    odd |= letter & (data < 128) & (data == next_byte) & (data == _shifted(data, 2))
    odd |= letter & star & third_letter
    odd |= letter & _shifted(other, 1) & ~star & third_letter & _shifted(other, 3) & _shifted(letter, 4)
    starts, ends, counts = flat.words()
    total = np.concatenate([[0], np.cumsum(odd)])
    flagged = total[ends] > total[starts]
    # Rows of single letters, set apart by blanks.
    rows = np.repeat(np.arange(len(counts)), counts)
    single = (ends - starts == 1) & (letter[starts] | sign[starts])
    edge = np.ones(len(starts) + 1, bool)
    edge[1:-1] = (single[1:] != single[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(edge)
    first, last = at[:-1], at[1:] - 1
    row = single[first] & (last - first + 1 >= SINGLES) if len(first) else np.zeros(0, bool)
    begin = np.concatenate([starts[flagged], starts[first[row]]])
    end = np.concatenate([ends[flagged], ends[last[row]]])
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, begin, 1)
    np.add.at(cover, end, -1)
    return Tokens(flat, letter & (np.cumsum(cover[:-1]) == 0), begin, end)


# --- language model --------------------------------------------------------

def trigrams(read: Tokens) -> np.ndarray:
    """Places in the table of all trigrams of the plain words, ends of words included."""
    now = np.where(read.plain, _CLASS[read.flat.bytes], 0)
    before = np.concatenate([[0], now[:-1]])
    earlier = np.concatenate([[0], before[:-1]]) * (before > 0)
    kept = (now > 0) | (before > 0)
    return ((earlier * CLASSES + before) * CLASSES + now)[kept]


def log_chances(counts: np.ndarray) -> np.ndarray:
    """Log chance of a byte class after two others, interpolated over shorter contexts."""
    three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    share = lambda x: x / np.maximum(x.sum(axis=-1, keepdims=True), 1)
    mixed = 0.7 * share(three) + 0.2 * share(two)[None] + 0.09 * share(one)[None, None] + 0.01 / CLASSES
    return np.log(mixed).astype(np.float32)


def language_model(docs: DataFrame) -> np.ndarray:
    """The table of ``log_chances`` over the words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for _, read in stretches(batches):
            total += np.bincount(trigrams(read), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    counts = np.zeros(CLASSES**3)
    for gram, n in docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] = n
    return log_chances(counts)


# --- restoring -------------------------------------------------------------

def lattice(token: bytes) -> list[list[tuple[bytes, float]]]:
    """Per run of equal bytes, what it can stand for and the log chance of that; a blank ends a word."""
    steps = []
    for byte, run in groupby(token):
        size = len(list(run))
        char = bytes([byte])
        if _LETTER[byte] and byte >= 128:
            steps.append([(char * size, 0.0)])
        elif _LETTER[byte]:
            steps.append([(char, 0.0)] if size == 1 else [(char, TWICE if size == 2 else 0.0), (char * 2, 0.0)])
        else:
            if _SIGN[byte]:
                found = [(b"", NOTHING), (b" ", PARTING)] if size < 3 else [(b"", ROW), (b" ", ROW)]
            else:
                found = [(b"", APART), (b" ", BETWEEN)]
            for letter in STANDS_FOR.get(chr(byte), "").encode():
                found.append((bytes([letter]), SIGN + (TWICE if size == 2 else 0.0)))
                if size > 1:
                    found.append((bytes([letter]) * 2, SIGN))
            steps.append(found)
    return steps


def restore(token: bytes, chances: np.ndarray) -> bytes:
    """The likeliest words behind a token, by Viterbi over (two classes before) as states."""
    states = {(0, 0): (0.0, b"")}
    for step in [*lattice(token), [(b" ", 0.0)]]:
        reached: dict[tuple[int, int], tuple[float, bytes]] = {}
        for (a, b), (score, text) in states.items():
            for out, cost in step:
                x, y, total = a, b, score + cost
                for byte in out:
                    if byte == 0x20:
                        if y:
                            total += chances[x, y, 0]
                        x = y = 0
                    else:
                        c = _CLASS[byte]
                        total += chances[x, y, c]
                        x, y = y, c
                held = reached.get((x, y))
                if held is None or total > held[0]:
                    reached[x, y] = (total, text + out)
        states = reached
    return max(states.values())[1]


class Restorer:
    """Restores spans, each distinct one once."""

    def __init__(self, chances: np.ndarray):
        self.chances = chances
        self.known: dict[bytes, bytes] = {}

    def __call__(self, token: bytes) -> bytes:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= _CACHE:
                self.known.clear()
            parts = [token[i : i + LONGEST] for i in range(0, len(token), LONGEST)]
            found = self.known[token] = b" ".join(restore(p, self.chances) for p in parts)
        return found


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Rows with their tokens; a long text comes in several stretches, cut at blanks."""
    for part in slices(batches):
        texts = part.column("text")
        if part.num_rows == 1 and (text := texts[0].as_py()) is not None and len(text) > SLICE_BYTES:
            data, at = text.encode(), 0
            while at < len(data):
                cut = _SPACE.search(data, at + SLICE_BYTES)
                end = len(data) if cut is None else cut.start()
                yield part, tokens(pa.array([data[at:end]], pa.large_binary()).cast(pa.large_string()))
                at = end
        else:
            yield part, tokens(texts)


def features(read: Tokens, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word of the restored texts, and the hashes of the word and its prefixes (0 where it has none)."""

    def of(flat: Flat, letters: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], letters.astype(np.int8), [0]])))
        starts, ends = edges[::2], edges[1::2]
        columns = [flat.hashes(starts, ends)]
        for k in PREFIXES:
            prefix = mix(flat.hashes(starts, np.minimum(starts + k, ends)) + np.uint64(k))
            columns.append(np.where(ends - starts > k, prefix, np.uint64(0)))
        return owner[np.searchsorted(flat.offsets, starts, side="right") - 1], np.stack(columns, axis=1)

    rows, hashes = of(read.flat, read.plain, np.arange(len(read.flat.offsets) - 1))
    if not len(read.begins):
        return rows, hashes
    data = read.flat.bytes.tobytes()
    words = [restorer(data[a:b]) for a, b in zip(read.begins.tolist(), read.ends.tolist())]
    owner = np.searchsorted(read.flat.offsets, read.begins, side="right") - 1
    # Parts of a character at the edge of a long token are no words of their own.
    made = Flat(pa.array([w + b" " for w in words], pa.large_binary()).view(pa.large_string()))
    more, extra = of(made, _LETTER[made.bytes], owner)
    return np.concatenate([rows, more]), np.concatenate([hashes, extra])


# --- what labels say -------------------------------------------------------

def fold(column: str = "doc_id") -> Column:
    """True for the documents held out: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of the labelled documents to learn from: ``sample`` ids per label value at most."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("toxic") > 0).alias("toxic")
    )
    drawn = [
        known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for value in (True, False)
    ]
    # The bound is 2 * sample rows of an id and a flag.
    return docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").select("text", "toxic")


def _counted(rows: DataFrame, chances, known=None) -> DataFrame:
    """feature, n: documents that hold each feature, of those in ``known`` where given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(chances.value)
        pending: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(pending), return_counts=True)
            pending.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["feature", "n"])

        for part, of_part in groupby(stretches(batches), key=lambda x: id(x[0])):
            held = []
            for _, read in of_part:
                row, hashes = features(read, restorer)
                row, hashes = np.repeat(row, hashes.shape[1]), hashes.ravel()
                keep = hashes != 0
                if known is not None:
                    keep &= _place(known.value, hashes) >= 0
                held.append(np.unique(np.stack([row[keep].astype(np.uint64), hashes[keep]], axis=1), axis=0))
            both = held[0] if len(held) == 1 else np.unique(np.concatenate(held), axis=0)
            pending.append(both[:, 1])
            if sum(map(len, pending)) > 500_000:
                yield counted()
        if pending:
            yield counted()

    return rows.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _place(sorted_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash among the sorted ones, or -1."""
    if not len(sorted_hashes):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == hashes, at, -1)


def weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log ratio of the shares of toxic and clean documents that hold a feature; 0 where it says nothing."""
    held = toxic + clean
    share = n_toxic / (n_toxic + n_clean)
    log = lambda x, by: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / by), 0.0)
    ratio = 2 * (log(toxic, held * share) + log(clean, held * (1 - share)))
    weight = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return np.where((ratio >= EVIDENCE) & (weight >= STRENGTH), weight, 0.0)


@dataclass(frozen=True)
class Model:
    """Language model, lexicon (sorted hashes and weights), and the curve from evidence to score."""

    chances: np.ndarray
    lexicon: np.ndarray
    weight: np.ndarray
    base: float
    slope: float

    def evidence(self, words: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
        """Evidence of each row from the words of its stretches."""
        found = []
        for row, hashes in words:
            weight = np.zeros(len(row))
            for column in hashes.T:
                at = _place(self.lexicon, column)
                hit = at >= 0
                weight[hit] = np.maximum(weight[hit], self.weight[at[hit]])
            hit = weight > 0
            found.append((row[hit], hashes[hit, 0], weight[hit]))
        row, word, weight = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((word, row))
        row, word, weight = row[order], word[order], weight[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
        return np.minimum(np.bincount(row[new], weight[new], rows), MOST_EVIDENCE)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + self.slope * evidence)))


def curve(evidence: np.ndarray, toxic: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Base and slope of the logistic curve, by Newton's steps with a small ridge on the slope; it never falls."""
    share = (times * toxic).sum() / times.sum()
    base, slope = float(np.log(share / (1 - share))), 0.0
    x = np.stack([np.ones(len(evidence)), evidence], axis=1)
    at = np.array([base, slope])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slopes = x.T @ (times * (toxic - p)) - np.array([0.01, 0.1]) * at
        bend = (x * (times * p * (1 - p))[:, None]).T @ x + np.diag([0.01, 0.1])
        at = at + np.clip(np.linalg.solve(bend, slopes), -2, 2)
    return (float(at[0]), float(at[1])) if at[1] > 0 else (base, 0.0)


def _evidences(chances_and_model) -> Callable:
    """Maps rows to themselves but for the text, with their evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = chances_and_model.value
        restorer = Restorer(model.chances)
        for part, of_part in groupby(stretches(batches), key=lambda x: id(x[0])):
            # Only words of the lexicon are kept from one stretch to the next.
            found, rows = [], 0
            for batch, read in of_part:
                rows = batch.num_rows
                row, hashes = features(read, restorer)
                hit = np.zeros(len(row), bool)
                for column in hashes.T:
                    hit |= _place(model.lexicon, column) >= 0
                found.append((row[hit], hashes[hit]))
            names = [n for n in batch.schema.names if n != "text"]
            evidence = model.evidence(found, rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(evidence)], [*names, "evidence"])

    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model: language from all ``docs``, weights from the labelled ones among them."""
    spark = configure(docs.sparkSession)
    chances = language_model(docs)
    rows = stored(training_rows(docs.where(~fold()), labels, sample))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    nothing = np.zeros(0)
    if not n_toxic or not n_clean:
        share = 0.0 if not n_toxic else 1.0
        return Model(chances, nothing.astype(np.uint64), nothing, 50.0 if share else -50.0, 0.0)
    held = spark.sparkContext.broadcast(chances)
    toxic = _counted(rows.where("toxic"), held).where(F.col("n") >= LEAST).orderBy(F.col("n").desc(), "feature").limit(CANDIDATES).toPandas()
    names = toxic["feature"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(names)
    names, in_toxic = names[order], toxic["n"].to_numpy()[order].astype(np.float64)
    in_clean = np.zeros(len(names))
    for feature, n in _counted(rows.where("not toxic"), held, spark.sparkContext.broadcast(names)).collect():
        in_clean[_place(names, np.array([feature], np.int64).view(np.uint64))[0]] = n
    weight = weights(in_toxic, in_clean, n_toxic, n_clean)
    chosen = np.sort(np.argsort(-weight, kind="stable")[:LEXICON])
    chosen = chosen[weight[chosen] > 0]
    model = Model(chances, names[chosen], weight[chosen], 0.0, 0.0)
    held = spark.sparkContext.broadcast(model)
    bins = rows.mapInArrow(_evidences(held), "toxic boolean, evidence double").groupBy(
        "toxic", F.round("evidence", 1).alias("evidence")
    ).count().toPandas()
    base, slope = curve(bins["evidence"].to_numpy(), bins["toxic"].to_numpy().astype(float), bins["count"].to_numpy().astype(float))
    return Model(chances, model.lexicon, model.weight, base, slope)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs but for the text, with ``evidence``, ``score`` and ``predicted``."""
    spark = configure(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)
    kept = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text")
    rows = docs.mapInArrow(_evidences(held), f"{kept}, evidence double")
    curve = 1 / (1 + F.exp(-(F.lit(model.base) + F.lit(model.slope) * F.col("evidence"))))
    return rows.withColumn("score", curve).withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, evidence, score and predicted of all documents, learned from those not held out."""
    model = learn(docs, labels)
    return score(docs.select("doc_id", fold().alias("held_out"), "text"), model)
