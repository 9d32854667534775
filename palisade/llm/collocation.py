"""Phrase mining by vertical partitioning: depth-truncated suffix subtrees built group by group.

All phrases of up to ``DEPTH`` words are the upper nodes of a suffix tree over
words, cut off at that depth; a node's count is the sum of the leaves below it. The
tree is never whole anywhere. Prefixes are grouped so that each group has about
``BUDGET`` suffixes, a suffix goes to the group of its prefix, and a group's sorted
suffixes are its subtree in depth-first order: leaf totals are runs of equal
suffixes, node counts are sums over runs, all in one sweep over a batch at a time.

The text is read in rounds of growing depth, as a prefix that occurs fewer than
``least`` times has nothing to extend. Round one counts words. Round two takes
suffixes of two words, both frequent, grouped by first word. Round three takes
suffixes of three and four words whose pairs are all frequent, grouped by first pair.
"Frequent" is looked up in a bitmap over hashes of at most ``MOST_BITS`` bits, which
lets some rare ones pass and never stops a frequent one. Sizes of prefixes are known
from the round before. They are added up per bucket of hashes, at most
``MOST_BUCKETS``, and buckets are packed into groups in order; one over the budget
is dealt out by whole suffixes, and its node counts are added up afterwards. Equal
suffixes are added up before they are sent, so a phrase that a third of all
documents repeat is a few rows.

Words are known by 64-bit hashes of language and word. That no two words share one
is verified on the counted words, and another seed is taken if they do, so counts
are exact.

A text is read in stretches of about a megabyte, cut between words, with the
words that follow. Null texts are empty; null languages are ``und``, as is a
language of that name. Repeated rows count as often as they occur. A table without
words gives no rows. Only ``lang`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import configure, stored
from palisade.llm.flat import SLICE_BYTES, Flat, mix, slices, within

DEPTH = 4
LEAST = 30
INSIDE_PERCENT = 80
SCALE = 2_000_000
TOP = 2000
UNKNOWN = "und"
BUDGET = 250_000
MOST_BUCKETS = 1 << 20
MOST_BITS = 1 << 28
#: Suffixes a task gathers before it adds up equal ones and sends them.
GATHER = 800_000
_SALTS = 64

BREAKS = b".,;:!?\n\x0b\x0c\r"
_READ = np.arange(256, dtype=np.uint8)
_READ[65:91] += 32
_READ[list(BREAKS)] = 10
_WORD = re.compile(rb"[^\x20\x09-\x0D.,;:!?]+")
_NEXT = re.compile(rb"[\x20\x09-\x0D.,;:!?][^\x20\x09-\x0D.,;:!?]")
_MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)]

SQL = f"""
WITH pieces AS (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\\x0A-\\x0D]'
    )) AS piece FROM documents
), worded AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces
), spots AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded
), phrases AS (
    SELECT lang, m, words[i:i + m - 1] AS phrase FROM spots, range(1, {DEPTH + 1}) AS r(m) WHERE i + m - 1 <= len(words)
), counts AS (
    SELECT lang, m, phrase, count(*) AS f FROM phrases GROUP BY ALL
), candidates AS (
    SELECT * FROM counts WHERE m >= 2 AND f >= {LEAST}
), cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, k, p.f AS l, s.f AS r, ({SCALE}::HUGEINT * c.f) // (p.f + s.f) AS score
    FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
    JOIN counts p ON p.lang = c.lang AND p.phrase = c.phrase[1:k]
    JOIN counts s ON s.lang = c.lang AND s.phrase = c.phrase[k + 1:]
), scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), parts AS (
    SELECT c.lang, c.phrase[i:j] AS phrase, max(c.f) AS longest
    FROM candidates c, range(1, {DEPTH}) AS x(i), range(2, {DEPTH + 1}) AS y(j)
    WHERE j > i AND j <= c.m AND j - i + 1 < c.m GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang
), kept AS (
    SELECT s.lang, array_to_string(s.phrase, ' ') AS phrase, a, l, r, n, score
    FROM scored s JOIN totals USING (lang) LEFT JOIN parts p ON p.lang = s.lang AND p.phrase = s.phrase
    WHERE coalesce(100::HUGEINT * p.longest < {INSIDE_PERCENT}::HUGEINT * a, true)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
    phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= {TOP}
"""


# --- reading ---------------------------------------------------------------

@dataclass
class Stretch:
    """Words of some texts: hashed, whose text they are of, and whether the next one goes on the same piece."""

    bytes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    langs: list[str]
    joined: np.ndarray
    #: Words that count here; those after only follow.
    own: int


def _seed(lang: str, seed: int) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


def _parts(text: bytes) -> Iterator[tuple[bytes, int]]:
    """Stretches of a long text, with how many of their bytes are their own; the rest are the words that follow."""
    at = 0
    while at < len(text):
        cut = _NEXT.search(text, at + SLICE_BYTES)
        end = len(text) if cut is None else cut.end() - 1
        last = end
        for word in islice(_WORD.finditer(text, end), DEPTH - 1):
            last = word.end()
        yield text[at:last], end - at
        at = end


def stretches(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[Stretch]:
    for part in slices(batches):
        langs = [UNKNOWN if x is None else x for x in part.column("lang").to_pylist()]
        texts = part.column("text")
        if part.num_rows == 1 and (text := texts[0].as_py()) is not None and len(text) > SLICE_BYTES:
            for piece, own in _parts(text.encode()):
                yield _read(pa.array([piece], pa.large_binary()).cast(pa.large_string()), langs, seed, own)
        else:
            yield _read(texts, langs, seed, None)


def _read(texts: pa.Array, langs: list[str], seed: int, own: int | None) -> Stretch:
    flat = Flat(texts)
    flat.bytes = _READ[flat.bytes]
    starts, ends, counts = flat.words()
    rows = np.repeat(np.arange(len(counts)), counts)
    of = {x: _seed(x, seed) for x in set(langs)}
    ids = mix(flat.hashes(starts, ends) + np.array([of[x] for x in langs], np.uint64)[rows])
    ids[ids == 0] = 1
    piece = np.cumsum(flat.bytes == 10)[starts] if len(starts) else np.zeros(0, np.int64)
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (piece[1:] == piece[:-1]) & (rows[1:] == rows[:-1])
    return Stretch(flat.bytes, starts, ends, ids, rows, langs, joined, len(starts) if own is None else int(np.searchsorted(starts, own)))


def _gathered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ids and how often each occurs; rows are compared in full, not by their hash only."""
    _, first, back, times = np.unique(_hash(ids), return_index=True, return_inverse=True, return_counts=True)
    odd = (ids != ids[first[back]]).any(axis=1)
    if odd.any():
        whole, times = np.unique(ids, axis=0, return_counts=True)
        return whole, times
    return ids[first], times


def _hash(ids: np.ndarray) -> np.ndarray:
    total = np.zeros(len(ids), np.uint64)
    for k in range(ids.shape[1]):
        total = mix(total + ids[:, k]) * _MULTIPLIERS[k]
    return mix(total)


# --- round one: words ------------------------------------------------------

def _count_words(seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in stretches(batches, seed):
            ids, first, times = np.unique(s.ids[: s.own], return_index=True, return_counts=True)
            lengths = s.ends[first] - s.starts[first]
            word, place = within(lengths)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            data = np.ascontiguousarray(s.bytes[s.starts[first][word] + place])
            words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data))
            langs = pa.DictionaryArray.from_arrays(pa.array(s.rows[first].astype(np.int32)), pa.array(s.langs, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.view(np.int64)), langs.cast(pa.string()), words, pa.array(times)], ["id", "lang", "word", "n"]
            )

    return run


def count_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """id, lang, word, n of all words, ids being unique, and the seed that makes them so."""
    for seed in count():
        words = stored(
            docs.select("lang", "text").mapInArrow(_count_words(seed), "id long, lang string, word string, n long")
            .groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))
        )
        if words.groupBy("id").count().where("count > 1").limit(1).count() == 0:
            return words, seed


# --- vertical partitioning -------------------------------------------------

@dataclass
class Groups:
    """Which group each bucket of prefixes belongs to, and over how many groups an oversized one is dealt."""

    shift: int
    first: np.ndarray
    spread: np.ndarray

    def of(self, prefixes: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group of each suffix, and whether its prefix has all its suffixes there."""
        bucket = (prefixes >> np.uint64(self.shift)).astype(np.int64)
        spread = self.spread[bucket]
        dealt = (mix(suffixes + np.uint64(7)) % spread.astype(np.uint64)).astype(np.int64)
        return (self.first[bucket] + dealt).astype(np.int32), spread == 1


def partition(prefixes: DataFrame, budget: int) -> Groups:
    """Groups of about ``budget`` suffixes over prefixes (``prefix`` a hash, ``n``)."""
    total = prefixes.agg(F.sum("n")).first()[0] or 0
    wanted = min(MOST_BUCKETS, max(256, 16 * -(-total // budget)))
    bits = (wanted - 1).bit_length()
    sizes = np.zeros(1 << bits, np.int64)
    for bucket, n in prefixes.groupBy(F.shiftrightunsigned("prefix", 64 - bits).alias("bucket")).agg(F.sum("n").cast("long")).collect():
        sizes[bucket] = n
    budget = max(budget, -(-total * 16 // MOST_BUCKETS))
    spread = np.maximum(-(-2 * sizes // budget), 1)
    spread[sizes <= budget] = 1
    first = np.zeros(len(sizes), np.int64)
    group, room = 0, budget
    for b, (size, parts) in enumerate(zip(sizes.tolist(), spread.tolist())):
        if parts > 1:
            group += 1
            first[b] = group
            group += parts
            room = budget
        else:
            if size > room:
                group, room = group + 1, budget
            first[b] = group
            room -= size
    return Groups(64 - bits, first, spread)


def bitmap(ids: DataFrame) -> np.ndarray:
    """One bit per hash value modulo a power of two: set for every one of ``ids.id``."""
    n = ids.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    place = F.col("id").bitwiseAND(F.lit(bits - 1)) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    out = np.zeros(bits // 8, np.uint8)
    for block, data in rows.collect():
        at = (block - 1) * 4096
        part = np.frombuffer(bytes(data), np.uint8)
        out[at : at + len(part)] = part[: len(out) - at]
    return out


def _held(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = (ids & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


# --- rounds two and three: suffixes to groups, subtrees ---------------------

def _ahead(found: np.ndarray, by: int) -> np.ndarray:
    """Where ``found`` holds ``by`` words on."""
    out = np.zeros(len(found), bool)
    out[:-by] = found[by:]
    return out


def _pairs(s: Stretch, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that begin a pair of frequent words, and the pairs' ids."""
    known = _held(words, s.ids)
    good = known & s.joined
    good[:-1] &= known[1:]
    good[-1:] = False
    place = np.flatnonzero(good)
    return place, np.stack([s.ids[place], s.ids[place + 1]], axis=1)


def _send(groups: Groups, gathered: list[np.ndarray], prefix: int) -> pa.RecordBatch:
    ids, times = _gathered(np.concatenate(gathered))
    heads = ids[:, 0] if prefix == 1 else _hash(ids[:, :prefix])
    group, whole = groups.of(heads, _hash(ids))
    return pa.RecordBatch.from_arrays(
        [pa.array(group), pa.array(whole), *(pa.array(ids[:, k].view(np.int64)) for k in range(ids.shape[1])), pa.array(times)],
        ["group", "whole", *(f"w{k + 1}" for k in range(ids.shape[1])), "n"],
    )


def _sent(held, seed: int, prefix: int) -> Callable:
    """Suffixes of two words after prefixes of one, or of three and four words after pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, groups = held.value
        gathered, size = [], 0
        for s in stretches(batches, seed):
            if not len(s.ids):
                continue
            place, ids = _pairs(s, words)
            if prefix == 2:
                pair = np.zeros(len(s.ids), bool)
                pair[place] = _held(pairs, _hash(ids))
                three = pair & _ahead(pair, 1)
                four = three & _ahead(pair, 2)
                place = np.flatnonzero(three)
                last = s.ids[np.minimum(place + 3, len(s.ids) - 1)] * four[place].astype(np.uint64)
                ids = np.stack([*(s.ids[place + k] for k in range(3)), last], axis=1)
            gathered.append(ids[place < s.own])
            size += len(gathered[-1])
            if size > GATHER:
                yield _send(groups, gathered, prefix)
                gathered, size = [], 0
        if size:
            yield _send(groups, gathered, prefix)

    return run


def _subtrees(depths: tuple[int, ...], least: int) -> Callable:
    """Node counts from suffixes in order of (group, words); a node cut by a batch's edge comes in parts.

    Nodes that are whole and too rare are left out; parts (``whole`` false) are to
    be added up.
    """
    names = [f"w{k + 1}" for k in range(max(depths))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("group").to_numpy()
            whole = batch.column("whole").to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy()
            ids = [batch.column(w).to_numpy() for w in names]
            new = np.ones(len(n), bool)
            new[1:] = group[1:] != group[:-1]
            for k, column in enumerate(ids):
                new[1:] |= column[1:] != column[:-1]
                if k + 1 not in depths:
                    continue
                at = np.flatnonzero(new)
                totals = np.add.reduceat(n, at)
                # A suffix that ended before this depth has no node here.
                inside = column[at] != 0
                # Suffixes as deep as they are cut lie in one group; others only if their prefix does.
                done = whole[at] | (k + 1 == max(depths))
                done[0] = done[-1] = False
                keep = inside & (~done | (totals >= least))
                deeper = np.zeros(int(keep.sum()), np.int64)
                columns = [ids[j][at][keep] if j <= k else deeper for j in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c) for c in columns), pa.array(done[keep]), pa.array(totals[keep])], [*names, "whole", "a"]
                )

    return run


def _nodes(docs: DataFrame, bits: tuple, groups: Groups, seed: int, prefix: int, least: int) -> DataFrame:
    """w1.. and a of the nodes that occur ``least`` times or more."""
    width, depths = (2, (2,)) if prefix == 1 else (4, (3, 4))
    held = docs.sparkSession.sparkContext.broadcast((*bits, groups))
    words = [f"w{k + 1}" for k in range(width)]
    kinds = ", ".join(f"{w} long" for w in words)
    suffixes = docs.select("lang", "text").mapInArrow(_sent(held, seed, prefix), f"group int, whole boolean, {kinds}, n long")
    found = stored(
        suffixes.repartition("group").sortWithinPartitions("group", *words)
        .mapInArrow(_subtrees(depths, least), f"{kinds}, whole boolean, a long")
    )
    parts = found.where("not whole").groupBy(*words).agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return found.where("whole").drop("whole").unionByName(parts)


def _hashed(first: str, second: str) -> Callable:
    """The hash of a pair of ids, as ``_hash`` makes it, for Spark columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in (first, second)], axis=1)
            hashes = _hash(ids).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(hashes), batch.column("a")], ["id", "prefix", "n"])

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """All words (id, lang, word, n), and the phrases (ids, a) of 2 to ``DEPTH`` words that occur ``least`` times or more."""
    configure(docs.sparkSession)
    words, seed = count_words(docs)
    often = words.where(F.col("n") >= least)
    known = bitmap(often)
    groups = partition(often.select(F.col("id").alias("prefix"), "n"), budget)
    pairs = stored(_nodes(docs, (known, None), groups, seed, 1, least))
    hashed = stored(pairs.mapInArrow(_hashed("w1", "w2"), "id long, prefix long, n long"))
    groups = partition(hashed, budget)
    deeper = _nodes(docs, (known, bitmap(hashed)), groups, seed, 2, least)
    ids = lambda n: F.filter(F.array(*[f"w{k + 1}" for k in range(n)]), lambda w: w != 0).alias("ids")
    phrases = stored(pairs.select(ids(2), "a").unionByName(deeper.select(ids(4), "a")))
    return words, phrases


# --- scores ----------------------------------------------------------------

def scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """ids, lang, a, l, r, score of each phrase at its lowest-scoring cut."""
    counts = phrases.where(F.size("ids") < DEPTH).select("ids", F.col("a").alias("f"), F.lit(None).cast("string").alias("lang"))
    counts = counts.unionByName(words.select(F.array("id").alias("ids"), F.col("n").alias("f"), "lang"))
    part = lambda name: counts.select(F.col("ids").alias(name), F.col("f").alias(f"{name}_f"), F.col("lang").alias(f"{name}_lang"))
    cuts = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")).select(
        "*", F.slice("ids", F.lit(1), F.col("k")).alias("left"),
        F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right"),
    )
    met = cuts.join(part("left"), "left").join(part("right"), "right").withColumnsRenamed({"left_f": "l", "right_f": "r"})
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = met.groupBy("ids").agg(
        F.max("left_lang").alias("lang"), F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    )
    return best.select("ids", "lang", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))


def independent(phrases: DataFrame, scores: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """The scored phrases that no longer phrase holds nearly as often."""
    inner = [(i, m) for m in range(2, DEPTH) for i in range(1, DEPTH - m + 2)]
    parts = F.array(*[
        F.when(F.size("ids") >= max(i + m - 1, m + 1), F.slice("ids", i, m)) for i, m in inner
    ])
    longer = phrases.where(F.size("ids") > 2).select(F.explode(F.array_compact(parts)).alias("ids"), F.col("a").alias("longer"))
    most = longer.groupBy("ids").agg(F.max("longer").alias("longer"))
    exact = lambda name: F.col(name).cast("decimal(20,0)")
    held = exact("longer") * 100 >= exact("a") * percent
    return scores.join(most, "ids", "left").where(~F.coalesce(held, F.lit(False))).drop("longer")


def _named(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``phrase``, the words of ids joined by spaces."""
    names = words.select("id", "word")
    spelt = (
        phrases.select("ids", F.posexplode("ids").alias("place", "id")).join(names, "id")
        .groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
        .select("ids", F.array_join(F.col("words.word"), " ").alias("phrase"))
    )
    return phrases.join(spelt, "ids")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's highest-scoring phrases.

    Ranks are found in two steps, per language and salt and then per language,
    so that no task sees all phrases of one language.
    """
    words, phrases = phrase_counts(docs, least, budget)
    often = words.where(F.col("n") >= least)
    kept = independent(phrases, scored(often, phrases)).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(_SALTS)))
    order = [F.col("score").desc(), F.col("a").desc()]
    # Equal ones all stay until they are told apart by their words.
    some = kept.withColumn("rank", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    named = _named(stored(some), often)
    order = [*order, F.col("phrase")]
    for keys in (["lang", "salt"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        named = named.withColumn("rank", place).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return named.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
