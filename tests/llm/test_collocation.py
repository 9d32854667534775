"""Phrase mining against plain counting and its SQL, on awkward texts and on nothing at all."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from palisade.llm import collocation
from palisade.llm.flat import SLICE_BYTES

from .helpers import corpus

KIND = "doc_id long, text string, lang string, source string, n_chars long, row string, word string"


def plain(rows, least, top):
    """lang -> [(rank, phrase, a, l, r, n, score)] from (text, lang)."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                counts.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    longest = Counter()
    for (lang, words), a in found.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                part = lang, words[i : i + m]
                longest[part] = max(longest[part], a)
    out = {}
    for (lang, words), a in found.items():
        if 100 * longest[lang, words] >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((" ".join(words), a, left, right, totals[lang], score))
    for lang, items in out.items():
        items.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out[lang] = [(i + 1, *x) for i, x in enumerate(items[:top])]
    return out


def mined(docs, **options):
    out = {}
    for r in collocation.collocations(docs, **options).collect():
        out.setdefault(r.lang, []).append((r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score))
    return {lang: sorted(rows) for lang, rows in out.items()}


def texts():
    rng = random.Random(9)
    small = ["the", "of", "House", "house", "é", "日本", "x-y", "n0"]
    rows = [(i, " ".join(rng.choice(small) + rng.choice(["", "", "", ",", ".\n", "\t"]) for _ in range(rng.randint(0, 60))), rng.choice([None, "en", "fr", "und"]))
            for i in range(60)]
    rows += [(100 + i, "Licensed under the Apache License, version two of the house", "en") for i in range(40)]
    rows += [(r[0], r[1], r[2]) for r in corpus()]
    return [(i, t, lang, "s", None, "clash", "clash") for i, t, lang in rows]


@pytest.mark.parametrize("budget", [40, 2_000_000])
def test_phrases_equal_plain_counts(spark, monkeypatch, budget):
    rows = texts()
    monkeypatch.setattr(collocation, "GATHER", 300)
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    for least, top in ((3, 2000), (30, 5)):
        expected = plain([(r[1], r[2]) for r in rows], least, top)
        assert mined(docs, top=top, least=least, budget=budget) == expected and expected["en"]


def test_sql_agrees(spark):
    rows = texts() * 6
    docs = spark.createDataFrame(rows, KIND)
    db = duckdb.connect()
    documents = pa.table({"text": [r[1] for r in rows], "lang": [r[2] for r in rows]})
    db.register("documents", documents)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = sorted(db.sql(f"SELECT {', '.join(names)} FROM ({collocation.SQL})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in collocation.collocations(docs).collect()) == expected and expected


def test_long_texts_are_read_in_stretches(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "\n"]) for _ in range(900_000))
    assert len(text) > 3 * SLICE_BYTES
    docs = spark.createDataFrame([(1, text, "en"), (2, "a" * (SLICE_BYTES + 9), "en")], "doc_id long, text string, lang string")
    assert mined(docs, top=300) == plain([(text, "en"), ("a" * (SLICE_BYTES + 9), "en")], 30, 300)


def test_stretches_count_each_word_once():
    rng = random.Random(8)
    text = " ".join("v" * rng.randint(1, 9) for _ in range(500_000))
    batch = pa.record_batch({"lang": ["en"], "text": [text]})
    parts = list(collocation.stretches(iter([batch]), 0))
    assert len(parts) > 2 and sum(s.own for s in parts) == 500_000
    assert all(len(s.ids) - s.own == 3 for s in parts[:-1])


def test_words_with_one_hash_take_another_seed(spark, monkeypatch):
    seed = collocation._seed
    monkeypatch.setattr(collocation, "_seed", lambda lang, n: seed(lang if n else "", n))
    same = spark.createDataFrame([("one two", "en"), ("one", "fr")], "text string, lang string")
    words, used = collocation.count_words(same)
    # Run in this process: without a seed both languages share the hash of a word.
    batch = pa.record_batch({"lang": ["en", "fr"], "text": ["one", "one"]})
    first, second = (np.concatenate([s.ids for s in collocation.stretches(iter([batch]), n)]) for n in (0, 1))
    assert first[0] == first[1] and second[0] != second[1]
    assert sorted((r.lang, r.word, r.n) for r in words.collect()) == [("en", "one", 1), ("en", "two", 1), ("fr", "one", 1)] and used in (0, 1)


def test_equal_hashes_of_suffixes_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocation, "_hash", lambda ids: np.zeros(len(ids), np.uint64))
    ids = np.array([[1, 2], [3, 4], [1, 2]], np.uint64)
    found, times = collocation._gathered(ids)
    assert {tuple(i): t for i, t in zip(found.tolist(), times.tolist())} == {(1, 2): 2, (3, 4): 1}


def test_oversized_prefixes_are_dealt(spark):
    sizes = spark.createDataFrame([(7 << 60, 1000), (1, 3), (2, 4)], "prefix long, n long")
    groups = collocation.partition(sizes, 100)
    rng = np.random.default_rng(1)
    suffixes = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    dealt, whole = groups.of(np.full(500, 7 << 60, np.uint64), suffixes)
    assert len(set(dealt.tolist())) == 20 and not whole.any()
    one, whole = groups.of(np.array([1, 2], np.uint64), suffixes[:2])
    assert one[0] == one[1] and whole.all() and one[0] not in dealt


def test_nothing_gives_nothing(spark):
    assert mined(spark.createDataFrame([], KIND)) == {}
    assert mined(spark.createDataFrame([(1, None, None), (2, " ", "en"), (3, "one", "en")], "doc_id long, text string, lang string")) == {}
