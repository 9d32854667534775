"""Restoring against trying every path, scores against plain counting, and awkward texts."""

from __future__ import annotations

import random
import re
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from palisade.llm import toxicity
from palisade.llm.flat import SLICE_BYTES

from .helpers import corpus

KIND = "doc_id long, text string, lang string, source string, toxic string, score string, evidence string"
INSULTS = ["idiot", "moron", "stupid", "worthless", "trash", "loser"]


def chances_of(words):
    read = toxicity.tokens(pa.array([" ".join(words)]))
    return toxicity.log_chances(np.bincount(toxicity.trigrams(read), minlength=toxicity.CLASSES**3))


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(5)
    parts = ["th", "er", "an", "ing", "on", "re", "ti", "es", "or", "le", "st", "ou"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(4000)] + INSULTS * 20


def test_trigrams_are_those_of_whole_words():
    read = toxicity.tokens(pa.array(["Ab cÉ, don't", None, "x1y z"]))
    words = [b"ab", "cé".encode(), b"don", b"t", b"z"]  # x1y is to be restored
    expected = []
    for w in words:
        codes = [0, 0, *(int(toxicity._CLASS[b]) for b in w), 0]
        expected += [tuple(codes[i : i + 3]) if i else (0, 0, codes[2]) for i in range(len(w) + 1)]
    n = toxicity.CLASSES
    assert sorted((g // n // n, g // n % n, g % n) for g in toxicity.trigrams(read).tolist()) == sorted(expected)


def test_restoring_takes_the_best_of_all_paths(vocabulary):
    chances = chances_of(vocabulary)

    def score(text):
        total, x, y = 0.0, 0, 0
        for byte in text + b" ":
            if byte == 0x20:
                total += chances[x, y, 0] if y else 0.0
                x = y = 0
            else:
                c = toxicity._CLASS[byte]
                total += chances[x, y, c]
                x, y = y, c
        return total

    rng = random.Random(6)
    disguised = [b"1d10t", b"i d i o t", b"tr@$h", b"st*pid", b"looooser", b"m.o-r.o.n", b"!!", b"a$$$", "éé1".encode()]
    disguised += ["".join(rng.choice("ab1$*.t ") for _ in range(6)).encode() for _ in range(40)]
    for token in disguised:
        steps = toxicity.lattice(token)
        paths = {b"".join(o for o, _ in path): None for path in product(*steps)}
        best = max(
            (sum(c for _, c in path) + score(b"".join(o for o, _ in path)) for path in product(*steps)), default=0.0
        )
        made = toxicity.restore(token, chances)
        assert made[:-1] in paths and made.endswith(b" ")
        assert max(
            sum(c for _, c in path) + score(made[:-1]) for path in product(*steps) if b"".join(o for o, _ in path) == made[:-1]
        ) == pytest.approx(best, abs=1e-4)


@pytest.mark.parametrize("token, word", [
    (b"1d10t", b"idiot"), (b"i d i o t", b"idiot"), (b"i.d.i.o.t", b"idiot"), (b"tr@$h", b"trash"), (b"st*pid", b"stupid"),
    (b"stuuuupid", b"stupid"), (b"m0r0n", b"moron"), (b"w0rthle$$", b"worthless"), (b"l-o-s-e-r", b"loser"),
])
def test_disguises_are_undone(vocabulary, token, word):
    assert toxicity.restore(token, chances_of(vocabulary)).split() == [word]


def test_plain_words_stay_as_they_are():
    read = toxicity.tokens(pa.array(["Well-known words, (quoted) THE!! end.", "next", "a b and c d"]))
    assert not len(read.begins)
    read = toxicity.tokens(pa.array(["one\nx y z w two", "y", "z"]))
    assert [read.flat.bytes[a:b].tobytes() for a, b in zip(read.begins, read.ends)] == [b"x y z w"]


def plain_fold(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def made_docs(vocabulary, n=400):
    """A tenth toxic; of the held-out toxic ones half are disguised."""
    rng = random.Random(2)
    hide = {"i": "1", "o": "0", "s": "$", "a": "@", "e": "3"}
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary[:4000]) for _ in range(rng.randint(20, 60))]
        toxic = i % 10 == 0
        hidden = toxic and plain_fold(i) and i % 20 == 0
        if toxic:
            for w in rng.sample(INSULTS, 3):
                if hidden:
                    w = rng.choice(["".join(hide.get(c, c) for c in w), " ".join(w), "-".join(w)])
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words), None if i % 7 else "en", "s", "clash", "clash", "clash"))
        labels.append((i, 1, int(toxic), "clash"))
    return docs, labels


def test_held_out_documents_are_told_apart_though_disguised(spark, vocabulary):
    docs, labels = made_docs(vocabulary)
    asked = [(1000 + r[0], r[1], *r[2:]) for r in corpus()] + [(None, "idiot moron stupid", *corpus()[0][2:])]
    both = spark.createDataFrame(docs + [r for r in asked], KIND).repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    found = toxicity.toxicity(both, known).collect()
    assert len(found) == len(docs) + len(asked)
    by_id = {r.doc_id: r for r in found}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert by_id[1000].evidence == by_id[1001].evidence == 0 and by_id[None].predicted == 1
    for i, _, toxic, _ in labels:
        r = by_id[i]
        assert r.held_out == plain_fold(i)
        assert r.predicted == toxic
    assert not any(r.predicted for i, r in by_id.items() if i is not None and i >= 1000)


def test_lexicon_equals_plain_counting(spark, vocabulary):
    docs, labels = made_docs(vocabulary, 300)
    model = toxicity.learn(spark.createDataFrame(docs, KIND), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))
    texts = {d[0]: d[1] for d in docs}
    trained = [(texts[i], toxic) for i, _, toxic, _ in labels if not plain_fold(i)]
    held = {}
    for text, toxic in trained:
        assert not re.search(r"[^a-z ]", text)
        words = set(text.split())
        for f in {(0, w) for w in words} | {(k, w[:k]) for w in words for k in toxicity.PREFIXES if len(w) > k}:
            held.setdefault(f, [0, 0])[1 - toxic] += 1
    held = {f: c for f, c in held.items() if c[0] >= toxicity.LEAST}
    n_toxic = sum(t for _, t in trained)
    counts = np.array(list(held.values()), float)
    weight = toxicity.weights(counts[:, 0], counts[:, 1], n_toxic, len(trained) - n_toxic)
    assert sorted(weight[weight > 0].tolist()) == pytest.approx(sorted(model.weight.tolist())) and len(model.weight)


def test_scores_do_not_depend_on_how_texts_are_dealt(spark, vocabulary):
    docs, labels = made_docs(vocabulary, 200)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    odd = [(5000 + i, t, "en", "s", "", "", "") for i, t in enumerate(["a", "$b", "x!", "!y", "i", "d", "aaa", "aa a"])]
    frame = spark.createDataFrame(docs + odd, KIND)
    model = toxicity.learn(frame, known)
    asked = frame.select("doc_id", "text")
    one, many = ({r.doc_id: r.score for r in toxicity.score(asked.repartition(n), model).collect()} for n in (1, 9))
    assert one == many


def test_long_texts_are_read_in_stretches(spark, vocabulary):
    docs, labels = made_docs(vocabulary, 200)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    model = toxicity.learn(spark.createDataFrame(docs, KIND), known)
    filler = " ".join(vocabulary[:4000] * 120)
    assert len(filler) > 2 * SLICE_BYTES
    long = [(1, filler), (2, "st*pid " + filler + " m0r0n " + filler + " moron l o s e r"), (3, "x" * (SLICE_BYTES + 5)), (4, "1" * 100 + "a")]
    scored = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(long, "doc_id long, text string"), model).collect()}
    short = spark.createDataFrame([(2, "stupid moron loser")], "doc_id long, text string")
    assert scored[2].evidence == toxicity.score(short, model).first().evidence > scored[1].evidence == 0
    assert scored[3].evidence == scored[4].evidence == 0


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "one two", *[""] * 5), (2, None, *[""] * 5)], KIND)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity(docs, none).collect()] == [0, 0]
    null = spark.createDataFrame([(None, 1), (1, None), (3, 1)], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity(docs, null).collect()] == [0, 0]
    assert toxicity.toxicity(spark.createDataFrame([], KIND), none).collect() == []
    clean = toxicity.toxicity(spark.createDataFrame([(0, "one two", *[""] * 5)], KIND), spark.createDataFrame([(0, 0)], "doc_id long, toxic int"))
    assert [r.predicted for r in clean.collect()] == [0]
