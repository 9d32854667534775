"""Exact repeats whose lines are frequent elsewhere, against comparing all texts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from palisade.llm import compact


def made(groups, seed=11):
    """Per group 17 texts: two share a passage of three lines, the others hold its lines in other surroundings."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    say = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for g in range(groups):
        lines = [say(20) for _ in range(3)]
        for i in range(17):
            if i in (9, 14):
                text = f"{say(30)} {' '.join(lines)} {say(30)}"
            else:
                mixed = [f"{line} {say(rng.randint(5, 30))}" for line in rng.sample(lines, 3)]
                text = f"{say(10)} {' '.join(mixed)} {say(10)}"
            rows.append((100 * g + i, text))
    return rows


def repeats(rows, words=50):
    """(later, earlier) of all pairs with a run of so many words in common."""
    first, found = {}, set()
    for i, text in rows:
        w = text.split()
        for run in {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}:
            found.update((i, j) for j in first.get(run, ()))
            first.setdefault(run, []).append(i)
    return found


def test_exact_repeats_of_frequent_lines_are_found(spark):
    rows = made(40)
    expected = repeats(rows)
    assert len(expected) == 40
    found = compact.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    by = {}
    for r in found:
        by.setdefault((r.doc_id, r.source_id), []).append(r)
    assert expected <= set(by)
    for later, earlier in expected:
        assert any(r.end_word - r.start_word >= 60 and r.similarity >= 0.8 for r in by[later, earlier])


def test_texts_with_many_copies_of_a_passage_keep_one(spark):
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("klmnopqrst") for _ in range(5)) for _ in range(n))
    passage = say(50)
    rows = [(i, f"{say(40)} {passage} {say(40)}") for i in range(25)]
    left = compact.cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert [r.doc_id for r in left if passage in r.text] == [0] and len(left) == 25


def near(groups):
    """As ``made``, but a word in the middle of the shared passage differs."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    say = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for g in range(groups):
        lines = [say(20) for _ in range(3)]
        for i in range(17):
            if i in (5, 14):
                # One word in the middle differs: 51 of 61 shingles, and no run of 50 words, are common to both.
                passage = " ".join(lines).split()
                passage[30] = word()
                text = f"{say(30)} {' '.join(passage)} {say(30)}"
            else:
                mixed = [f"{line} {say(rng.randint(5, 30))}" for line in rng.sample(lines, 3)]
                text = f"{say(10)} {' '.join(mixed)} {say(10)}"
            rows.append((100 * g + i, text))
    return rows


def test_near_repeats_of_frequent_lines_are_found(spark):
    rows = near(60)
    found = compact.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    pairs = {(r.doc_id, r.source_id) for r in found.collect()}
    # Two of five functions agree at this similarity in all but a few of a hundred.
    missed = [g for g in range(60) if (100 * g + 14, 100 * g + 5) not in pairs]
    assert len(missed) <= 3, missed


def test_pipeline_cuts_near_repeats_of_frequent_lines(spark):
    import corpus_pipeline

    rows = near(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    left = {r.doc_id: len(r.text.split()) for r in corpus_pipeline.substring_dedup(spark, docs, "").collect()}
    whole = [g for g in range(60) if left[100 * g + 14] > 75]
    assert len(whole) <= 3, whole


def test_texts_that_share_a_line_alone_are_no_pairs(spark):
    rng = random.Random(21)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    line, passage = say(30), say(45)
    rows = [(i, f"{say(60)} {line} {say(60)}") for i in range(80)]
    # Two of them hold the line in equal surroundings, but for a word.
    rows += [(80, f"{say(60)} {passage} {line} {say(5)}"), (81, f"{say(60)} {passage} other {line} {say(5)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    met = compact.stored(compact.links(docs))
    pairs = compact.stored(compact.candidates(met))
    found = compact.stored(compact.verified(docs, pairs)).limit(0)
    more = {(r.a, r.b) for r in compact.rest(docs, met, found).collect()}
    assert (81, 80) in more and len(more) <= 3, len(more)
    assert (81, 80) in {(r.doc_id, r.source_id) for r in compact.passages(docs).collect()}


def test_members_of_a_class_are_no_pairs_for_a_line_apart(spark):
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    line, passage = say(12), say(60)
    # All hold the passage and, further off than alike runs can be, a common line; others hold it beside few distinct words.
    rows = [(i, f"{say(20)} {line} {say(rng.randint(12, 30))} {passage} {say(20)}") for i in range(60)]
    rows += [(i, f"{(say(1) + ' ') * 25}{line} {(say(1) + ' ') * 25}") for i in range(60, 120)]
    # Two share their surroundings of the passage too.
    around = say(30)
    rows += [(200, f"{say(20)} {around} {passage} {say(20)}"), (201, f"{say(9)} {around} {passage} {say(9)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    met = compact.stored(compact.links(docs))
    found = compact.stored(compact.verified(docs, compact.stored(compact.candidates(met))))
    more = compact.rest(docs, met, found).count()
    assert more <= 60, more
    held = [(r.doc_id, r.source_id, r.end_word - r.start_word) for r in compact.passages(docs).collect()]
    assert {a for a, _, n in held if n >= 60} == {*range(1, 60), 200, 201}
    assert any(a == 201 and b == 200 and n >= 90 for a, b, n in held)


def test_links_of_windows_do_not_depend_on_batches():
    rng = np.random.default_rng(6)
    h, doc = np.repeat(np.arange(40), 6), np.sort(rng.integers(0, 4, (40, 6)), axis=1).ravel()
    h, doc = np.append(h, [40] * 5), np.append(doc, [7] * 5)
    table = pa.table({n: pa.array(v) for n, v in zip(["h", "doc", *compact._PLACES], [h, doc, *rng.integers(0, 9, (3, len(h)))])})
    expected = {}
    for value, text in zip(h.tolist(), doc.tolist()):
        expected.setdefault(value, []).append(text)
    expected = {v: texts for v, texts in expected.items() if len(set(texts)) > 1}
    for size in (1, 2, 7, 64, 500):
        rows = [r for b in compact._stars(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        # Of each value that texts share one row tells its first text, and if three have it.
        assert sorted((r["h"], r["a"], r["bit"]) for r in rows if r["b"] is None) == sorted(
            (v, texts[0], int(len(set(texts)) > 2)) for v, texts in expected.items()
        )
        linked = {}
        for r in rows:
            if r["b"] is not None and r["c"] is not None and r["h"] in expected:
                linked.setdefault(r["h"], []).append((r["a"], r["b"]))
        assert {v: sorted(p) for v, p in linked.items()} == {v: [(t, texts[0]) for t in texts[1:]] for v, texts in expected.items()}
    # What one text alone has is no link.
    assert not {r["h"] for r in rows} - set(expected) - {40}
