"""Each operator against a plain version, on awkward documents and on nothing at all."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import bundles, byteconv, compact, fairmix, fertility, genetic, groupjoin, lyndon, multiindex, temporal
from palisade.llm.vocab import public

from .helpers import SCHEMA, base_counts, corpus, near_components, removed_bytes, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- 1: fertility ----------------------------------------------------------

def test_fertility_counts_and_verdicts(docs):
    found = by_id(fertility.rules(docs))
    for i, text in texts(docs):
        row = found[i]
        expected = base_counts(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected
        failed = expected[0] < 20 or 100 * expected[4] > 30 * expected[0]
        assert row.base_failed == failed and not (failed and row.kept)
        assert (row.chars_per_token is None) == (not words(text))


def test_fertility_measures_follow_the_vocabulary(docs):
    import math
    from collections import Counter

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public("piece_bpe_32k.model"))
    found = by_id(fertility.rules(docs))
    for i, text in texts(docs):
        ids = [t for w in words(text) for t in model.encode(w)]
        if len(ids) < 2:
            continue
        counts = Counter(ids)
        bits = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values())
        row = found[i]
        assert row.n_tokens == len(ids)
        assert row.entropy == pytest.approx(bits / math.log2(len(ids)))
        assert row.byte_share == pytest.approx(sum(map(model.is_byte, ids)) / len(ids))


def test_fertility_rejects_noise_of_a_language(spark):
    import random

    rng = random.Random(1)
    common = ["the", "house", "water", "people", "under", "little", "great", "country", "between", "world"]
    clean = [(i, " ".join(rng.choice(common) for _ in range(300)), "en") for i in range(40)]
    noise = [(100, " ".join("".join(rng.choice("qxzkvjw0#9") for _ in range(8)) for _ in range(300)), "en")]
    docs = spark.createDataFrame(clean + noise, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in fertility.filter_docs(docs).collect()}
    assert 100 not in kept and len(kept) >= 38


# --- 2: substring dedup ----------------------------------------------------

@pytest.mark.parametrize("block", [4096, 2])
def test_lyndon_dedup(docs, block, monkeypatch):
    monkeypatch.setattr(lyndon, "BLOCK", block)
    found = by_id(lyndon.dedup(docs))
    for i, (data, gone) in removed_bytes(texts(docs)).items():
        row = found[i]
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(g and not h for g, h in zip(gone, [False, *gone]))
        assert (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) == (len(data), sum(gone), runs, kept)


def test_repeated_rows_do_not_remove_each_other(spark):
    text = hashlib.sha512(b"1").hexdigest() + hashlib.sha512(b"2").hexdigest()
    rows = [(1, text), (1, text), (2, text)]
    found = lyndon.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed > 0) for r in found) == [(1, False), (1, False), (2, True)]


def test_suffix_order_is_that_of_the_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(300):
        strings = [rng.integers(0, rng.integers(1, 4), rng.integers(1, 14)).tolist() for _ in range(rng.integers(1, 5))]
        text = np.concatenate([np.r_[np.array(s) + 1, 0] for s in strings])
        ends = np.cumsum([len(s) + 1 for s in strings]) - 1
        group = lyndon.suffix_order(text, ends, 10**6)
        suffixes = sorted((tuple(s[k:]), e - len(s) + k) for s, e in zip(strings, ends) for k in range(len(s)))
        for (one, p), (two, q) in zip(suffixes, suffixes[1:]):
            assert group[p] < group[q] or (one == two and group[p] <= group[q])


# --- 3: passages -----------------------------------------------------------

def test_passages_that_repeat(docs):
    found = {(r.doc_id, r.source_id) for r in compact.passages(docs).collect()}
    caught = {a for a, _ in found}
    runs, shared = {}, set()
    for i, text in sorted(texts(docs)):
        w = [x.lower() for x in words(text)]
        own = {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
        if any(runs.get(r, i) != i for r in own):
            shared.add(i)
        for r in own:
            runs.setdefault(r, i)
    assert shared <= caught
    assert all(a > b for a, b in found)


def test_compact_windows_are_those_of_all_runs():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64)
    left, centre, right = compact.cartesian(hashes, np.array([25, 0, 35]), least=4)
    for begin, end in ((0, 25), (25, 60)):
        for i in range(begin, end):
            for j in range(i + 3, end):
                holders = [c for a, c, b in zip(left, centre, right) if a <= i <= c <= j <= b]
                assert holders == [i + int(hashes[i : j + 1].argmin())]


def spread(edited, at=((20, 24), (20, 24))):
    """The shingles of two texts, each inside words of its own, and one span over both."""
    (a, b), (c, d) = at
    one = [f"p{k}" for k in range(a)] + edited[1] + [f"q{k}" for k in range(b)]
    two = [f"r{k}" for k in range(c)] + edited[0] + [f"s{k}" for k in range(d)]
    names = {}
    x, y = ([names.setdefault(tuple(w[k : k + 5]), len(names)) for k in range(len(w) - 4)] for w in (one, two))
    spans = np.array([(k, 0, len(x) - 1, 0, len(y) - 1) for k in range(2)])
    return np.array(x, np.uint64), np.array(y, np.uint64), spans


def alike_runs(x, y, least=46, percent=80):
    """By brute force, the runs of x alike to some run of y, less the shingles at their ends that the run of y has not."""
    x, y, out = x.tolist(), y.tolist(), set()
    for i in range(len(x)):
        mask = 0
        for j in range(i, len(x)):
            mask |= 1 << x[j]
            if j - i + 1 < least:
                continue
            for i2 in range(len(y)):
                other = 0
                for j2 in range(i2, min(len(y), i2 + (j - i + 1) * 100 // percent + 1)):
                    other |= 1 << y[j2]
                    if 100 * (mask & other).bit_count() >= percent * (mask | other).bit_count():
                        inner = [k for k in range(i, j + 1) if other >> x[k] & 1]
                        out.add((inner[0], inner[-1]))
    return out


@pytest.mark.parametrize("length, changed", [(60, [30]), (50, [0]), (100, [33, 66]), (85, [42])])
def test_passages_with_changed_words_are_found(length, changed):
    passage = [f"w{k}" for k in range(length)]
    other = ["changed" if k in changed else w for k, w in enumerate(passage)]
    x, y, spans = spread((passage, other))
    found = compact.compare(x, y, spans)
    assert any(s <= 20 + 5 * (changed == [0]) and e >= 20 + length - 1 and alike >= 0.8 for s, e, _, _, alike in found)


def test_inserted_words_count_alike_in_either_text():
    passage = [f"w{k}" for k in range(90)]
    other = passage[:45] + [f"n{k}" for k in range(8)] + passage[45:]
    for pair in ((passage, other), (other, passage)):
        x, y, spans = spread(pair)
        [(start, end, start2, end2, alike)] = compact.compare(x, y, spans)
        assert (end - start, end2 - start2) == (len(pair[1]), len(pair[0])) and alike == pytest.approx(82 / 98)


def test_near_passages_are_those_of_brute_force():
    import random

    rng = random.Random(5)
    hits = 0
    for _ in range(25):
        passage = [f"w{k}" for k in range(rng.randint(50, 66))]
        other = list(passage)
        for _ in range(rng.randint(1, 2)):
            k = rng.randrange(len(other))
            other[k : k + rng.randint(0, 3)] = [f"n{rng.random()}" for _ in range(rng.randint(0, 3))]
        x, y, spans = spread((passage, other), ((4, 3), (2, 5)))
        found = [(s, e - 5) for s, e, *_ in compact.compare(x, y, spans)]
        expected = alike_runs(x, y)
        hits += bool(expected)
        assert all(any(s <= i and j <= e for s, e in found) for i, j in expected)
        assert bool(found) == bool(expected)
    assert 5 < hits


def test_cut_keeps_clean_documents_and_columns(docs):
    after = by_id(compact.cut(docs))
    flagged = {r.doc_id for r in compact.passages(docs).collect()}
    assert compact.cut(docs).columns == docs.columns
    for row in docs.collect():
        if row.doc_id not in flagged:
            assert after[row.doc_id] == row
        elif row.doc_id in after:
            assert len(words(after[row.doc_id].text)) < len(words(row.text))


# --- 4: nearest neighbours -------------------------------------------------

def test_multi_index_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 24))
    x = centres[rng.integers(0, 12, 900)] + 0.6 * rng.standard_normal((900, 24))
    x[7] = x[8]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [None] * 24), (5005, [1.0]), (None, [1.0] * 24)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = multiindex.search(df, F.col("vec_id") % 20 == 0).collect()
    x = x.astype(np.float32).astype(np.float64)
    hits = 0
    for q in range(0, 900, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(900), -scores))[:20]
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(r.score == pytest.approx(scores[r.vec_id], rel=1e-12) for r in mine)
        hits += len(set(best) & {r.vec_id for r in mine})
    assert hits >= 0.9 * 20 * 45
    few = multiindex.search(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 4
    assert multiindex.search(df.where("vec_id > 4999"), F.lit(True)).count() == 0


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    index = rng.integers(0, 256, (300, multiindex.SUBSTRINGS), dtype=np.uint8)
    queries = index[:20] ^ (rng.random((20, multiindex.SUBSTRINGS)) < 0.3).astype(np.uint8)
    index[:3], queries[:2] = 255, 255
    queries[2] = 0
    tables = multiindex.Tables(index)
    apart = np.bitwise_count(index[None] ^ queries[:, None]).sum(axis=2)
    for radius in (0, 3, 15, 16, 17, 50, 127, 128):
        for i, query in enumerate(queries):
            assert tables.probe(query, radius).tolist() == np.flatnonzero(apart[i] <= radius).tolist()


def test_multi_index_ties_extra_columns_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "ROWS", 40)
    monkeypatch.setattr(multiindex, "QUERIES", 5)
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, (300, 8)).astype(float)
    x[100:200] = x[17]
    x[(x == 0).all(axis=1)] = 1.0
    rows = [(i, v.tolist(), "b", i, -1, True) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string, part long, rank int, asks boolean")
    found = multiindex.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 21)) * 15
    for q in range(0, 300, 20):
        mine = [r for r in found if r.query_id == q]
        assert all(r.score == x[r.vec_id] @ x[q] and r.vec_id != q for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
    assert multiindex.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_entries_for_deep_folders_and_single_pages(spark):
    entries = spark.createDataFrame(
        [("h.org/a/b/c/d/e/", "block", 0, True), ("h.org/a/b/c/d/e/f/ok.html", "allow", 0, True), ("h.org/x.html", "block", 0, True)],
        "key string, action string, since long, listed boolean",
    )
    urls = ["http://h.org/a/b/c/d/e/f/no.html", "http://h.org/a/b/c/d/e/f/ok.html?q=1", "http://h.org/a/b/c/d/z", "http://h.org/x.html", "http://h.org/", "http://h.org", None]
    captures = spark.createDataFrame([(i, u, 10) for i, u in enumerate(urls)], "page_id long, url string, fetched long")
    found = by_id(temporal.evaluate(captures, entries), "page_id")
    assert [found[i].blocked for i in range(7)] == [True, False, False, True, False, False, False]
    assert found[1].decided_by == "h.org/a/b/c/d/e/f/ok.html" and found[1].n_valid == 2


# --- 5, 6, 7: with SQL -----------------------------------------------------

PAGES = [
    (1, "http://a.example.com/x/y/z.html?q=1#f", "<p>" + "long " * 400), (2, "https://A.Example.com:8080/x/", "<p>" + "long " * 400),
    (3, None, None), (4, "", ""), (5, "not a url", "short"), (6, "http://u:p@b.example.com", "short"),
    (7, "http://b.example.com/x/y/z.html", "é" * 700), (8, "http://localhost/a/b/", "é" * 700), (9, "http://b.example.com/x/y/", "é" * 700),
]


def compare(spark_rows, sql, **tables):
    connection = duckdb.connect()
    for name, frame in tables.items():
        connection.register(name, frame)
    columns = spark_rows.columns
    expected = connection.execute(f"SELECT {', '.join(columns)} FROM ({sql}) q").fetchall()
    assert sorted(map(repr, map(tuple, spark_rows.collect()))) == sorted(map(repr, expected))


def test_warc_round_trip(spark):
    import pandas as pd

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    compare(bundles.round_trip(pages), bundles.SQL, pages=pd.DataFrame(PAGES, columns=["page_id", "url", "html"]))
    assert bundles.round_trip(pages.where("page_id < 0")).count() == 0
    assert bundles.round_trip(pages.unionByName(pages).withColumn("page_id", F.when(F.col("page_id") > 2, F.col("page_id")))).count() == 18


def test_bundles_are_plain_zstandard_with_a_seek_table(tmp_path, monkeypatch):
    import io

    import zstandard

    monkeypatch.setattr(bundles, "FRAME_BYTES", 3000)
    filesystem, root = bundles._filesystem(str(tmp_path))
    bundle = bundles._Bundle(filesystem, f"{root}/b.warc.zst")
    records = [bundles.record(i, f"http://h/{i}", b"x" * (i * 500), None if i % 3 else i + 1)[1] for i in range(9)]
    places = [bundle.add(data) for data in records]
    bundle.close()
    raw = (tmp_path / "b.warc.zst").read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(records)
    frames = bundles.read_seek_table(filesystem.open_input_file(f"{root}/b.warc.zst"))
    assert 1 < len(frames) < len(records) and any(offset > 0 for _, offset in places)
    for (frame, offset), data in zip(places, records):
        begin, length, size = frames[frame]
        plain = zstandard.ZstdDecompressor().decompress(raw[begin : begin + length], max_output_size=size)
        assert plain[offset : offset + len(data)] == data


def test_single_records_are_read_by_frame_and_offset(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("bundle", F.lit("own")).coalesce(1)
    index = bundles.write(pages, str(tmp_path))
    places = index.collect()
    assert {r.frame for r in places} == {0} and sorted(r.offset for r in places)[1] > 0
    some = bundles.read(index.where("page_id in (2, 9)"), str(tmp_path)).collect()
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in some) == [(2, "response", 2003), (9, "response", 1400)]
    assert bundles.read(index.where("page_id = 0"), str(tmp_path)).count() == 0


def test_training_sample_is_bounded_with_repeated_ids(spark):
    rows = [(7, f"words of text {i}", "xx") for i in range(300)] + [(8, "the same text", "yy")] * 300
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = byteconv.training_rows(labelled, sample=20, pieces=1).groupBy("lang").count().collect()
    counts = {r.lang: r["count"] for r in drawn}
    assert 1 <= counts["xx"] <= 40 and counts["yy"] == 1


def test_temporal_filter(spark):
    import pandas as pd

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    found = temporal.evaluate(temporal.page_captures(pages), temporal.page_list(pages))
    compare(found, temporal.SQL, pages=pd.DataFrame(PAGES, columns=["page_id", "url", "html"]))


def test_entries_hold_between_addition_and_removal(spark):
    day = temporal.DAY
    entries = spark.createDataFrame(
        [("example.com", "block", 10 * day, True), ("example.com", "block", 100 * day, False), ("example.com", "block", 200 * day, True),
         ("a.example.com/free/", "allow", 50 * day, True), ("example.com", "block", 20 * day, True), (None, "block", 1, True)],
        "key string, action string, since long, listed boolean",
    )
    times = [0, 10 * day, 99 * day, 100 * day, 150 * day, 200 * day, 10_000 * day, None]
    captures = spark.createDataFrame(
        [(i, url, t) for i, t in enumerate(times) for url in ("http://a.example.com/free/x", "http://a.example.com/paid/x", None)],
        "page_id long, url string, fetched long",
    )
    found = temporal.evaluate(captures, entries)
    blocked = sorted((r.page_id, r.decided_by) for r in found.where("blocked").collect())
    assert blocked == [(1, "example.com"), (1, "example.com"), (2, "example.com"), (5, "example.com"), (6, "example.com")]
    assert found.count() == 24
    assert temporal.evaluate(captures.where("page_id < 0"), entries).count() == 0
    assert temporal.evaluate(captures, entries.where("key = 'none'")).where("blocked").count() == 0


def test_fair_mix(docs, empty):
    import pandas as pd

    frame = pd.DataFrame([(i, t, s) for i, t, _, s, *_ in corpus()], columns=["doc_id", "text", "source"])
    compare(fairmix.mix(docs).select("doc_id", "size", "source_size", "target", "taken"), fairmix.SQL, documents=frame)
    rows = fairmix.mix(docs).collect()
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    assert fairmix.mix(empty).count() == 0
    assert fairmix.mix(docs.unionByName(docs)).count() == 2 * len(rows)


# --- 8: packing ------------------------------------------------------------

def test_packing(docs, empty):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public("word_bpe_49k.json"))
    rows = genetic.pack(docs).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, text in texts(docs):
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        cuts = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        assert sorted(found[i]) == [(k, 4096 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cuts)]
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1
    assert genetic.pack(empty).count() == 0
    assert genetic.pack(docs.unionByName(docs)).count() == 2 * len(rows)


def test_evolution_reaches_perfect_packings():
    rng = np.random.default_rng(6)
    cuts = [np.diff(np.r_[0, np.sort(rng.choice(np.arange(1, 1000), 3, replace=False)), 1000]) for _ in range(60)]
    lengths = np.concatenate(cuts)
    best = genetic.evolve(lengths, [], 1000, np.random.default_rng(1))
    assert np.bincount(best, lengths).max() <= 1000 and best.max() + 1 <= 62


# --- 9: near duplicates ----------------------------------------------------

@pytest.mark.parametrize("block", [4_000_000, 600])
def test_group_join(docs, block):
    found = by_id(groupjoin.join(docs, block=block))
    for i, (n, component) in near_components(texts(docs)).items():
        assert (found[i].n_shingles, found[i].component_id) == (n, component)


def test_group_join_of_a_chain(spark):
    """Neighbours are alike, ends are not; all are one component."""
    chain = [(i, " ".join(f"w{k}" for k in range(i * 9, i * 9 + 120))) for i in range(30)]
    rows = groupjoin.join(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    expected = near_components(chain)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert {r.component_id for r in rows} == {0}


# --- 10: language ----------------------------------------------------------

def test_language_is_learned_and_held_out(spark):
    import random

    rng = random.Random(2)
    speak = {"aa": ["kalo", "mira", "tuva", "sento"], "bb": ["zrhu", "pfech", "gwist", "chtro"], "cc": ["éa", "ñou", "üix", "çel"]}
    rows = [(i, " ".join(rng.choice(speak[lang]) for _ in range(rng.randint(4, 200))), lang) for i, lang in enumerate([*speak] * 60)]
    odd = [(900, None, "aa"), (901, "", None), (902, "123 456 !!", "bb"), (903, rows[0][1] * 50, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    found = by_id(byteconv.identify(docs))
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in found)
    right = [found[i].lang_pred == lang for i, _, lang in rows if found[i].held_out]
    assert np.mean(right) > 0.95
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert found[903].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in found.values())
    unlabelled = byteconv.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_gradients():
    rng = np.random.default_rng(7)
    net = byteconv.Network(["a", "b"])
    net.parameters = {k: v.astype(np.float64) for k, v in net.parameters.items()}
    x, y = rng.integers(0, 256, (6, byteconv.WINDOW), dtype=np.uint8), np.array([0, 1, 0, 1, 1, 0])
    loss = lambda: -net.log_chances(x, net.tables())[np.arange(6), y].mean()
    slopes = net._step(x, y)
    for name, at in (("out", (3, 1)), ("filter3", (5, 2)), ("bias2", (4,)), ("embedding", (int(x[0, 5]), 3))):
        kept = net.parameters[name][at]
        net.parameters[name][at] = kept + 1e-6
        up = loss()
        net.parameters[name][at] = kept - 1e-6
        down = loss()
        net.parameters[name][at] = kept
        assert (up - down) / 2e-6 == pytest.approx(slopes[name][at], abs=1e-5)


# --- all: nothing at all ---------------------------------------------------

def test_empty_tables(empty):
    for run in (fertility.rules, fertility.filter_docs, lyndon.dedup, compact.passages, compact.cut, groupjoin.join, byteconv.identify):
        assert run(empty).count() == 0


def test_kept_bytes_hash(docs):
    found = by_id(lyndon.dedup(docs).withColumn("sha", F.sha2("kept", 256)))
    assert all(r.sha == hashlib.sha256(bytes(r.kept)).hexdigest() for r in found.values())
