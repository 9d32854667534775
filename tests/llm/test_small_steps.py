"""Steps of operators on arrays alone, against plain versions."""

from __future__ import annotations

import os
import random
import threading

import numpy as np
import pyarrow as pa

from palisade.llm import genetic, lyndon, vocab


def test_the_word_vocabulary_starts_no_threads(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    coder = vocab.WordBpe(vocab.public("word_bpe_49k.json"))
    before = len(os.listdir("/proc/self/task")) - threading.active_count()
    lists = coder.encode([f"word{i}" for i in range(3000)], np.zeros(3000, bool))
    assert len(lists) == 3000 and len(os.listdir("/proc/self/task")) - threading.active_count() <= before


def test_a_task_encodes_no_piece_twice(monkeypatch):
    rng = random.Random(2)
    words = list({"".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(250_000)})
    encode, coded = vocab.WordBpe.encode, []
    monkeypatch.setattr(vocab.WordBpe, "encode", lambda self, texts, plain: coded.extend(texts) or encode(self, texts, plain))
    texts = [" ".join(words[k : k + 5000]) for k in range(0, len(words), 5000)] * 2
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], ["doc_id", "text"]) for i, t in enumerate(texts)]
    done = list(genetic._pieces(vocab.public("word_bpe_49k.json"), 4096, 1)(iter(batches)))
    assert len(coded) == len(set(coded)) == len(words)
    half = len(done) // 2
    assert [d.column("ids_crc32").to_pylist() for d in done[:half]] == [d.column("ids_crc32").to_pylist() for d in done[half:]]


def test_the_first_of_equal_strings_stays():
    rng = random.Random(5)
    parts = [bytes(rng.choice(b"ab") for _ in range(140)) for _ in range(4)]
    contexts = [(rng.randint(0, 5), 10_000 * i, rng.choice(parts)[: rng.randint(90, 140)]) for i in range(40)]
    seen = {}
    for i, (doc, low, data) in enumerate(contexts):
        for k in range(len(data) - lyndon.LENGTH + 1):
            seen.setdefault(data[k : k + lyndon.LENGTH], []).append((doc, low + k, i, k))
    expected = {(i, k) for spots in seen.values() for _, _, i, k in sorted(spots)[1:]}
    data = np.frombuffer(b"".join(c[2] for c in contexts), np.uint8)
    sizes, ids, lows = np.array([len(c[2]) for c in contexts]), np.array([c[0] for c in contexts]), np.array([c[1] for c in contexts])
    row, place = lyndon.repeats(data, sizes, ids, lows)
    assert set(zip(row.tolist(), place.tolist())) == expected and len(row) == len(expected)
