"""Plain implementations to compare the operators with, and a corpus of awkward documents."""

from __future__ import annotations

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, text2 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(_LOWER))


def corpus():
    """Null, empty, blank, short, long, repeated and nearly repeated texts, with clashing column names."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeiourstlnmé") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [None, "", " \n\t ", "word", "five words are in here", "a" * 700, "ab" * 400, "Tie tie TIE tie " * 30, "\n".join([say(6)] * 9)]
    base = [say(rng.randint(20, 240)) for _ in range(14)]
    passage, line = say(70), say(14)
    texts += base + base[:3] + [base[5]] * 4
    for text in base[:8]:
        parts = text.split()
        parts[rng.randrange(len(parts))] = "changed"
        texts.append(" ".join(parts))
    texts += [f"{say(30)} {passage} {say(40)}" for _ in range(5)] + [f"{line}\n{say(25)}" for _ in range(5)]
    texts += [say(6000), base[3] + " " + base[4], "日本語 の テキスト です 。 " * 12]
    sources = ["b", "a", None, "c", "b", "b"]
    rows = [
        (i, t, [None, "en", "fr"][i % 3], sources[i % 6], None if t is None else len(t), "clash", None)
        for i, t in enumerate(texts)
    ]
    return rows


def near_components(rows, width=5, percent=80):
    sets = {}
    for i, text in rows:
        w = lowered(text)
        sets[i] = set(zip(*[w[k:] for k in range(width)])) if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def removed_bytes(rows, length=100):
    """doc_id -> (bytes, flags of those that go)."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            piece = data[k : k + length]
            if piece in seen:
                gone[k : k + length] = [True] * length
            seen.add(piece)
        out[i] = (data, gone)
    return out


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    count, covered = Counter(runs), set()
    for k, run in enumerate(runs):
        if count[run] > 1:
            covered.update(range(k, k + 8))
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
    )
