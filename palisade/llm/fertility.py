"""Quality rules on tokeniser fertility, with rejection bands per language.

Every word of a text is encoded with a public vocabulary that falls back to
bytes. Three measures follow: characters per token, the share of byte-fallback
tokens, and the entropy of the token distribution relative to the most that so
many tokens can have. A document is judged against the band of its language, or,
where ``lang`` is null, of its script. A band is drawn from all documents of
that language: around the median by a floor plus ``REACH`` times the distance
of the quartiles of the deviations, which shrinks with the root of the length,
as a mean over few tokens strays further than one over many.
Too few characters per token or too many byte tokens mark noise, too little
entropy mere repetition; entropy is judged from ``MIN_TOKENS`` tokens up.

Base rules come first: fewer than ``MIN_WORDS`` words, or over 30 % of the words
in 8-word windows that occur twice in the text.

Null and empty texts have no words and fail the base rules; their measures are
null. A document whose measures are null is not in any band's figures. Repeated
rows count as often as they occur. Other columns are kept by ``filter_docs`` and
not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import configure, stored
from palisade.llm.flat import WHITE, Flat, mix, slices, windows
from palisade.llm.vocab import piece_bpe, public

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
REACH = 3.0
MIN_TOKENS = 64
#: What a band allows in any case beyond the median (entropy: the lower quartile).
FLOORS = {"chars_per_token": 0.06, "byte_share": 0.05, "entropy": 0.15}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SCRIPTS = np.array(["none", "latin", "greek_cyrillic", "middle_east", "indic", "east_asian"])

_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, entropy double, script string"
)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Per element, which occurrence of its (row, hash) it is and how many there are, as (is first, count)."""
    _, first, back, count = np.unique(
        mix(rows.astype(np.uint64) + np.uint64(1)) ^ hashes, return_index=True, return_inverse=True, return_counts=True
    )
    lead = np.zeros(len(hashes), bool)
    lead[first] = True
    return lead, count[back]


def repeat_words(words: np.ndarray, counts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each row inside a window of ``width`` words that the row has twice or more."""
    hashes, kept = windows(words, counts, width)
    rows = np.repeat(np.arange(len(counts)), kept)
    _, count = _repeats(rows, hashes)
    first = np.repeat(np.cumsum(counts) - counts, kept)
    place = first + np.arange(len(rows)) - np.repeat(np.cumsum(kept) - kept, kept)
    cover = np.zeros(len(words) + 1, np.int64)
    again = place[count > 1]
    np.add.at(cover, again, 1)
    np.add.at(cover, again + width, -1)
    return _per_row(np.cumsum(cover[:-1]) > 0, np.concatenate([[0], np.cumsum(counts)]))


def duplicate_lines(flat: Flat) -> np.ndarray:
    """Lines with a word that equal an earlier line of the row."""
    data, offsets = flat.bytes, flat.offsets
    breaks = np.flatnonzero(data == 10)
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts = np.unique(np.concatenate([filled, breaks + 1]))
    starts = starts[starts < len(data)]
    row = np.searchsorted(offsets, starts, side="right") - 1
    at = np.searchsorted(breaks, starts)
    end = np.minimum(np.append(breaks, len(data))[at], offsets[row + 1])
    inner = np.concatenate([[0], np.cumsum(~WHITE[data])])
    worded = inner[end] > inner[starts]
    starts, end, row = starts[worded], end[worded], row[worded]
    lead, _ = _repeats(row, flat.hashes(starts, end))
    return np.bincount(row[~lead], minlength=len(offsets) - 1)


def _script(flat: Flat) -> np.ndarray:
    """The script most letters of a row belong to, told by lead bytes."""
    kind = np.zeros(256, np.uint8)
    kind[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCB)]] = 1
    kind[0xCD:0xD5] = 2
    kind[0xD5:0xE0] = 3
    kind[0xE0:0xE2] = 4
    kind[0xE3:0xEE] = 5
    of = kind[flat.bytes]
    counts = np.stack([_per_row(of == k, flat.offsets) for k in range(1, 6)], axis=1)
    return _SCRIPTS[np.where(counts.max(axis=1) > 0, counts.argmax(axis=1) + 1, 0)]


def _measures(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_bpe(path)
        for part in coder.during(slices(batches)):
            flat = Flat(part.column("text"))
            starts, ends, counts = flat.words()
            bounds = np.concatenate([[0], np.cumsum(counts)])
            points = np.concatenate([[0], np.cumsum((flat.bytes & 0xC0) != 0x80)])
            chars = points[ends] - points[starts]
            word_chars = np.concatenate([[0], np.cumsum(chars)])
            word_chars = word_chars[bounds[1:]] - word_chars[bounds[:-1]]
            ids, each = coder.words(flat, starts, ends)
            token_at = np.concatenate([[0], np.cumsum(each)])[bounds]
            n_tokens = np.diff(token_at)
            n_bytes = _per_row(coder.is_byte[ids], token_at)
            rows = np.repeat(np.arange(len(counts)), n_tokens)
            pair, times = np.unique(rows * (1 << 20) + ids, return_counts=True)
            some = np.maximum(n_tokens, 1)
            spread = np.bincount(pair >> 20, times * np.log2(times), len(counts))
            bits = np.log2(some) - spread / some
            entropy = bits / np.log2(np.maximum(n_tokens, 2))
            words = flat.hashes(starts, ends)
            measured = n_tokens > 0
            real = lambda x: pa.array(x, pa.float64(), mask=~measured)
            out = {
                "n_words": pa.array(counts), "word_chars": pa.array(word_chars),
                "n_symbols": pa.array(_per_row(_SYMBOL[flat.bytes], flat.offsets)),
                "n_dup_lines": pa.array(duplicate_lines(flat)), "n_repeat_words": pa.array(repeat_words(words, counts)),
                "n_tokens": pa.array(n_tokens), "chars_per_token": real(word_chars / some),
                "byte_share": real(n_bytes / some), "entropy": real(entropy), "script": pa.array(_script(flat).tolist()),
            }
            names = [n for n in part.schema.names if n not in out]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *out.values()], [*names, *out])

    return run


def measure(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and lang with all counts and measures."""
    configure(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "text").mapInArrow(
        _measures(vocabulary or public("piece_bpe_32k.model")),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, text string, {_SCHEMA}",
    )
    return rows.drop("text").withColumn("band", F.coalesce("lang", F.concat(F.lit("script:"), "script")))


def _deviation(measure: str) -> Column:
    """Distance from the language's median, scaled by the root of the tokens it is a mean over."""
    scale = F.sqrt(F.col("n_tokens").cast("double"))
    return (F.col(measure) - F.col(f"mid_{measure}")) * scale


def bands(measured: DataFrame) -> DataFrame:
    """Per language (or script), from all its documents: medians, and how far documents stray from them."""
    some = measured.where("n_tokens > 0")
    quantile = lambda column, p, name: F.percentile_approx(column, p, 10000).alias(name)
    judged = F.when(F.col("n_tokens") >= MIN_TOKENS, F.col("entropy"))
    # Written, so that its size is known: a few bands go to the documents, not all documents of a band to one task.
    middle = stored(some.groupBy("band").agg(
        *[quantile(F.col(m), 0.5, f"mid_{m}") for m in ("chars_per_token", "byte_share")],
        quantile(judged, 0.25, "e1"), quantile(judged, 0.75, "e3"),
    ))
    spread = some.join(middle, "band").groupBy("band").agg(*[
        quantile(_deviation(m), [0.25, 0.75], f"z_{m}") for m in ("chars_per_token", "byte_share")
    ])
    return middle.join(spread, "band").select(
        "band", "mid_chars_per_token", "mid_byte_share",
        *[(F.col(f"z_{m}")[1] - F.col(f"z_{m}")[0]).alias(f"spread_{m}") for m in ("chars_per_token", "byte_share")],
        (F.col("e1") - F.greatest(F.lit(FLOORS["entropy"]), REACH * (F.col("e3") - F.col("e1")))).alias("least_entropy"),
    )


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """The measures with ``base_failed`` and ``kept``; ``limits`` has a row per language or script."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    reach = lambda m: FLOORS[m] * F.sqrt(F.col("n_tokens").cast("double")) + REACH * F.col(f"spread_{m}")
    inside = (
        (F.abs(_deviation("chars_per_token")) <= reach("chars_per_token"))
        & (_deviation("byte_share") <= reach("byte_share"))
        & ((F.col("n_tokens") < MIN_TOKENS) | (F.col("entropy") >= F.coalesce("least_entropy", F.lit(0.0))))
    )
    joined = measured.join(limits, "band", "left").withColumn("base_failed", base)
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def rules(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Counts, measures and verdict of all documents."""
    measured = stored(measure(docs, vocabulary))
    return judge(measured, stored(bands(measured))).drop("band")


def filter_docs(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The documents whose verdict is to keep, with all their columns.

    The bands take one pass over the texts, the verdicts another; no text is
    shuffled.
    """
    configure(docs.sparkSession)
    path = vocabulary or public("piece_bpe_32k.model")
    limits = stored(bands(stored(measure(docs, path).select("band", "n_tokens", *FLOORS))))
    names = docs.columns
    # The text moves once, beside the other columns.
    others = F.struct(*[n for n in names if n != "text"])
    packed = docs.select("text", F.col("lang").alias("language"), others.alias("row"))
    kind = packed.schema["row"].dataType.simpleString()
    rows = packed.mapInArrow(_measures(path), f"text string, language string, row {kind}, {_SCHEMA}")
    rows = rows.withColumn("band", F.coalesce("language", F.concat(F.lit("script:"), "script")))
    return judge(rows, limits).where("kept").select(*[F.col("text") if n == "text" else F.col("row")[n].alias(n) for n in names])
