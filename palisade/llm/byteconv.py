"""Language identification by a byte convolutional network in numpy.

Bytes are embedded; filters of several widths slide over a window of ``WINDOW``
bytes; each filter's maximum goes through a softmax layer. As an embedded
byte times a filter column is a table lookup, a filter of width w is the sum of
w lookups, and two neighbouring bytes share one. A text is cut into windows from
end to end; its log probabilities are averaged over all windows.

Training draws about ``SAMPLE`` labelled documents per language, those with the
smallest hash of id and text, never over twice as many, and from each at most
``PIECES`` windows at hashed places: the bounded sample the driver trains on.
Repeated rows are drawn once. Languages are those met in the labels. Documents
are counted per language first, repeated ones once, so that only drawn ones are
cut and shuffled.

Text that is null or has no letter is ``und`` with score 0. If there is
nothing to learn from (no labelled text), everything is ``und``. Repeated rows
get equal answers. Only ``doc_id`` and ``text`` are read for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import configure, stored
from palisade.llm.flat import Flat, slices, within
from palisade.operators.sizes import broadcast_if_small

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 12
SAMPLE = 3000
PIECES = 2
STEPS = 400
BATCH = 192
UNKNOWN = "und"


class Network:
    """Embedding (256, e), filters per width (w * e, f), and a softmax layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.parameters = {"embedding": rng.standard_normal((256, EMBEDDING)).astype(np.float32) * np.float32(0.5)}
        for w in WIDTHS:
            self.parameters[f"filter{w}"] = scale(w * EMBEDDING, FILTERS)
            self.parameters[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        self.parameters["out"] = scale(len(WIDTHS) * FILTERS, len(languages))
        self.parameters["out_bias"] = np.zeros(len(languages), np.float32)

    def _step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy over windows x (n, WINDOW) with labels y."""
        p = self.parameters
        n = len(x)
        embedded = p["embedding"][x]
        pooled, tops = [], {}
        for w in WIDTHS:
            spread = np.lib.stride_tricks.sliding_window_view(embedded.reshape(n, -1), w * EMBEDDING, axis=1)[:, ::EMBEDDING]
            active = spread @ p[f"filter{w}"] + p[f"bias{w}"]
            tops[w] = active.argmax(axis=1)
            pooled.append(np.maximum(np.take_along_axis(active, tops[w][:, None], axis=1)[:, 0], 0))
        hidden = np.concatenate(pooled, axis=1)
        scores = hidden @ p["out"] + p["out_bias"]
        scores -= scores.max(axis=1, keepdims=True)
        chance = np.exp(scores)
        chance /= chance.sum(axis=1, keepdims=True)
        chance[np.arange(n), y] -= 1
        chance /= n
        slope = {"out": hidden.T @ chance, "out_bias": chance.sum(axis=0), "embedding": np.zeros_like(p["embedding"])}
        back = (chance @ p["out"].T) * (hidden > 0)
        for k, w in enumerate(WIDTHS):
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            place = tops[w][:, :, None] + np.arange(w)
            seen = x[np.arange(n)[:, None, None], place]
            slope[f"filter{w}"] = np.einsum("nf,nfd->df", part, p["embedding"][seen].reshape(n, FILTERS, -1))
            slope[f"bias{w}"] = part.sum(axis=0)
            to = np.einsum("nf,df->nfd", part, p[f"filter{w}"]).reshape(n, FILTERS, w, EMBEDDING)
            np.add.at(slope["embedding"], seen.ravel(), to.reshape(-1, EMBEDDING))
        return slope

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 7) -> Network:
        """Adam over batches in which every language is as frequent as the others."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        mean = {k: np.zeros_like(v) for k, v in self.parameters.items()}
        square = {k: np.zeros_like(v) for k, v in self.parameters.items()}
        for t in range(1, steps + 1):
            label = rng.integers(0, len(groups), BATCH)
            pick = np.array([groups[k][rng.integers(0, len(groups[k]))] for k in label])
            rate = 0.01 * (1 - t / (steps + 1)) + 0.0005
            for k, g in self._step(x[pick], y[pick]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                self.parameters[k] -= (rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Per width, what each pair of bytes (or last single byte) adds to the filters."""
        p, out = self.parameters, {}
        for w in WIDTHS:
            single = [p["embedding"] @ p[f"filter{w}"][k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(w)]
            out[w] = [
                (single[k][:, None] + single[k + 1][None]).reshape(-1, FILTERS) if k + 1 < w else single[k]
                for k in range(0, w, 2)
            ]
        return out

    def log_chances(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Log probabilities (windows, languages)."""
        p = self.parameters
        pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        pooled = []
        for w in WIDTHS:
            span = x.shape[1] - w + 1
            active = None
            for k, table in zip(range(0, w, 2), tables[w]):
                index = pairs[:, k : k + span] if k + 1 < w else x[:, k : k + span]
                active = table.take(index, axis=0) if active is None else active + table.take(index, axis=0)
            pooled.append(np.maximum(active.max(axis=1) + p[f"bias{w}"], 0))
        scores = np.concatenate(pooled, axis=1) @ p["out"] + p["out_bias"]
        scores = scores.astype(np.float64)
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def cut_windows(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all rows, the last of each moved back to end with the text, short ones padded; rows' counts."""
    sizes = np.diff(flat.offsets)
    counts = -(-sizes // WINDOW)
    rows, place = within(counts)
    start = np.minimum(place * WINDOW, np.maximum(sizes[rows] - WINDOW, 0))
    index = (flat.offsets[:-1][rows] + start)[:, None] + np.arange(WINDOW)
    over = index >= flat.offsets[1:][rows][:, None]
    x = flat.bytes[np.minimum(index, len(flat.bytes) - 1)] if len(rows) else np.zeros((0, WINDOW), np.uint8)
    x[over] = 32
    return x, counts


def training_rows(labelled: DataFrame, sample: int = SAMPLE, pieces: int = PIECES) -> DataFrame:
    """About ``sample`` rows per language, by smallest hash, twice that at most, as hashed pieces of their texts."""
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = lambda k: (
        F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.lit(1), F.length("text") - WINDOW // 2)) + 1
    ).cast("int")
    rows = labelled.where("lang is not null and length(text) >= 4").select("lang", "doc_id", "text", turn.alias("turn"))
    different = F.approx_count_distinct("turn", 0.02)
    share = broadcast_if_small(stored(rows.groupBy("lang").agg((F.lit(float(sample)) / different).alias("share"))))
    drawn = rows.join(share, "lang").where("turn < share").select(
        "lang", "doc_id", "turn", F.array(*[F.substr("text", place(k), F.lit(WINDOW)) for k in range(pieces)]).alias("pieces")
    ).distinct()
    first = Window.partitionBy("lang").orderBy("turn", "doc_id", "pieces")
    bounded = drawn.withColumn("k", F.row_number().over(first)).where(F.col("k") <= 2 * sample)
    return bounded.select("lang", "doc_id", F.explode("pieces").alias("piece"))


def learn(labelled: DataFrame, **options) -> Network | None:
    rows = training_rows(labelled, **options).toPandas().sort_values(["lang", "doc_id", "piece"], kind="stable")
    if not len(rows):
        return None
    languages = sorted(rows["lang"].unique())
    x = np.full((len(rows), WINDOW), 32, np.uint8)
    for i, piece in enumerate(rows["piece"]):
        data = np.frombuffer(piece.encode(), np.uint8)[:WINDOW]
        x[i, : len(data)] = data
    y = np.array([languages.index(v) for v in rows["lang"]])
    return Network(languages).train(x, y)


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id with lang_pred and score; further columns but ``text`` are kept."""
    spark = configure(docs.sparkSession)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    names = [n for n in docs.columns if n != "text"]
    if network is None:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        tables = net.tables()
        for part in slices(batches):
            x, counts = cut_windows(Flat(part.column("text")))
            total = np.zeros((len(counts), len(net.languages)))
            rows = np.repeat(np.arange(len(counts)), counts)
            for at in range(0, len(x), 64):
                np.add.at(total, rows[at : at + 64], net.log_chances(x[at : at + 64], tables))
            mean = total / np.maximum(counts, 1)[:, None]
            mean -= mean.max(axis=1, keepdims=True)
            chance = np.exp(mean)
            chance /= chance.sum(axis=1, keepdims=True)
            known = np.array(part.column("lettered").to_pylist(), bool)
            best = chance.argmax(axis=1)
            names = [n for n in part.schema.names if n not in ("text", "lettered")]
            yield pa.RecordBatch.from_arrays([
                *(part.column(n) for n in names),
                pa.array([net.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)]),
                pa.array(np.where(known, chance.max(axis=1), 0.0)),
            ], [*names, "lang_pred", "score"])

    kept = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text")
    return docs.select("*", lettered.alias("lettered")).mapInArrow(run, f"{kept}, lang_pred string, score double")


def fold(column: Column | str = "doc_id") -> Column:
    """True for the documents held out: crc32 of the id as text leaves 0 by 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents, learned from those not held out."""
    network = learn(docs.where(~fold()).select("doc_id", "lang", "text"))
    return predict(docs.select("doc_id", fold().alias("held_out"), "text"), network)
