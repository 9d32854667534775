"""Registered queries of the operators: each applies one to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import (
    bundles,
    byteconv,
    collocation,
    compact,
    fairmix,
    fertility,
    genetic,
    groupjoin,
    lyndon,
    multiindex,
    temporal,
    toxicity,
    whitening,
)
from palisade.llm.common import configure


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fertility(spark, sf_dir):
    return fertility.rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "byte_share", "entropy", "script",
    )


def op2_lyndon_dedup(spark, sf_dir):
    return lyndon.dedup(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op3_compact_windows(spark, sf_dir):
    return compact.passages(_table(spark, sf_dir, "documents"))


def op4_multi_index(spark, sf_dir):
    return multiindex.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_temporal_filter(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return temporal.evaluate(temporal.page_captures(pages), temporal.page_list(pages))


def op6_warc_bundles(spark, sf_dir):
    return bundles.round_trip(_table(spark, sf_dir, "pages"))


def op7_fair_mix(spark, sf_dir):
    return fairmix.mix(_table(spark, sf_dir, "documents"))


def op8_genetic_packing(spark, sf_dir):
    return genetic.pack(_table(spark, sf_dir, "documents"))


def op9_group_join(spark, sf_dir):
    return groupjoin.join(_table(spark, sf_dir, "documents"))


def op10_byte_network(spark, sf_dir):
    return byteconv.identify(_table(spark, sf_dir, "documents"))


def op11_collocation(spark, sf_dir):
    return collocation.collocations(_table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return whitening.by_component(whitening.whiten(_table(spark, sf_dir, "embeddings")))


def op13_toxicity(spark, sf_dir):
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted", "evidence"
    )


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(configure(spark), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fertility, op2_lyndon_dedup, op3_compact_windows, op4_multi_index, op5_temporal_filter,
        op6_warc_bundles, op7_fair_mix, op8_genetic_packing, op9_group_join, op10_byte_network,
        op11_collocation, op12_whitening, op13_toxicity, pipeline,
    )
}

ORACLE = {
    "op5_temporal_filter": temporal.SQL,
    "op6_warc_bundles": bundles.SQL,
    "op7_fair_mix": fairmix.SQL,
    "op11_collocation": collocation.SQL,
}
