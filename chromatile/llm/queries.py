"""Registered queries of this subpackage, each over its whole table, with check SQL where SQL can state them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from chromatile.llm import (
    checks, decontam, langid, linededup, mixing, negatives, packing, pii, quotes, runs, simhash, substring, topk, warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_decontaminate_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_line_cuckoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"), with_text=False)


def op7_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(_table(spark, sf_dir, "conversations"))


def op8_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(_table(spark, sf_dir, "embeddings"))


def op9_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op10_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(_table(spark, sf_dir, "documents"), with_text=False)


def op11_concat_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.piece_digests(packing.sequences(_table(spark, sf_dir, "documents"), vocabulary))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def periodic_tail(doc_id: int | None, words: list[str]) -> list[str]:
    """For a tenth of the documents, the words from some place on repeat with some period."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_grammar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.periodic_runs(_table(spark, sf_dir, "documents"), periodic_tail))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_feistel_pseudonyms, op2_mix_sources, op3_language_ppm, op4_warc_normalise, op5_decontaminate_cgk,
        op6_line_cuckoo, op7_quote_links, op8_pivot_topk, op9_simhash_anchors, op10_substring_doubling, op11_concat_pack, op12_hard_negatives,
        op13_grammar_runs,
    )
}

ORACLES: dict[str, str] = {
    "op2_mix_sources": checks.MIX,
    "op4_warc_normalise": checks.WARC,
    "op6_line_cuckoo": checks.LINES,
    "op7_quote_links": checks.QUOTES,
    "op8_pivot_topk": checks.TOPK,
    "op10_substring_doubling": checks.SUBSTRING,
    "op12_hard_negatives": checks.NEGATIVES,
}
