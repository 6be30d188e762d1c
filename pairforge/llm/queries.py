"""Registered queries of the operators, and the SQL that must give the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, jaccard, mixing, negatives, neighbours, packing, pages, pii, quality, substrings, token_counts, toxicity
from .common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document as it is and with its digit runs masked."""
    edited = token_counts.masked_digits(table(spark, sf_dir, "documents"))
    return token_counts.count_edited(edited, RANKS, PATTERN)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), n_words=3, p=90, q=100)


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.quality_verdicts(table(spark, sf_dir, "documents")).select(
        *columns, "rules_failed", F.round("host_rate", 9).alias("host_rate")
    )


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.alignment(table(spark, sf_dir, "documents"), BYTE_LEVEL, PATTERN, PIECES, keep_groups=False)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), BYTE_LEVEL, PATTERN, capacity=1024, end_id=2, keep_ids=False)
    return rows.drop("ids")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return negatives.hard_negatives(rows, F.col("id") % 100 == 0)


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_token_counts": op2_token_counts,
    "op3_pii": op3_pii,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_toxicity": op6_toxicity,
    "op7_source_mix": op7_source_mix,
    "op8_main_text": op8_main_text,
    "op9_quality_rules": op9_quality_rules,
    "op10_nearest": op10_nearest,
    "op11_token_alignment": op11_token_alignment,
    "op12_packing": op12_packing,
    "op13_hard_negatives": op13_hard_negatives,
}
