"""Documents to sentences, and the first sentences of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .indexing import dense_index

HEAD_BY_TOPK = 1_000_000


def sentences(docs: DataFrame, tokenizer: str = "whitespace", keep_empty: bool = False) -> DataFrame:
    """``doc_id, sent_pos, sentence``: one row per sentence, words joined by one space.

    ``tokenizer="social"`` cuts each piece into social-text tokens instead of
    whitespace words; ``keep_empty`` keeps pieces without a word.
    """
    pieces = docs.select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("sent_pos", "piece"))
    if not keep_empty:
        # tested on the raw piece, so the word splitting below runs once
        pieces = pieces.where(F.col("piece").rlike(T.HAS_WORD))
    if tokenizer == "social":
        sentence = F.array_join(T.social_tokens(F.col("piece")), " ")
    else:
        sentence = T.squeeze(F.col("piece"))
    return pieces.select("doc_id", "sent_pos", sentence.alias("sentence"))


def first_sentences(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` sentences in corpus order (doc_id, sent_pos), still partitioned.

    Up to a million, a top-k over the two key columns finds the last key to keep and the
    rows are filtered by it, so the result keeps its partitions. Beyond, a dense rank.
    """
    if n > HEAD_BY_TOPK:
        return dense_index(rows, ["doc_id", "sent_pos"], "_idx").where(F.col("_idx") < n).drop("_idx")
    place = F.struct("doc_id", "sent_pos")
    last = rows.select("doc_id", "sent_pos").orderBy("doc_id", "sent_pos").limit(n).agg(F.max(place).alias("last"))
    return rows.where(place <= last.scalar())


def length_profile(rows: DataFrame) -> DataFrame:
    """How many sentences have each word count: ``n_words, n_sentences, n_chars``."""
    return (
        rows.select(F.size(T.words_of(F.col("sentence"))).alias("n_words"), F.char_length("sentence").alias("c"))
        .groupBy("n_words")
        .agg(F.count("*").alias("n_sentences"), F.sum("c").alias("n_chars"))
    )
