"""Word vocabularies: distinct tokens in first-occurrence order with dense ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words_of
from .indexing import dense_index

# Marker tokens per side; the word-level target side has no <unk>.
SOURCE_MARKERS = ("<sos>", "<eos>", "<pad>", "<unk>")
TARGET_MARKERS = ("<sos>", "<eos>", "<pad>")

PLACE = ("doc_id", "sent_pos", "variant", "word_pos")

#: Words that a task remembers before it gives them out; bounds its memory, not the result.
HELD_WORDS = 1 << 17


def token_rows(rows: DataFrame, sentence: str) -> DataFrame:
    """``doc_id, sent_pos, variant, word_pos, token`` of a sentence column."""
    return rows.select(
        "doc_id", "sent_pos", "variant", F.posexplode(words_of(F.col(sentence))).alias("word_pos", "token")
    )


def source_tokens(variants: DataFrame) -> DataFrame:
    """Tokens of the originals (variant 0) and of the variants that changed.

    The originals are the targets of the first variants. An unchanged variant only repeats
    tokens its original has shown before, so it adds no entry and moves no first place.
    """
    first = F.struct(F.lit(0).alias("variant"), F.col("target").alias("sentence"))
    own = F.struct("variant", F.col("source").alias("sentence"))
    shown = F.array(
        F.when(F.col("variant") == 1, first), F.when(F.col("source") != F.col("target"), own)
    )
    rows = variants.select("doc_id", "sent_pos", F.explode(F.array_compact(shown)).alias("s"))
    return token_rows(rows.select("doc_id", "sent_pos", "s.*"), "sentence")


def original_tokens(variants: DataFrame) -> DataFrame:
    """Tokens of the originals of a variant table."""
    originals = variants.where(F.col("variant") == 1).withColumn("variant", F.lit(0))
    return token_rows(originals, "target")


def target_tokens(sentences: DataFrame) -> DataFrame:
    return token_rows(sentences.withColumn("variant", F.lit(0)), "sentence")


def first_seen(tokens: DataFrame) -> DataFrame:
    """One row per token with its first place."""
    place = F.struct(*PLACE)
    return (
        tokens.groupBy("token")
        .agg(F.min(place).alias("first"))
        .select("token", *[F.col(f"first.{c}").alias(c) for c in PLACE])
    )


def shown_forms(forms: DataFrame) -> DataFrame:
    """``doc_id, sent_pos, variant, sentence``: the originals (variant 0) and the noisy forms that changed."""
    shown = lambda v, s: F.struct(v.cast("int").alias("variant"), s.alias("sentence"))
    own = F.filter(F.transform("sources", lambda s, i: shown(i + 1, s)), lambda x: x["sentence"].isNotNull())
    first = F.array(shown(F.lit(0), F.col("target")))
    return forms.select("doc_id", "sent_pos", F.explode(F.concat(first, own)).alias("s")).select("doc_id", "sent_pos", "s.*")


def shown_originals(rows: DataFrame, sentence: str = "sentence") -> DataFrame:
    """``doc_id, sent_pos, variant, sentence`` of the originals alone."""
    return rows.select("doc_id", "sent_pos", F.lit(0).alias("variant"), F.col(sentence).alias("sentence"))


def _given_out(seen: dict[str, tuple]) -> pa.RecordBatch:
    doc, sent, variant, word = ([p[k] for p in seen.values()] for k in range(1, 5))
    columns = [
        pa.array(list(seen), pa.string()), pa.array(doc, pa.int64()),
        *(pa.array(c, pa.int32()) for c in (sent, variant, word)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["token", *PLACE])


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their first place among the sentences a task has seen since it gave words out."""
    seen: dict[str, tuple] = {}
    for batch in batches:
        for doc, sent, variant, text in zip(*(batch.column(c).to_pylist() for c in (*PLACE[:3], "sentence"))):
            head = (doc is not None, doc, sent, variant)  # a null comes first, as in Spark's order
            for i, word in enumerate([w for w in text.split(" ") if w]):
                old = seen.get(word)
                if old is None or head < old[:4]:
                    seen[word] = (*head, i)
            if len(seen) > HELD_WORDS:
                yield _given_out(seen)
                seen = {}
    if seen:
        yield _given_out(seen)


def first_shown(rows: DataFrame) -> DataFrame:
    """:func:`first_seen` of the words of ``rows(doc_id, sent_pos, variant, sentence)``.

    Tasks combine words before any of them is sorted or shuffled.
    """
    typed = rows.select(F.col("doc_id").cast("bigint"), F.col("sent_pos").cast("int"), F.col("variant").cast("int"), "sentence")
    schema = "token string, doc_id bigint, sent_pos int, variant int, word_pos int"
    return first_seen(typed.mapInArrow(_first_of_task, schema))


def _numbered(first: DataFrame, side: str) -> DataFrame:
    ranked = dense_index(first, list(PLACE), "id", ["token"])
    return ranked.select(F.lit(side).alias("side"), "token", "id")


def build_vocab(tokens: DataFrame, side: str) -> DataFrame:
    """``side, token, id``: ids 0.. in the order of first occurrence."""
    return _numbered(first_seen(tokens), side)


def vocab_of(shown: DataFrame, side: str) -> DataFrame:
    """:func:`build_vocab` of the words of sentences, see :func:`first_shown`."""
    return _numbered(first_shown(shown), side)


def marker_rows(vocab: DataFrame, markers: tuple[str, ...] = SOURCE_MARKERS) -> DataFrame:
    """Marker ids n+1, n+2, … per side for n words: id n itself stays unused."""
    sizes = vocab.groupBy("side").agg(F.count("*").alias("words"))
    return sizes.select(
        "side",
        F.posexplode(F.array(*[F.lit(m) for m in markers])).alias("k", "token"),
        "words",
    ).select("side", "token", (F.col("words") + 1 + F.col("k")).alias("id"))


def with_markers(vocab: DataFrame, markers: tuple[str, ...] = SOURCE_MARKERS) -> DataFrame:
    return vocab.unionByName(marker_rows(vocab, markers))


def sizes(vocab: DataFrame) -> DataFrame:
    """Model-facing vocabulary size per side: words + 1."""
    return vocab.groupBy("side").agg((F.count("*") + 1).alias("vocab_size"))


def coverage(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Occurrences, distinct tokens and the share missing from ``vocab`` (a token column).

    Occurrences are counted per token first, so the join is one row per token.
    """
    counts = tokens.groupBy("token").agg(F.count("*").alias("c"))
    known = vocab.select("token", F.lit(1).alias("known"))
    joined = counts.join(known, "token", "left")
    missing = F.col("known").isNull()
    return joined.agg(
        F.sum("c").alias("n_tokens"),
        F.count("*").alias("n_types"),
        F.coalesce(F.sum(F.when(missing, F.col("c"))), F.lit(0)).alias("n_oov"),
        F.count_if(missing).alias("n_oov_types"),
    ).withColumn("oov_rate", F.col("n_oov") / F.col("n_tokens"))


def frequencies(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("n"))
