"""Byte-pair-encoding vocabularies: word counts, encoding and decoding. Training is in ``bpe_training``."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import SEED
from ..functions.text import word_or_punct, words_of
from ..session import stored
from .bpe_training import MARKERS, MERGE_SCHEMA, VOCAB_SIZE, train
from .encode import by_block, dictionary_of, id_lists, renoise, words_in
from .joins import lookup
from .pairs import ON_THE_FLY

__all__ = ["MARKERS", "MERGE_SCHEMA", "VOCAB_SIZE", "decode", "decode_words", "encode", "merge_list", "noisy_again", "train", "word_counts", "word_pieces"]


@F.pandas_udf(T.StringType())
def nfkc(words: pd.Series) -> pd.Series:
    """Unicode NFKC form."""
    return words.map(lambda w: unicodedata.normalize("NFKC", w), na_action="ignore")


def normalise(text: Column) -> Column:
    """NFKC where needed; of plain ASCII text only a null goes to Python."""
    plain = text.rlike(r"^\p{ASCII}*$")
    return F.coalesce(F.when(plain, text), nfkc(F.when(~plain, text)))


def word_counts(sentences: DataFrame) -> DataFrame:
    """``word, n``: frequencies of the normalised word and punctuation runs.

    Whitespace words are counted first, so NFKC sees each distinct word once.
    """
    raw = sentences.select(F.explode(words_of(F.col("sentence"))).alias("raw")).groupBy("raw").agg(F.count("*").alias("c"))
    words = raw.select(F.explode(word_or_punct(normalise(F.col("raw")))).alias("word"), "c")
    return words.groupBy("word").agg(F.sum("c").alias("n"))


def merge_list(merges: DataFrame) -> list[tuple[str, str]]:
    """All merges in rank order: as many as the vocabulary was trained for."""
    return [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()]


class Segmenter:
    """Cuts words into pieces: joins the lowest-ranked pair, leftmost first, while there is one.

    Symbols form a linked list; a heap has the ranked pairs by (rank, place). A join looks at
    its two neighbours alone, so a word of n characters costs O(n log n).
    """

    def __init__(self, merges: list[tuple[str, str]]) -> None:
        self.ranks = {pair: i for i, pair in enumerate(merges)}

    def pieces(self, word: str) -> list[str]:
        parts: list[str | None] = list(word)
        n, get = len(parts), self.ranks.get
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank, i) for i in range(n - 1) if (rank := get((parts[i], parts[i + 1]))) is not None]
        heapify(queue)
        while queue:
            rank, i = heappop(queue)
            j = right[i]
            if parts[i] is None or j == n or get((parts[i], parts[j])) != rank:
                continue
            parts[i] += parts[j]
            parts[j] = None
            right[i] = after = right[j]
            if after < n:
                left[after] = i
                if (new := get((parts[i], parts[after]))) is not None:
                    heappush(queue, (new, i))
            before = left[i]
            if before >= 0 and (new := get((parts[before], parts[i]))) is not None:
                heappush(queue, (new, before))
        return [p for p in parts if p is not None]


@lru_cache(maxsize=2)
def _segmenter(merges: Broadcast) -> Segmenter:
    """Built once per Python worker."""
    return Segmenter(merges.value)


def word_pieces(words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """``word, pieces`` for a column of distinct words."""
    shared = words.sparkSession.sparkContext.broadcast(merges)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def segment(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = _segmenter(shared).pieces
        for part in series:
            yield part.map(pieces)

    return words.select("word", segment("word").alias("pieces"))


def _coder(merges: Broadcast, ids: Broadcast, unknown: int | None):
    """Arrow UDF: the parts of a word to the ids of their pieces."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def code(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces, known = _segmenter(merges).pieces, ids.value
        for part in series:
            found = part.map(lambda words: [known.get(p, unknown) for w in words for p in pieces(w)])
            yield found.map(lambda x: [i for i in x if i is not None])

    return code


def _pieces_of_block(rows: pa.Table, words: pa.Table) -> pa.Table:
    known = dictionary_of(words, "word_ids")
    ids = [[i for w in t.split(" ") if w for i in known.get(w, ())] for t in rows.column("text").to_pylist()]
    return pa.Table.from_arrays([rows.column("ex_id"), id_lists(ids)], ["ex_id", "ids"])


def encode(
    rows: DataFrame, merges: list[tuple[str, str]], vocab: DataFrame, unknown: int | None = None, keep_words: bool = False,
    numbered: bool = False,
) -> DataFrame:
    """``ex_id, ids`` of ``rows(ex_id, text)``.

    Every distinct word is segmented once; occurrences only join its ids. Merges and
    vocabulary, bounded by the vocabulary size, are shipped to each worker once. Characters
    outside the alphabet are dropped, or become ``unknown``. A row without words keeps its
    place, with no ids. ``keep_words`` adds ``word_lengths``, the number of ids of each
    whitespace word, which :func:`decode_words` needs. ``numbered`` says that ``ex_id`` is a
    dense number: rows are then put together block by block, whatever the number of words.
    """
    context = rows.sparkSession.sparkContext
    ids = context.broadcast({r["token"]: r["id"] for r in vocab.select("token", "id").collect()})
    code = _coder(context.broadcast(merges), ids, unknown)
    tokens = rows.select("ex_id", F.posexplode_outer(words_of(F.col("text"))).alias("pos", "raw"))
    distinct = tokens.where(F.col("raw").isNotNull()).select("raw").distinct()
    parts = distinct.select("raw", word_or_punct(normalise(F.col("raw"))).alias("parts"))
    by_word = stored(parts.select("raw", code("parts").alias("word_ids")), "word-ids")
    if numbered:
        known = by_word.select(F.col("raw").alias("item"), "word_ids")
        return by_block(rows.select("ex_id", "text"), words_in, known, _pieces_of_block, "ex_id bigint, ids array<int>")
    held = F.struct("pos", F.coalesce("word_ids", F.array().cast("array<int>")).alias("v"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), held)))
    grouped = lookup(tokens, by_word, ["raw"]).groupBy("ex_id").agg(F.transform(ordered, lambda x: x["v"]).alias("v"))
    lengths = [F.transform("v", F.size).alias("word_lengths")] if keep_words else []
    return grouped.select("ex_id", F.flatten("v").alias("ids"), *lengths)


def decode(encoded: DataFrame, ids: str, vocab: DataFrame) -> DataFrame:
    """``ex_id, text``: pieces joined by spaces, markers skipped; an empty text if nothing is left."""
    tokens = encoded.select("ex_id", F.posexplode_outer(ids).alias("pos", "id"))
    words = lookup(tokens, vocab.select("id", "token"), ["id"])
    ordered = F.array_sort(F.collect_list(F.when(~F.col("token").isin(*MARKERS), F.struct("pos", "token"))))
    return words.groupBy("ex_id").agg(F.array_join(F.transform(ordered, lambda x: x["token"]), " ").alias("text"))


def noisy_again(
    encoded: DataFrame, merges: list[tuple[str, str]], vocab: DataFrame, epoch: int, p: float = ON_THE_FLY,
    corrupt_target: bool = False, start: bool = True, seed: int = SEED,
) -> DataFrame:
    """``ex_id, source_ids, target_ids`` with fresh noise on the sources, to be padded by batch.

    The ids lose their markers, are decoded, corrupted and encoded again, between the start
    marker (unless ``start`` is false) and the end marker. Targets stay as they are;
    ``corrupt_target`` gives them noise of their own, too.
    """
    markers = {r["token"]: r["id"] for r in vocab.where(F.col("token").isin(*MARKERS)).collect()}
    first = [F.array(F.lit(markers["<sos>"]))] if start else []

    def again(side: str, noise: int) -> DataFrame:
        text = renoise(decode(encoded, side, vocab), epoch, p, noise)
        return encode(text, merges, vocab).select("ex_id", F.concat(*first, F.col("ids"), F.array(F.lit(markers["<eos>"]))).alias(side))

    rows = again("source_ids", seed)
    return rows.join(again("target_ids", seed + 1) if corrupt_target else encoded.select("ex_id", "target_ids"), "ex_id")


def decode_words(encoded: DataFrame, ids: str, lengths: str, vocab: DataFrame) -> DataFrame:
    """``ex_id, text`` with the pieces of a word joined: the normalised words, single spaces between.

    ``lengths`` is the column ``word_lengths`` of :func:`encode`, before markers are added. A
    word of which no piece is left gives no word.
    """
    # the word of every id: as many times its number as it has ids
    owners = F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n)))
    tokens = encoded.select("ex_id", F.posexplode_outer(F.arrays_zip(F.col(ids).alias("id"), owners.alias("word"))).alias("pos", "t"))
    tokens = tokens.select("ex_id", "pos", F.col("t.id").alias("id"), F.col("t.word").alias("word"))
    named = lookup(tokens, vocab.select("id", "token"), ["id"])
    ordered = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", "word", "token"))))
    grouped = named.groupBy("ex_id").agg(ordered.alias("o"))
    spaced = F.transform("o", lambda x, i: F.when((i > 0) & (x["word"] != F.get("o", i - 1)["word"]), F.concat(F.lit(" "), x["token"])).otherwise(x["token"]))
    return grouped.select("ex_id", F.array_join(spaced, "").alias("text"))
