"""Word pairs to id sequences and back."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import SEED, key_of
from ..functions.noise import corrupt_sentence
from ..functions.text import words_of
from .joins import lookup
from .pairs import ON_THE_FLY

# Fixed value: the shipped length limit.
MAX_LEN = 175


def pair_tokens(pairs: DataFrame) -> DataFrame:
    """``ex_id, side, pos, token``: both sides of a pair from one explode; a side without words has one row of nulls."""
    both = F.array(
        F.struct(F.lit("source").alias("side"), words_of(F.col("source")).alias("words")),
        F.struct(F.lit("target").alias("side"), words_of(F.col("target")).alias("words")),
    )
    return pairs.select("ex_id", F.explode(both).alias("s")).select(
        "ex_id", F.col("s.side").alias("side"), F.posexplode_outer("s.words").alias("pos", "token")
    )


def _ordered(cond: Column, value: Column) -> Column:
    """Values in position order, of the rows where ``cond`` holds."""
    items = F.collect_list(F.when(cond & F.col("pos").isNotNull(), F.struct(F.col("pos"), value.alias("v"))))
    return F.transform(F.array_sort(items), lambda x: x["v"])


def encode_pairs(pairs: DataFrame, vocab: DataFrame, markers: dict[str, int]) -> DataFrame:
    """``ex_id, source_ids, target_ids`` of ``pairs(ex_id, source, target)``.

    Unknown source words become ``unk``; a pair with an unknown target word is dropped.
    ``markers`` gives the ids ``unk``, ``eos`` (source side) and ``sos`` (target side).
    Sentences are dealt by ex_id before they are cut into words, so with a dictionary that
    is broadcast the words need no shuffle of their own to be put together again.
    """
    ids = lookup(pair_tokens(pairs.repartition("ex_id")), vocab.select("side", "token", F.col("id").cast("int").alias("id")), ["side", "token"])
    on_source = F.col("side") == "source"
    grouped = ids.groupBy("ex_id").agg(
        _ordered(on_source, F.coalesce(F.col("id"), F.lit(markers["unk"]))).alias("src"),
        _ordered(~on_source, F.col("id")).alias("tgt"),
        F.count_if(~on_source & F.col("token").isNotNull() & F.col("id").isNull()).alias("missing"),
    )
    return grouped.where(F.col("missing") == 0).select(
        "ex_id",
        F.concat("src", F.array(F.lit(markers["eos"]))).alias("source_ids"),
        F.concat(F.array(F.lit(markers["sos"])), F.col("tgt")).alias("target_ids"),
    )


def keep_equal_length(encoded: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Word mode: both sides equally long and at most ``max_len``."""
    n = F.size("source_ids")
    return encoded.where((n == F.size("target_ids")) & (n <= max_len))


def keep_short(encoded: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Subword mode: both sides shorter than ``max_len - 1``."""
    return encoded.where((F.size("source_ids") < max_len - 1) & (F.size("target_ids") < max_len - 1))


def missing_tokens(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``side, token, n``: tokens absent from the vocabulary, counted before the anti join."""
    counts = pair_tokens(pairs).where(F.col("token").isNotNull()).groupBy("side", "token").agg(F.count("*").alias("n"))
    return counts.join(vocab.select("side", "token"), ["side", "token"], "left_anti")


def decode_ids(encoded: DataFrame, ids: str, vocab: DataFrame, unknown: str = "<UNK>") -> DataFrame:
    """``ex_id, text``: words of an id column joined by spaces, ``unknown`` for other ids."""
    tokens = encoded.select("ex_id", F.posexplode_outer(ids).alias("pos", "id"))
    words = lookup(tokens, vocab.select(F.col("id").cast("int").alias("id"), "token"), ["id"])
    word = F.struct("pos", F.coalesce("token", F.lit(unknown)).alias("w"))
    pairs = F.collect_list(F.when(F.col("pos").isNotNull(), word))
    return words.groupBy("ex_id").agg(
        F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ").alias("text")
    )


def renoise(decoded: DataFrame, epoch: int, p: float = ON_THE_FLY, seed: int = SEED) -> DataFrame:
    """Fresh noise on decoded text, another draw for every epoch."""
    key = key_of(seed, "epoch", epoch, F.col("ex_id"))
    return decoded.withColumn("text", corrupt_sentence(F.col("text"), key, p))


def encode_text(rows: DataFrame, vocab: DataFrame, unk: int) -> DataFrame:
    """``ex_id, ids`` of ``rows(ex_id, text)``; unknown words become ``unk``."""
    tokens = rows.select("ex_id", F.posexplode_outer(words_of(F.col("text"))).alias("pos", "token"))
    ids = lookup(tokens, vocab.select("token", F.col("id").cast("int").alias("id")), ["token"])
    return ids.groupBy("ex_id").agg(
        _ordered(F.lit(True), F.coalesce(F.col("id"), F.lit(unk))).alias("ids")
    )


# --- dense numbers ---------------------------------------------------------------------

#: Rows with dense numbers are worked on in blocks of 2 ** 13 consecutive ones.
BLOCK_BITS = 13

#: Items of blocks that a task remembers before it gives them out; bounds its memory, not the result.
HELD_ITEMS = 1 << 19


def by_block(
    rows: DataFrame, items: Callable[[pa.RecordBatch], Iterable[Iterable]], dictionary: DataFrame,
    work: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
) -> DataFrame:
    """``work`` on each block of rows and the part of ``dictionary(item, ...)`` that it needs.

    ``items`` gives the items of every row of a batch. Tasks combine those of a block before
    any is shuffled, so an item meets the dictionary once for a block and a task that holds
    rows of it; ``work`` may get it as often. Only the distinct items of a block meet the dictionary, so it may have any size, the
    commonest item comes once a block, and no row is put together from its words again.
    ``rows`` are read twice; ``ex_id`` is a dense number, so a block has a bounded number of them.
    """
    keyed = rows.withColumn("block", F.shiftright(F.col("ex_id").cast("bigint"), BLOCK_BITS))
    kind = dictionary.schema["item"].dataType.simpleString()
    arrow = {"string": pa.string(), "int": pa.int32()}[kind]

    def given_out(held: dict[int, set]) -> pa.RecordBatch:
        place = np.repeat(np.fromiter(held, np.int64, len(held)), [len(s) for s in held.values()])
        flat = pa.array([i for s in held.values() for i in s], arrow)
        return pa.RecordBatch.from_arrays([pa.array(place), flat], ["place", "item"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set] = {}
        for batch in batches:
            for block, own in zip(batch.column("block").to_pylist(), items(batch)):
                held.setdefault(block, set()).update(own)
            if sum(map(len, held.values())) > HELD_ITEMS:
                yield given_out(held)
                held = {}
        if held:
            yield given_out(held)

    needed = keyed.mapInArrow(distinct, f"place bigint, item {kind}")
    found = needed.join(dictionary, "item")
    return keyed.groupBy("block").cogroup(found.groupBy("place")).applyInArrow(work, schema)


def dictionary_of(words: pa.Table, value: str) -> dict:
    return {w: v for w, v in zip(words.column("item").to_pylist(), words.column(value).to_pylist()) if v is not None}


def id_lists(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _words(text: str) -> list[str]:
    return [w for w in text.split(" ") if w]


def words_in(batch: pa.RecordBatch) -> Iterator[list[str]]:
    """The words of the column ``text`` of every row."""
    return ([] if t is None else _words(t) for t in batch.column("text").to_pylist())


def _words_of_both(batch: pa.RecordBatch) -> Iterator[list[str]]:
    for source, target in zip(batch.column("source").to_pylist(), batch.column("target").to_pylist()):
        yield _words(source) if source == target else _words(source) + _words(target)


def encode_numbered(pairs: DataFrame, vocab: DataFrame, markers: dict[str, int], texts: bool = False) -> DataFrame:
    """:func:`encode_pairs` of pairs whose ``ex_id`` is dense; ``texts`` keeps ``source`` and ``target``."""
    one = lambda s: F.max(F.when(F.col("side") == s, F.col("id").cast("int"))).alias(s)
    ids = vocab.groupBy(F.col("token").alias("item")).agg(one("source"), one("target"))
    unk, eos, sos = (markers[m] for m in ("unk", "eos", "sos"))

    def work(rows: pa.Table, words: pa.Table) -> pa.Table:
        of_source, of_target = dictionary_of(words, "source"), dictionary_of(words, "target")
        kept, source, target = [], [], []
        for i, (s, t) in enumerate(zip(rows.column("source").to_pylist(), rows.column("target").to_pylist())):
            ids = [of_target.get(w) for w in _words(t)]
            if None not in ids:
                kept.append(i)
                source.append([*(of_source.get(w, unk) for w in _words(s)), eos])
                target.append([sos, *ids])
        rest = rows.take(pa.array(kept, pa.int64()))
        columns = [rest.column("ex_id"), id_lists(source), id_lists(target)]
        names = ["ex_id", "source_ids", "target_ids"]
        if texts:
            columns, names = [*columns, rest.column("source"), rest.column("target")], [*names, "source", "target"]
        return pa.Table.from_arrays(columns, names)

    schema = "ex_id bigint, source_ids array<int>, target_ids array<int>" + (", source string, target string" if texts else "")
    return by_block(pairs.select("ex_id", "source", "target"), _words_of_both, ids, work, schema)


def decode_numbered(encoded: DataFrame, ids: str, vocab: DataFrame, unknown: str = "<UNK>") -> DataFrame:
    """:func:`decode_ids` of rows whose ``ex_id`` is dense."""

    def work(rows: pa.Table, words: pa.Table) -> pa.Table:
        word = dictionary_of(words, "token").get
        text = [" ".join([word(i, unknown) for i in x]) for x in rows.column("ids").to_pylist()]
        return pa.Table.from_arrays([rows.column("ex_id"), pa.array(text, pa.string())], ["ex_id", "text"])

    dictionary = vocab.select(F.col("id").cast("int").alias("item"), "token")
    numbers = lambda batch: batch.column("ids").to_pylist()
    return by_block(encoded.select("ex_id", F.col(ids).alias("ids")), numbers, dictionary, work, "ex_id bigint, text string")


def encode_numbered_text(rows: DataFrame, vocab: DataFrame, unk: int) -> DataFrame:
    """:func:`encode_text` of rows whose ``ex_id`` is dense."""

    def work(rows: pa.Table, words: pa.Table) -> pa.Table:
        known = dictionary_of(words, "id").get
        ids = [[known(w, unk) for w in _words(t)] for t in rows.column("text").to_pylist()]
        return pa.Table.from_arrays([rows.column("ex_id"), id_lists(ids)], ["ex_id", "ids"])

    dictionary = vocab.select(F.col("token").alias("item"), F.col("id").cast("int").alias("id"))
    return by_block(rows.select("ex_id", "text"), words_in, dictionary, work, "ex_id bigint, ids array<int>")
