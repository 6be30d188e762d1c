"""Exact training of byte-pair merges: many merges a round, on fragments of the distinct words.

The state is one row per distinct word, its symbols as ids, and a table of pair counts that
each round changes by the pairs of the words it touched. A round looks at the *frontier*: the
pairs that lead in the order of training (count, then symbol ids), up to a cut. Words are cut
at every place whose pair is not in the frontier. No merge can cross such a place before the
order has come down to the cut: whatever pair forms there is at most as frequent as the one
that stood there. So the pieces between, the *fragments*, counted over all words, hold all
that training needs until then. They are few, and plain one-by-one training runs on them; the
merges it makes are those of one-by-one training on the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

# Trainer vocabulary size and marker tokens, which take the first ids.
VOCAB_SIZE = 40_000
MARKERS = ("<sos>", "<eos>", "<pad>", "<unk>")

MERGE_SCHEMA = T.StructType(
    [
        T.StructField("rank", T.IntegerType(), False),
        T.StructField("left", T.StringType(), False),
        T.StructField("right", T.StringType(), False),
        T.StructField("merged", T.StringType(), False),
        T.StructField("n", T.LongType(), False),
    ]
)

#: Frontier pairs of the first round, and of any. It follows the number of fragments.
FIRST_PAIRS, MOST_PAIRS = 256, 1 << 15
#: Distinct fragments that a round may bring to the driver, whatever the corpus.
MOST_FRAGMENTS = 1 << 17

Key = tuple[int, int]


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of a list column, and the number of them in each row."""
    lists = batch.column(column)
    lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    return np.asarray(lists.flatten()).astype(np.int64), lengths


def _pair_keys(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``left << 32 | right`` at every symbol but each row's last, and a mask of where these stand."""
    inner = np.ones(len(flat), bool)
    ends = np.cumsum(lengths)
    inner[ends[lengths > 0] - 1] = False
    at = np.flatnonzero(inner)
    return flat[at] << 32 | flat[at + 1] if len(at) else flat[:0], inner


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, places = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, places, np.concatenate([n for _, n in parts]))
    return keys, total


def pair_changes(words: DataFrame, before: str | None, after: str) -> DataFrame:
    """``pair, n``: pair counts of column ``after`` less those of ``before``, summed in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, parts = np.asarray(batch.column("n")), []
            for column, sign in ((after, 1), *([(before, -1)] if before else [])):
                flat, lengths = _flat(batch, column)
                keys, inner = _pair_keys(flat, lengths)
                parts.append((keys, sign * np.repeat(n, lengths)[inner]))
            keys, total = _sums(parts)
            yield pa.RecordBatch.from_arrays([pa.array(keys[total != 0]), pa.array(total[total != 0])], ["pair", "n"])

    columns = ["n", after, *([before] if before else [])]
    return words.select(*columns).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def fragments(words: DataFrame, frontier: np.ndarray) -> DataFrame:
    """``fragment, n``: runs of symbols whose every neighbouring pair is in the frontier, as packed ids."""
    shared = words.sparkSession.sparkContext.broadcast(np.sort(frontier))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            flat, lengths = _flat(batch, "symbols")
            keys, inner = _pair_keys(flat, lengths)
            tied = np.zeros(len(flat), bool)  # to the symbol behind
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            tied[inner] = known[at] == keys
            before = np.r_[False, tied[:-1]]
            first, last = np.flatnonzero(tied & ~before), np.flatnonzero(before & ~tied)
            weight = np.repeat(np.asarray(batch.column("n")), lengths)[first].tolist()
            packed, counts = flat.astype("<i4").tobytes(), {}
            for a, b, n in zip((4 * first).tolist(), (4 * last + 4).tolist(), weight):
                piece = packed[a:b]
                counts[piece] = counts.get(piece, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["fragment", "n"])

    return words.select("symbols", "n").mapInArrow(run, "fragment binary, n bigint").groupBy("fragment").agg(F.sum("n").alias("n"))


def merge_symbols(symbols: list[int], left: int, right: int, new: int) -> list[int]:
    """Leftmost first, without overlap."""
    out, k, end = [], 0, len(symbols)
    while k < end:
        if symbols[k] == left and k + 1 < end and symbols[k + 1] == right:
            out.append(new)
            k += 2
        else:
            out.append(symbols[k])
            k += 1
    return out


class Vocabulary:
    """Symbols by id; merged symbols get the next free id unless their string is known."""

    def __init__(self, alphabet: list[str]) -> None:
        self.tokens = [*MARKERS, *alphabet]
        self.ids = {token: i for i, token in enumerate(self.tokens)}

    def merged(self, left: int, right: int) -> tuple[int, bool]:
        """Id of the joined symbol, and whether it is new."""
        token = self.tokens[left] + self.tokens[right]
        new = token not in self.ids
        if new:
            self.ids[token] = len(self.tokens)
            self.tokens.append(token)
        return self.ids[token], new


def merge_fragments(
    counted: list[tuple[list[int], int]], vocabulary: Vocabulary, cut: tuple[int, int] | None, budget: int, size: int
) -> list[tuple[int, int, int, int]]:
    """``left, right, merged, n`` of the merges that are certain, in order, by plain training on fragments.

    ``cut`` is (-count, pair) of the last frontier pair; None if all pairs are in the frontier.
    A merge that gives a symbol known before is the last one: pairs with that symbol have
    places outside the fragments.
    """
    pieces = [symbols for symbols, _ in counted]
    counts: dict[int, int] = {}
    places: dict[int, set[int]] = {}
    for f, (symbols, n) in enumerate(counted):
        for a, b in zip(symbols, symbols[1:]):
            key = a << 32 | b
            counts[key] = counts.get(key, 0) + n
            places.setdefault(key, set()).add(f)
    queue = [(-n, key) for key, n in counts.items()]
    heapify(queue)
    out: list[tuple[int, int, int, int]] = []
    while queue and len(out) < budget and len(vocabulary.tokens) < size:
        minus, key = heappop(queue)
        if counts.get(key) != -minus:
            continue
        if cut is not None and (minus, key) > cut:
            break
        left, right = key >> 32, key & 0xFFFFFFFF
        merged, new = vocabulary.merged(left, right)
        out.append((left, right, merged, -minus))
        if not new:
            break
        changed: set[int] = set()
        for f in places.pop(key):
            old, n = pieces[f], counted[f][1]
            pieces[f] = now = merge_symbols(old, left, right, merged)
            for a, b in zip(old, old[1:]):
                pair = a << 32 | b
                counts[pair] -= n
                changed.add(pair)
            for a, b in zip(now, now[1:]):
                pair = a << 32 | b
                counts[pair] = counts.get(pair, 0) + n
                places.setdefault(pair, set()).add(f)
                changed.add(pair)
        for pair in changed:
            if n := counts[pair]:
                heappush(queue, (-n, pair))
            else:
                del counts[pair]
    return out


def apply_merges(words: DataFrame, merges: list[tuple[int, int, int, int]]) -> DataFrame:
    """``n, symbols, before`` after the merges, in order; ``before`` is null for words that stay as they are."""
    shared = words.sparkSession.sparkContext.broadcast(
        ({left << 32 | right: (rank, merged) for rank, (left, right, merged, _) in enumerate(merges)}, np.array(sorted(a << 32 | b for a, b, _, _ in merges)))
    )

    def merged(symbols: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
        while len(symbols) > 1:
            pairs = [ranks.get(a << 32 | b) for a, b in zip(symbols, symbols[1:])]
            best = min((p for p in pairs if p), default=None)
            if best is None:
                break
            k = pairs.index(best)
            symbols = merge_symbols(symbols, symbols[k], symbols[k + 1], best[1])
        return symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = shared.value
        for batch in batches:
            flat, lengths = _flat(batch, "symbols")
            keys, inner = _pair_keys(flat, lengths)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            row = np.repeat(np.arange(len(lengths)), lengths)[inner]
            touched = np.zeros(len(lengths), bool)
            touched[row[known[at] == keys]] = True
            symbols = batch.column("symbols").to_pylist()
            now = [merged(s, ranks) if t else s for s, t in zip(symbols, touched.tolist())]
            before = [s if t else None for s, t in zip(symbols, touched.tolist())]
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (now, before)]
            yield pa.RecordBatch.from_arrays([batch.column("n"), *lists], ["n", "symbols", "before"])

    return words.select("n", "symbols").mapInArrow(run, "n bigint, symbols array<int>, before array<int>")


def _coded(counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``n, symbols`` of words of two characters and more."""
    shared = counts.sparkSession.sparkContext.broadcast(vocabulary.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for batch in batches:
            symbols = [[ids[c] for c in word] for word in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array(symbols, pa.list_(pa.int32()))], ["n", "symbols"])

    return counts.where(F.char_length("word") > 1).select("word", "n").mapInArrow(run, "n bigint, symbols array<int>")


def _round(words: DataFrame, pairs: DataFrame, n_pairs: int) -> tuple[list[tuple[list[int], int]], tuple[int, int] | None, int]:
    """Fragments, the cut, and the frontier's size, made smaller until the fragments fit."""
    while True:
        lead = pairs.orderBy(F.desc("n"), "pair").limit(n_pairs).collect()  # MOST_PAIRS at most
        cut = (-lead[-1]["n"], lead[-1]["pair"]) if len(lead) == n_pairs else None
        if not lead:
            return [], None, n_pairs
        found = fragments(words, np.array([r["pair"] for r in lead])).limit(MOST_FRAGMENTS + 1).toArrow()
        if len(found) <= MOST_FRAGMENTS or n_pairs == 1:
            break
        n_pairs = max(1, n_pairs // 4)
    symbols = (np.frombuffer(f.as_buffer(), "<i4").tolist() for f in found["fragment"])
    if len(found) * 4 < MOST_FRAGMENTS:
        n_pairs = min(2 * n_pairs, MOST_PAIRS)
    return list(zip(symbols, found["n"].to_pylist())), cut, n_pairs


def train(counts: DataFrame, vocab_size: int = VOCAB_SIZE, max_merges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact training on ``counts(word, n)``: ``merges(rank, left, right, merged, n)`` and ``vocab(token, id)``.

    The most frequent pair is merged first, ties by the ids of its symbols; markers and the
    alphabet have the first ids. Training ends at ``vocab_size`` entries, after ``max_merges``
    if given, or when no pair is left. The alphabet, the merges, a round's frontier and its
    fragments (131,072 at most) come to the driver; words and pair counts never do. State is
    written to the shared folder each round, so a lost executor costs one stage.
    """
    spark = counts.sparkSession
    counts = stored(counts.select("word", "n"), "bpe-words")
    letters = counts.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    vocabulary = Vocabulary(sorted(r["c"] for r in letters.collect()))  # single characters: bounded by Unicode
    budget = 1 << 62 if max_merges is None else max_merges
    words = stored(_coded(counts, vocabulary), "bpe")
    pairs = stored(pair_changes(words, None, "symbols"), "pairs")
    merges: list[tuple[int, str, str, str, int]] = []
    n_pairs = FIRST_PAIRS
    while len(merges) < budget and len(vocabulary.tokens) < vocab_size:
        counted, cut, n_pairs = _round(words, pairs, n_pairs)
        made = merge_fragments(counted, vocabulary, cut, budget - len(merges), vocab_size)
        if not made:
            break
        token = vocabulary.tokens.__getitem__
        merges += [(len(merges) + k, token(a), token(b), token(m), n) for k, (a, b, m, n) in enumerate(made)]
        state = stored(apply_merges(words, made), "bpe")
        changes = pair_changes(state.where("before is not null"), "before", "symbols")
        pairs = stored(pairs.union(changes).groupBy("pair").agg(F.sum("n").alias("n")).where("n > 0"), "pairs")
        words = state.where(F.size("symbols") > 1).select("n", "symbols")
    vocab = spark.createDataFrame(list(vocabulary.ids.items()), "token string, id int")
    return spark.createDataFrame(merges, MERGE_SCHEMA), vocab
