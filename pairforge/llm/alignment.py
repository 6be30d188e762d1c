"""Operator 11: alignment of two tokenizers by merge-path partitioning of their token ends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import only, slices, texts
from .vocabularies import ByteLevel, Bytes, Pieces, byte_level_of, pieces_of, share_file, vocabulary_sizes

#: Steps of the merge path that a piece takes.
PIECE = 1 << 16
#: Characters of text aligned at once; a longer text is a lot of its own.
LOT = 1 << 20
#: Id pairs whose counts are broadcast: the most frequent ones. The rest is joined.
HOT_PAIRS = 1 << 20
#: Distinct pairs a task holds before it hands its counts on.
HELD_PAIRS = 1 << 21


def diagonals(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two ascending arrays crosses every ``step``-th diagonal.

    Of equal values those of ``a`` come first. A crossing (i, j) says that i values of ``a``
    and j of ``b`` come before it; each is found by a binary search of its own, so the pieces
    between them are independent and take ``step`` steps each.
    """
    total = len(a) + len(b)
    d = np.unique(np.append(np.arange(0, total, step), total))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        i, j = middle[open_], d[open_] - 1 - middle[open_]
        before = a[i] <= b[j]
        low[open_] = np.where(before, i + 1, low[open_])
        high[open_] = np.where(before, high[open_], i)
    return low, d - low


def shared_ends(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in two strictly ascending arrays of the values that both hold.

    Each piece of the merge path gives its own; a value whose two places fall on both sides of
    a crossing is found when the pieces are stitched.
    """
    i, j = diagonals(a, b, step)
    left, right = [], []
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:]):
        if i1 > i0 and j1 > j0:
            at = np.searchsorted(b[j0:j1], a[i0:i1])
            hit = np.flatnonzero(b[j0 + np.minimum(at, j1 - j0 - 1)] == a[i0:i1])
            left.append(i0 + hit)
            right.append(j0 + at[hit])
        if i1 > 0 and j1 < len(b) and a[i1 - 1] == b[j1]:
            left.append(np.array([i1 - 1]))
            right.append(np.array([j1]))
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *left]).astype(np.int64), np.concatenate([nothing, *right]).astype(np.int64)


class Groups:
    """Writes groups as ``a1,a2|b1;a3|b2,b3`` with decimal ids."""

    def __init__(self, size_a: int, size_b: int) -> None:
        self.size_a, self.size_b = size_a, size_b
        a, b = list(map(str, range(size_a))), list(map(str, range(size_b)))
        self.words = [x + "," for x in a] + [x + "|" for x in a] + [x + "," for x in b] + [x + ";" for x in b]

    def line(self, ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """``cut_a`` and ``cut_b`` hold the last places of each group, in order."""
        code_a, code_b = ids_a.astype(np.int64), ids_b + 2 * self.size_a
        code_a[cut_a] += self.size_a
        code_b[cut_b] += self.size_b
        # a token of A stands behind all tokens of the groups before it, one of B also behind A's of its own
        group_a = np.searchsorted(cut_a, np.arange(len(ids_a)))
        group_b = np.searchsorted(cut_b, np.arange(len(ids_b)))
        line = np.empty(len(ids_a) + len(ids_b), np.int64)
        line[np.arange(len(ids_a)) + np.concatenate([[0], cut_b + 1])[group_a]] = code_a
        line[np.arange(len(ids_b)) + cut_a[group_b] + 1] = code_b
        return "".join(map(self.words.__getitem__, line.tolist()))[:-1]


def lots(docs: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some ``LOT`` characters together."""
    first, size = 0, 0
    for k, text in enumerate(docs):
        if size and size + len(text) > LOT:
            yield first, k
            first, size = k, 0
        size += len(text)
    if len(docs) > first:
        yield first, len(docs)


def _ends(ids: list[np.ndarray], table: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a lot, the byte lengths of its texts by them, and the number of ids of each."""
    joined = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
    counts = np.array([len(x) for x in ids], np.int64)
    ends = np.concatenate([[0], np.cumsum(table.lengths[joined])])
    upto = np.cumsum(counts)
    return joined, ends[upto] - ends[upto - counts], counts


def link_type(size_a: int, size_b: int) -> str:
    """How links are packed: four bytes unless the vocabularies are too large for it."""
    return "<u4" if size_a * size_b <= 1 << 32 else "<i8"


def align_lot(docs: list[str], a: ByteLevel, b: Pieces, writer: Groups) -> list[tuple[int, int, int, str, bytes]]:
    """``n_a, n_b, n_groups, groups, links`` of each text of a lot; a link is ``a * size_b + b``."""
    out: list[tuple[int, int, int, str, bytes]] = [(0, 0, 0, "", b"")] * len(docs)
    held = [k for k, text in enumerate(docs) if text]
    whole = [(" " + docs[k]).encode("utf-8", "replace") for k in held]
    ids_a = [a.encode(" " + docs[k]) for k in held]
    ids_b = [np.array(x, np.int64) for x in b.encode([docs[k] for k in held])]
    sizes = np.array([len(w) for w in whole], np.int64)
    good = np.ones(len(held), bool)
    for ids, table in ((ids_a, a.bytes), (ids_b, b.bytes)):
        _, lengths, _ = _ends(ids, table)
        good &= lengths == sizes
    keep = np.flatnonzero(good)
    wanted = np.frombuffer(b"".join(whole[k] for k in keep), np.uint8)
    bounds = np.cumsum(sizes[keep])
    wrong = np.zeros(len(keep), bool)
    for ids, table in ((ids_a, a.bytes), (ids_b, b.bytes)):
        joined = _ends([ids[k] for k in keep], table)[0]
        wrong[np.searchsorted(bounds, table.spells(joined, wanted), side="right")] = True
    keep = keep[~wrong]
    all_a, _, n_a = _ends([ids_a[k] for k in keep], a.bytes)
    all_b, _, n_b = _ends([ids_b[k] for k in keep], b.bytes)
    # the texts of a lot stand one behind the other: the end of each is an end of both
    cut_a, cut_b = shared_ends(np.cumsum(a.bytes.lengths[all_a]), np.cumsum(b.bytes.lengths[all_b]))
    links = all_a[cut_a] * b.bytes.size + all_b[cut_b]
    links = links.astype(link_type(a.bytes.size, b.bytes.size))
    x0 = y0 = g0 = 0
    for k, x, y in zip(keep, np.cumsum(n_a).tolist(), np.cumsum(n_b).tolist()):
        g1 = int(np.searchsorted(cut_a, x))
        line = writer.line(all_a[x0:x], all_b[y0:y], cut_a[g0:g1] - x0, cut_b[g0:g1] - y0)
        out[held[k]] = (x - x0, y - y0, g1 - g0, line, links[g0:g1].tobytes())
        x0, y0, g0 = x, y, g1
    return out


def align(
    docs: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
    keep_groups: bool = True,
) -> DataFrame:
    """``row, doc_id, n_a, n_b, n_groups, groups, links``: where the tokens of A and B end together.

    A encodes a space and the text, special strings as plain text; B encodes the text and adds
    the space. Null and empty texts, and texts whose joined bytes differ from the space and the
    text (B's normaliser changed them), have no tokens: zeros, an empty ``groups``, no links.
    ``groups`` is the line of :class:`Groups`, its SHA-256 instead if ``keep_groups`` is false;
    ``links`` packs ``a * size_b + b`` of every link. One row per input row, without a shuffle:
    repeated rows and null or repeated ids stay, other columns go, an empty table gives none.
    """
    spark = docs.sparkSession
    a_file, b_file = share_file(spark, a_path), share_file(spark, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level_of(a_file, pattern, False), pieces_of(b_file)
        writer = Groups(a.bytes.size, b.bytes.size)
        for batch in slices(batches):
            every = texts(batch)
            done = [x for i, j in lots(every) for x in align_lot(every[i:j], a, b, writer)]
            lines = [x[3] if keep_groups or not x[3] else hashlib.sha256(x[3].encode()).hexdigest() for x in done]
            counts = [pa.array([x[k] for x in done], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *counts, pa.array(lines, pa.string()), pa.array([x[4] for x in done], pa.binary())],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "groups", "links"],
            )

    rows = only(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(
        run, "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, links binary"
    )


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, places = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(places, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)


def pair_counts(aligned: DataFrame, packing: str) -> DataFrame:
    """``pair, n``: links of the whole corpus by id pair, counted inside tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "n"])

        for batch in slices(batches):
            links = np.frombuffer(b"".join(x or b"" for x in batch.column("links").to_pylist()), packing)
            keys, times = np.unique(links, return_counts=True)
            held.append((keys.astype(np.int64), times))
            size += len(held[-1][0])
            if size > HELD_PAIRS:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield flush()
                    held, size = [], 0
        if held:
            held = [_merged(held)]
            yield flush()

    counted = aligned.select("links").mapInArrow(run, "pair bigint, n bigint")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def best_pairs(counts: DataFrame, size_b: int) -> DataFrame:
    """``pair, n, best``: whether no pair of the same B id is more frequent (ties are all best)."""
    tagged = counts.withColumn("b", F.expr(f"pair % {size_b}L"))
    top = tagged.groupBy("b").agg(F.max("n").alias("top"))  # at most one row per B id
    return tagged.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def least_hot(pairs: DataFrame, bound: int) -> int:
    """The least power of two so that at most ``bound`` pairs are as frequent; 1 if all fit."""
    classes = pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("c")).collect()
    total, least = 0, 1 << 62
    for row in sorted(classes, key=lambda r: -r["k"]):  # at most 63 rows
        total += row["c"]
        if total > bound:
            return least
        least = 1 << row["k"]
    return 1


def link_scores(aligned: DataFrame, pairs: DataFrame, packing: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Adds ``n_links, n_best, count_sum`` to the rows of ``aligned`` and drops ``links``.

    The counts of at most ``hot_pairs`` pairs, the most frequent, are broadcast (17 bytes
    each). Links of rarer pairs, if there are any, are joined: no such pair is a hot key.
    """
    least = least_hot(pairs, hot_pairs)
    hot = pairs.where(F.col("n") >= least).toArrow()  # at most hot_pairs rows
    order = np.argsort(hot["pair"].to_numpy())
    spark = aligned.sparkSession
    shared = spark.sparkContext.broadcast(
        (hot["pair"].to_numpy()[order], hot["n"].to_numpy()[order], hot["best"].to_numpy(zero_copy_only=False)[order])
    )
    columns = [c for c in aligned.columns if c != "links"]
    kinds = ", ".join(f"`{c}` {t}" for c, t in aligned.dtypes if c != "links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for batch in slices(batches):
            packed = [x or b"" for x in batch.column("links").to_pylist()]
            links = np.frombuffer(b"".join(packed), packing).astype(np.int64)
            lengths = np.array([len(x) for x in packed], np.int64) // np.dtype(packing).itemsize
            owner = np.repeat(np.arange(len(packed)), lengths)
            at = np.minimum(np.searchsorted(keys, links), max(len(keys) - 1, 0))
            known = keys[at] == links if len(keys) else np.zeros(len(links), bool)
            found, of = at[known], owner[known]
            sums = np.zeros(len(packed), np.int64)
            np.add.at(sums, of, counts[found])  # whole numbers, as float sums lose digits
            n_best = np.bincount(of[best[found]], minlength=len(packed))
            split = np.searchsorted(owner[~known], np.arange(len(packed) + 1))
            rest = pa.ListArray.from_arrays(pa.array(split.astype(np.int32)), pa.array(links[~known]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(lengths), pa.array(n_best.astype(np.int64)), pa.array(sums), rest],
                [*columns, "n_links", "n_best", "count_sum", "rest"],
            )

    scored = aligned.mapInArrow(run, f"{kinds}, n_links bigint, n_best bigint, count_sum bigint, rest array<bigint>")
    if least == 1:
        return scored.drop("rest")
    scored = stored(scored, "aligned-scores")
    rare = scored.where(F.size("rest") > 0).select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
    rare = rare.join(pairs.where(F.col("n") < least).hint("merge"), "pair")
    sums = rare.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum")
    )
    both = scored.drop("rest").join(sums, "row", "left")
    more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return both.select(*columns, "n_links", more("n_best", "more_best"), more("count_sum", "more_sum"))


def alignment(
    docs: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
    keep_groups: bool = True, hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """``row, doc_id, n_a, n_b, n_groups, groups, n_links, n_best, count_sum`` of every text.

    Rows as in :func:`align`. Each text is encoded once: its links are written to the shared
    folder, counted over the corpus, and scored against the counts. Ties for the highest count
    of a B id are all best; repeated rows count as often as they stand in the table.
    """
    aligned = stored(align(docs, a_path, pattern, b_path, id_col, text_col, keep_groups), "aligned")
    size_a, size_b = vocabulary_sizes(a_path, b_path)
    packing = link_type(size_a, size_b)
    pairs = stored(best_pairs(stored(pair_counts(aligned, packing), "pair-counts"), size_b), "pairs")
    return link_scores(aligned, pairs, packing, hot_pairs)
