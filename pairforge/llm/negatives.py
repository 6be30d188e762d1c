"""Operator 13: hard negatives, filtered by segment summaries refined level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import only, slices

#: Components of a segment of the finest level; a segment of the next level joins ``JOINED`` of them.
SEGMENT, JOINED = 4, 4
#: Anchors of a block, rows compared at once, and rows of a share at most.
ANCHORS, ROWS, SHARE = 1024, 2048, 1 << 20
_EXACT = 1 << 53
_LOW = -(1 << 62)


def summaries(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every segment of the finest level, a row for each vector."""
    n, dim = vectors.shape
    pad = -dim % SEGMENT
    parts = np.pad(vectors.astype(float), ((0, 0), (0, pad))).reshape(n, -1, SEGMENT)
    lengths = segment_lengths(dim)[0]
    means = parts.sum(2) / lengths
    inside = np.arange(dim + pad).reshape(-1, SEGMENT) < dim
    return means, np.sqrt((((parts - means[:, :, None]) * inside) ** 2).sum(2) / lengths)


def segment_lengths(dim: int) -> list[np.ndarray]:
    """Lengths of the segments of every level, the finest first."""
    lengths = np.full(-(-dim // SEGMENT), SEGMENT)
    if dim % SEGMENT:
        lengths[-1] = dim % SEGMENT
    levels = [lengths]
    while len(levels[-1]) > 1:
        levels.append(np.add.reduceat(levels[-1], np.arange(0, len(levels[-1]), JOINED)))
    return levels


class Summary:
    """Means and deviations of a set of vectors at all levels, from those of the finest.

    The product of two segments lies within length * (product of means +- product of
    deviations), so two matrix products bound the scores of all pairs from both sides.
    """

    def __init__(self, means: np.ndarray, deviations: np.ndarray, dim: int) -> None:
        levels = segment_lengths(dim)
        mean, square = means, deviations**2
        self.levels = [(means * np.sqrt(levels[0]), deviations * np.sqrt(levels[0]))]
        for fine, coarse in zip(levels, levels[1:]):
            at = np.arange(0, len(fine), JOINED)
            joined = np.add.reduceat(mean * fine, at, axis=1) / coarse
            second = np.add.reduceat((square + mean**2) * fine, at, axis=1) / coarse
            mean, square = joined, np.maximum(second - joined**2, 0.0)
            self.levels.append((mean * np.sqrt(coarse), np.sqrt(square * coarse)))
        self.norms = np.sqrt((self.levels[0][0] ** 2 + self.levels[0][1] ** 2).sum(1))

    def possible(self, rows: Summary, least: np.ndarray, most: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Which of ``pairs`` may score from ``least`` to ``most``; one of each for every vector of this set.

        From the coarsest level to the finest, each on the vectors that still have a pair.
        """
        for (m1, d1), (m2, d2) in zip(reversed(self.levels), reversed(rows.levels)):
            a, b = np.flatnonzero(pairs.any(1)), np.flatnonzero(pairs.any(0))
            if not len(a):
                break
            middle, reach = m1[a] @ m2[b].T, d1[a] @ d2[b].T
            reach += 1e-9 * np.outer(self.norms[a], rows.norms[b]) + 1e-6  # rounding
            inside = (middle + reach >= least[a, None]) & (middle - reach <= most[a, None])
            pairs[np.ix_(a, b)] &= inside
        return pairs


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all pairs; as floats while those hold them exactly."""
    top = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if a.shape[1] * top * top < _EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def top(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of every owner, ordered by owner, score and smaller id."""
    order = np.lexsort((ids, -score, owner))
    owner = owner[order]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
    rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
    return order[rank < k]


class Best:
    """The best ``k`` of every owner so far, and the least score that can still enter."""

    def __init__(self, owners: int, k: int) -> None:
        self.k = k
        self.owner, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(owners, _LOW)

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(owner):
            return
        owner, score, ids = (np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.ids, ids)))
        keep = top(owner, score, ids, self.k)
        self.owner, self.score, self.ids = owner[keep], score[keep], ids[keep]
        counts = np.bincount(self.owner, minlength=len(self.least))
        full = np.flatnonzero(counts == self.k)
        self.least[full] = self.score[np.cumsum(counts)[full] - 1]


class Vectors:
    """Rows of a batch as matrices."""

    def __init__(self, columns: dict[str, np.ndarray]) -> None:
        self.key, self.id, self.label = columns["key"], columns["id"], columns["label"]
        self.vector = columns["vector"]
        self.summary = Summary(columns["means"], columns["deviations"], self.vector.shape[1])
        self.columns = columns

    @staticmethod
    def read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {c: np.asarray(batch.column(c)) for c in ("key", "id", "label")}
        for c in ("vector", "means", "deviations"):
            out[c] = np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1)
        if "bands" in batch.schema.names:
            out["bands"] = np.asarray(batch.column("bands").flatten()).reshape(batch.num_rows, -1)
        return out

    @staticmethod
    def joined(parts: list[dict[str, np.ndarray]]) -> Vectors:
        return Vectors({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})


def positives_of(anchors: Vectors, k: int) -> tuple[Best, object]:
    """Running search of the ``k`` best other rows of the anchor's label."""
    best = Best(len(anchors.key), k)

    def add(rows: Vectors) -> None:
        pairs = (anchors.label[:, None] == rows.label[None, :]) & (anchors.key[:, None] != rows.key[None, :])
        a, b = np.flatnonzero(pairs.any(1)), np.flatnonzero(pairs.any(0))
        if len(a):
            pairs = anchors.summary.possible(rows.summary, best.least.astype(float), np.full(len(anchors.key), np.inf), pairs)
        for label in np.unique(anchors.label[a]):
            a, b = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
            block = pairs[np.ix_(a, b)]
            a, b = a[block.any(1)], b[block.any(0)]
            if len(a):
                found = scores(anchors.vector[a], rows.vector[b])
                x, y = np.nonzero(pairs[np.ix_(a, b)] & (found >= best.least[a, None]))
                best.add(a[x], found[x, y], rows.id[b[y]])

    return best, add


def negatives_of(anchors: Vectors, k: int) -> tuple[Best, object]:
    """Running search of the ``k`` best rows of another label inside each of the anchor's bands."""
    bands = anchors.columns["bands"].reshape(len(anchors.key), -1, 2)
    n = bands.shape[1]
    best = Best(len(anchors.key) * n, k)

    def add(rows: Vectors) -> None:
        low = np.maximum(bands[:, :, 0], best.least.reshape(-1, n))
        high = bands[:, :, 1]
        open_ = low <= high
        least = np.where(open_, low, -_LOW).min(1)
        most = np.where(open_, high, _LOW).max(1)
        pairs = (anchors.label[:, None] != rows.label[None, :]) & open_.any(1)[:, None]
        pairs = anchors.summary.possible(rows.summary, least.astype(float), most.astype(float), pairs)
        a, b = np.flatnonzero(pairs.any(1)), np.flatnonzero(pairs.any(0))
        if not len(a):
            return
        found = scores(anchors.vector[a], rows.vector[b])
        x, y = np.nonzero(pairs[np.ix_(a, b)] & (found >= least[a, None]) & (found <= most[a, None]))
        score, ids, a = found[x, y], rows.id[b[y]], a[x]
        for j in range(n):
            hit = (score >= low[a, j]) & (score <= high[a, j])
            best.add(a[hit] * n + j, score[hit], ids[hit])

    return best, add


def _search(anchors: DataFrame, rows: DataFrame, n_blocks: int, n_shares: int, kind: str, k: int) -> DataFrame:
    """``key, slot, found``: what each share of the rows has for each anchor, best first.

    Anchors go to every share of their block, rows to one share of every block; a task keeps
    its anchors and the best so far, and meets the rows in small lots. ``slot`` numbers the
    anchor's bands (0 without bands).
    """
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    bands = F.col("bands") if "bands" in anchors.columns else F.lit(None).cast("array<bigint>")
    columns = ["key", "id", "label", "vector", "means", "deviations"]
    asked = anchors.select(F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int").alias("block"), every(n_shares, "share"), F.lit(0).alias("kind"), *columns, bands.alias("bands"))
    held = rows.select(every(n_blocks, "block"), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(n_shares)).cast("int").alias("share"), F.lit(1).alias("kind"), *columns, F.lit(None).cast("array<bigint>").alias("bands"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, lot, size = None, [], [], 0
        anchors_here, best, add = None, None, None

        def flush() -> None:
            nonlocal lot, size, anchors_here, best, add
            if lot and own:
                if best is None:
                    anchors_here = Vectors.joined(own)
                    best, add = (positives_of if kind == "positives" else negatives_of)(anchors_here, k)
                add(Vectors.joined(lot))
            lot, size = [], 0

        def result() -> Iterator[pa.RecordBatch]:
            flush()
            if best is not None and len(best.owner):
                slots = len(best.least) // len(anchors_here.key)
                first = np.flatnonzero(np.r_[True, best.owner[1:] != best.owner[:-1]])
                offsets = pa.array(np.r_[first, len(best.owner)].astype(np.int32))
                found = pa.StructArray.from_arrays([pa.array(-best.score), pa.array(best.ids)], ["minus", "id"])
                owner = best.owner[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors_here.key[owner // slots]), pa.array((owner % slots).astype(np.int32)), pa.ListArray.from_arrays(offsets, found)],
                    ["key", "slot", "found"],
                )

        for batch in slices(batches, ROWS):
            block, share, kinds = (np.asarray(batch.column(c)) for c in ("block", "share", "kind"))
            group = np.stack([block, share, kinds], axis=1)
            cuts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(1)])
            for x, y in zip(cuts, np.r_[cuts[1:], len(group)]):
                if (block[x], share[x]) != at:
                    yield from result()
                    at, own, lot, size = (block[x], share[x]), [], [], 0
                    anchors_here, best, add = None, None, None
                part = Vectors.read(batch.slice(x, y - x))
                if kinds[x] == 0:
                    own.append(part)
                elif own:
                    part.pop("bands")
                    lot.append(part)
                    size += y - x
                    if size >= ROWS:
                        flush()
        yield from result()

    dealt = asked.unionByName(held).repartition("block", "share").sortWithinPartitions("block", "share", "kind")
    shares = dealt.mapInArrow(run, "key bigint, slot int, found array<struct<minus: bigint, id: bigint>>")
    merged = shares.groupBy("key", "slot").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    return merged


def quantised(rows: DataFrame, scale: int) -> tuple[DataFrame, int]:
    """``id, label, vector`` with whole components floor(scale * x), and their number.

    Left out: null ids and labels, vectors that are null, hold null or non-finite components,
    are of another than the commonest length, or so large (2^27 over the root of the length) that scores are no longer safe.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite)
    lengths = good.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    dim = lengths["n"] if lengths else 0
    bound = float(2**27 / max(dim, 1) ** 0.5)
    small = F.forall("vector", lambda x: F.abs(x * scale) < bound)
    whole = F.transform("vector", lambda x: F.floor(x * scale).cast("bigint"))
    return good.where((F.size("vector") == dim) & small).select("id", "label", whole.alias("vector")).distinct(), dim


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the anchors.

    Components become floor(scale * x), a score is the integer inner product with the anchor,
    higher first, ties to the smaller id. The positives of an anchor are its first
    ``positives`` other rows of its label. For each, the first ``negatives`` rows of another
    label are returned whose score is from ``low`` to ``high`` per cent of the positive's
    (none if that is negative). Fewer are returned if there are no more.

    ``is_anchor`` is a column over ``id``. Before pairs are scored, the means and deviations
    stored for each row's segments bound their scores; a pair goes on only while it may still
    enter what its anchor has. Results are exact. Rows that take no part: :func:`quantised`.
    Repeated rows count once, different rows of one id each; other columns of the input are
    dropped; an empty table gives no row.
    """
    spark = rows.sparkSession
    good, dim = quantised(only(rows, id=(id_col, "bigint"), label=(label_col, "bigint"), vector=(vector_col, "array<double>")), scale)
    if not dim:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            vectors = np.asarray(batch.column("vector").flatten()).reshape(batch.num_rows, -1)
            parts = summaries(vectors)
            step = pa.array(np.arange(0, parts[0].size + 1, parts[0].shape[1], dtype=np.int32))
            lists = [pa.ListArray.from_arrays(step, pa.array(p.ravel())) for p in parts]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "means", "deviations"])

    kinds = "id bigint, label bigint, vector array<bigint>, means array<double>, deviations array<double>"
    table = stored(good.mapInArrow(summarise, kinds).withColumn("key", F.monotonically_increasing_id()), "segments")
    anchors = table.where(is_anchor)
    n_rows, n_anchors = table.count(), anchors.count()
    n_blocks = max(1, -(-n_anchors // ANCHORS))
    cores = spark.sparkContext.defaultParallelism
    n_shares = max(-(-n_rows // SHARE), min(-(-n_rows // ROWS), -(-3 * cores // n_blocks)), 1)

    near = stored(_search(anchors, table, n_blocks, n_shares, "positives", positives), "positives")
    # per cent of a whole score, rounded into the band; a missing positive has an empty band
    whole = lambda x: ((x - F.pmod(x, F.lit(100))) / 100).cast("bigint")
    band = lambda x: F.array(-whole(x["minus"] * low), whole(-x["minus"] * high))
    none = F.array_repeat(F.array(F.lit(1).cast("bigint"), F.lit(0).cast("bigint")), F.lit(positives) - F.size("found"))
    banded = near.select("key", F.flatten(F.concat(F.transform("found", band), none)).alias("bands"))
    asked = anchors.join(banded.hint("merge"), "key")
    far = _search(asked, table, n_blocks, n_shares, "negatives", negatives)
    named = near.join(anchors.select("key", F.col("id").alias("anchor_id")).hint("merge"), "key")
    named = named.select("key", "anchor_id", F.posexplode("found").alias("slot", "positive"))
    joined = named.join(far.hint("merge"), ["key", "slot"])
    placed = joined.select("anchor_id", "positive", F.posexplode("found").alias("place", "negative"))
    return placed.select(
        "anchor_id", F.col("positive.id").alias("positive_id"), (F.col("place") + 1).alias("rank"), F.col("negative.id").alias("negative_id"),
        (-F.col("positive.minus")).alias("positive_score"), (-F.col("negative.minus")).alias("negative_score"),
    )
