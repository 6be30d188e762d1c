"""Operator 10: approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import only, slices


#: Queries whose worst hit a task remembers; beyond, it begins anew and gives more hits than needed.
KNOWN_QUERIES = 1 << 20


class Forest:
    """Binary trees that halve a sample by random directions, one direction to a level of a tree.

    For inner products, vectors get one component more, sqrt(longest^2 - length^2), and
    queries are scaled to the longest and get a zero: the largest product is then the least
    distance. Node k of a tree has children 2k and 2k + 1; leaves are numbered from 0 in each tree.
    The key of a leaf for a query is the distance, in the directions of the tree, that
    the query has to move to get into the leaf.
    """

    def __init__(self, sample: np.ndarray, longest: float, trees: int, depth: int, seed: int) -> None:
        self.trees, self.depth, self.longest = trees, depth, longest
        self.leaves = 1 << depth
        rng = np.random.default_rng(seed)
        self.normal = rng.normal(size=(trees, max(depth, 1), sample.shape[1] + 1))
        self.normal /= np.linalg.norm(self.normal, axis=2, keepdims=True)
        self.cut = np.zeros((trees, self.leaves))
        along = self._along(self.lifted(sample))
        for t in range(trees):
            at = np.ones(len(sample), int)
            for level in range(depth):
                order = np.lexsort((along[:, t, level], at))
                nodes, starts, sizes = np.unique(at[order], return_index=True, return_counts=True)
                values = along[order, t, level]
                self.cut[t, nodes] = (values[starts + (sizes - 1) // 2] + values[starts + sizes // 2]) / 2
                at = 2 * at + (along[:, t, level] > self.cut[t, at])

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest**2 - (vectors**2).sum(1), 0.0)
        return np.hstack([vectors, np.sqrt(rest)[:, None]])

    def asked(self, vectors: np.ndarray) -> np.ndarray:
        length = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        return np.hstack([vectors * (self.longest / length), np.zeros((len(vectors), 1))])

    def _along(self, points: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tld->ntl", points, self.normal, optimize=True)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree."""
        along = self._along(self.lifted(vectors))
        out = np.empty((len(vectors), self.trees), np.int32)
        for t in range(self.trees):
            at = np.ones(len(vectors), int)
            for level in range(self.depth):
                at = 2 * at + (along[:, t, level] > self.cut[t, at])
            out[:, t] = at - self.leaves
        return out

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Squared key of every leaf (query, tree, leaf)."""
        along = self._along(self.asked(vectors))
        key = np.zeros((len(vectors), self.trees, 1))
        for level in range(self.depth):
            margin = along[:, :, level, None] - self.cut[None, :, 1 << level : 2 << level]
            sides = np.stack([np.maximum(margin, 0) ** 2, np.minimum(margin, 0) ** 2], axis=3)
            key = (key[..., None] + sides).reshape(len(vectors), self.trees, -1)
        return key

    def calibrated(self, sample: np.ndarray, k: int, recall: float, queries: int = 256) -> float:
        """The squared key within which the share ``recall`` of the sample's own ``k`` nearest lies.

        Exact neighbours of the first ``queries`` rows among the sample say so. In a table
        larger than its sample neighbours are closer, so that the bound errs to more recall.
        """
        places, reached = self.places(sample), []
        for start in range(0, min(queries, len(sample)), 64):
            some = sample[start : min(start + 64, queries)]
            scores = some @ sample.T
            scores[np.arange(len(some)), start + np.arange(len(some))] = -np.inf
            near = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
            key = self.keys(some)
            at = np.stack([key[np.arange(len(some))[:, None], t, places[near, t]] for t in range(self.trees)])
            reached.append(at.min(axis=0).ravel())
        found = np.concatenate(reached)
        return float(np.quantile(found, recall)) if len(found) else np.inf

    def search(self, vector: np.ndarray, rows: np.ndarray, reach: float, least_rows: int) -> np.ndarray:
        """Which leaves to visit (tree, leaf), by one priority queue that all trees share.

        Nearest leaves come first. The search stops where the nearest one left is farther than ``reach`` and
        ``least_rows`` rows are met. ``rows`` has the number of vectors in each leaf.
        """
        along = self._along(self.asked(vector[None]))[0]
        queue = [(0.0, t, 1, 0) for t in range(self.trees)]
        out, met = np.zeros((self.trees, self.leaves), bool), 0
        while queue and (queue[0][0] <= reach or met < least_rows):
            key, t, node, level = heappop(queue)
            if level == self.depth:
                out[t, node - self.leaves] = True
                met += rows[t, node - self.leaves]
                continue
            margin = along[t, level] - self.cut[t, node]
            heappush(queue, (key + max(margin, 0.0) ** 2, t, 2 * node, level + 1))
            heappush(queue, (key + min(margin, 0.0) ** 2, t, 2 * node + 1, level + 1))
        return out


def depth_for(rows: int, sample_rows: int, leaf_rows: int) -> int:
    """Levels that give leaves of ``leaf_rows`` rows at most, as far as a leaf keeps 16 rows of the sample."""
    wanted = math.ceil(math.log2(max(rows / leaf_rows, 1)))
    return min(wanted, int(math.log2(max(sample_rows / 16, 1))))


def blocks_of(counts: np.ndarray, block_rows: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """``tree, leaf, group, blocks`` of every leaf, and the tree of every group.

    A group is a run of leaves of one tree with about ``block_rows`` rows together, or one leaf
    that has more; that one is cut into ``blocks`` of about so many.
    """
    rows, tree_of = [], []
    for t, leaves in enumerate(counts):
        held = block_rows + 1
        for leaf, n in enumerate(leaves.tolist()):
            if held + n > block_rows:
                tree_of.append(t)
                held = 0
            held += n
            rows.append((t, leaf, len(tree_of) - 1, max(1, -(-n // block_rows))))
    return rows, tree_of


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("vector")
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def usable(rows: DataFrame) -> DataFrame:
    """``id, vector`` of the rows that take part.

    Left out: null ids, and vectors that are null, zero, of another than the commonest
    length, or hold null or non-finite components.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(finite & F.exists("vector", lambda x: x != 0))
    lengths = good.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return good.where(F.size("vector") == (lengths["n"] if lengths else -1))


def nearest(
    rows: DataFrame,
    is_query: Column | None = None,
    k: int = 20,
    trees: int = 4,
    leaf_rows: int = 256,
    recall: float = 0.95,
    sample_rows: int = 20_000,
    block_bytes: int = 16 << 20,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest by inner product of the rows that ``is_query`` selects.

    The trees are fitted on at most ``sample_rows`` rows (least by a hash of the id); every
    row is indexed. Trees are as deep as leaves of about ``leaf_rows`` rows need, as far as the sample
    has 16 rows to a leaf. How far a search goes is measured on the sample (``recall``,
    :meth:`Forest.calibrated`), so it follows the data: it visits few leaves where rows are
    clustered, most where they are spread alike in all directions. Queries are sent to
    blocks of about ``block_bytes`` of vectors of neighbouring leaves, with the leaves they visit; a
    row met in several trees is compared in the first of them only, so that no query makes
    more comparisons than there are rows. Each block gives those of a query's best ``k`` that
    the blocks before it in the task do not rule out, and the best of all blocks are its answer. Scores are exact, in double precision.

    ``is_query`` is a column over ``id`` (default: divisible by 20). Nearest first, ties to
    the smaller id. A row is never its own neighbour; repeated rows of an id count once for
    each different vector. Rows that cannot take part (:func:`usable`) neither ask nor
    answer. Fewer than ``k`` candidates are all returned; an empty table gives no row.
    """
    spark = rows.sparkSession
    good = usable(only(rows, id=(id_col, "bigint"), vector=(vector_col, "array<double>")))
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    good = stored(good.distinct(), "vectors")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    longest = good.agg(F.max(length).alias("n")).first()["n"]
    if longest is None:
        return empty
    # sample_rows vectors at most
    sample = good.orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample_rows).toPandas()
    points = np.stack(sample["vector"])
    built = Forest(points, longest, trees, depth_for(good.count(), len(points), leaf_rows), seed)
    reach = built.calibrated(points, k, recall)
    shared = spark.sparkContext.broadcast(built)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            at = shared.value.places(_vectors(batch))
            leaves = pa.ListArray.from_arrays(np.arange(0, at.size + 1, trees, dtype=np.int32), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), leaves], ["id", "vector", "leaves"])

    indexed = stored(good.mapInArrow(index, "id bigint, vector array<double>, leaves array<int>"), "leaves")
    in_trees = indexed.select("*", F.posexplode("leaves").alias("tree", "leaf"))
    counts = np.zeros((trees, built.leaves), int)
    for t, leaf, n in in_trees.groupBy("tree", "leaf").count().collect():  # a row per leaf
        counts[t, leaf] = n
    grouping, tree_of = blocks_of(counts, max(leaf_rows, block_bytes // (8 * points.shape[1])))
    group_of = np.zeros((trees, built.leaves), np.int32)
    blocks = np.ones(len(tree_of), np.int32)
    for t, leaf, group, n in grouping:
        group_of[t, leaf], blocks[group] = group, max(n, blocks[group])
    # a row per leaf, sample_rows / 16 for each tree at most
    by_leaf = F.broadcast(spark.createDataFrame(grouping, "tree int, leaf int, group int, blocks int"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            row, group, block, visits = [], [], [], []
            for i, vector in enumerate(_vectors(batch)):
                visited = shared.value.search(vector, counts, reach, 4 * k)
                bits = np.packbits(visited).tobytes()
                for g in np.unique(group_of[visited & (counts > 0)]).tolist():
                    for part in range(blocks[g]):
                        row.append(i)
                        group.append(g)
                        block.append(part)
                        visits.append(bits)
            at = pa.array(row, pa.int64())
            arrays = [pa.array(group, pa.int32()), pa.array(block, pa.int32()), batch.column("id").take(at), batch.column("vector").take(at)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(visits, pa.binary())], ["group", "block", "id", "vector", "visited"])

    asked = good.where(F.col("id") % 20 == 0 if is_query is None else is_query)
    routed = asked.mapInArrow(route, "group int, block int, id bigint, vector array<double>, visited binary")
    own = F.pmod(F.xxhash64("id", "vector"), F.col("blocks")).cast("int")
    held = in_trees.join(by_leaf, ["tree", "leaf"]).select(
        "group", own.alias("block"), F.lit(False).alias("is_query"), "id", "vector", "leaves", F.lit(None).cast("binary").alias("visited")
    )
    no_leaves = F.array().cast("array<int>").alias("leaves")
    sent = routed.select("group", "block", F.lit(True).alias("is_query"), "id", "vector", no_leaves, "visited")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, matrix = None, [], None
        worst: dict[int, float] = {}  # of the k best of a query in one of this task's blocks; what is below is ruled out
        for batch in slices(batches, 1024):
            group, block, kind = (np.asarray(batch.column(c)) for c in ("group", "block", "is_query"))
            own_ids, own_vectors = np.asarray(batch.column("id")), _vectors(batch)
            change = (group[1:] != group[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])
            cuts = np.flatnonzero(np.r_[True, change])
            out: list[list[np.ndarray]] = [[], [], []]
            for a, b in zip(cuts, np.r_[cuts[1:], len(group)]):
                if (group[a], block[a]) != at:
                    at, parts, matrix = (group[a], block[a]), [], None
                if not kind[a]:
                    leaves = np.asarray(batch.column("leaves").slice(a, b - a).flatten()).reshape(b - a, trees)
                    parts.append((own_ids[a:b], own_vectors[a:b], leaves))
                    continue
                if not parts:
                    continue
                if matrix is None:
                    names, matrix, leaves = (np.concatenate(x) for x in zip(*parts))
                    slack = 4 * matrix.shape[1] * np.finfo(float).eps * np.linalg.norm(matrix, axis=1).max()
                tree = tree_of[group[a]]
                for q in range(a, b):
                    bits = np.frombuffer(batch.column("visited")[q].as_py(), np.uint8)
                    visited = np.unpackbits(bits, count=counts.size).reshape(counts.shape).astype(bool)
                    meets = visited[tree][leaves[:, tree]] & (names != own_ids[q])
                    for earlier in range(tree):
                        meets &= ~visited[earlier][leaves[:, earlier]]
                    met = np.flatnonzero(meets)
                    if not len(met):
                        continue
                    vector = own_vectors[q]
                    scores = matrix[met] @ vector
                    # all that the rounding of the fast product may hold apart from the k-th best, ties included
                    n = min(k, len(met))
                    edge = np.partition(scores, len(met) - n)[-n] - slack * np.linalg.norm(vector)
                    picked = met[scores >= edge]
                    exact = (matrix[picked] * vector).sum(1)
                    keep = np.lexsort((names[picked], -exact))
                    # several vectors of an id with one score take one rank
                    new = (exact[keep][1:] != exact[keep][:-1]) | (names[picked][keep][1:] != names[picked][keep][:-1])
                    keep = keep[np.r_[True, new]][:k]
                    floor = worst.get(own_ids[q], -np.inf)
                    if len(keep) == k and exact[keep[-1]] > floor:
                        if len(worst) >= KNOWN_QUERIES:
                            worst.clear()
                        worst[own_ids[q]] = exact[keep[-1]]
                    keep = keep[exact[keep] >= floor]
                    out[0].append(np.full(len(keep), own_ids[q]))
                    out[1].append(names[picked][keep])
                    out[2].append(exact[keep])
            if out[0]:
                arrays = [pa.array(np.concatenate(x), t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

    # vectors come before queries in every block
    grouped = held.union(sent).repartition("group", "block").sortWithinPartitions("group", "block", "is_query")
    hits = grouped.mapInArrow(compare, "query_id bigint, vec_id bigint, score double")
    # an id with several vectors of the same score takes one rank
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score").distinct()
