"""Links inside clusters that are too large for one comparison, without copying a set to every other block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import slices
from .components import components

#: What compares sets: ids and sets of distinct elements to links that join the ones alike.
Compare = Callable[[list[int], list[np.ndarray]], list[tuple[int, int]]]


#: Orders of hashes by which sets are joined before the rest is searched; only speed depends on it.
ORDERS = 3


def compared(groups: DataFrame, compare: Compare) -> DataFrame:
    """``a, b``: links of each group; ``groups`` has ``g`` (a group's columns), ``u`` and ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets = None, [], []
        found: list[tuple[int, int]] = []

        def ready() -> pa.RecordBatch:
            sides = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
            found.clear()
            return pa.RecordBatch.from_arrays(sides, ["a", "b"])

        for batch in slices(batches):
            words = batch.column("words")
            for row, (g, u) in enumerate(zip(batch.column("g").to_pylist(), batch.column("u").to_pylist())):
                if g != at:
                    if len(ids) > 1:
                        found.extend(compare(ids, sets))
                    at, ids, sets = g, [], []
                if not ids or ids[-1] != u:  # repeated rows stand side by side
                    ids.append(u)
                    sets.append(np.asarray(words[row].values).view(np.uint64))
            yield ready()
        if len(ids) > 1:
            found.extend(compare(ids, sets))
        yield ready()

    ordered = groups.repartition("g").sortWithinPartitions("g", "u")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def _by_least(sets: DataFrame, seed: int) -> DataFrame:
    """Groups of sets that have one least hash, by ``ORDERS`` orders: like sets mostly share one; a set is in as many groups at most."""
    def least_of(k: int) -> Column:
        return F.array_min(F.transform("words", lambda w: F.xxhash64(w, F.lit(k))))

    least = [least_of(k) for k in range(seed, seed + ORDERS)]
    keyed = sets.select("cluster", "u", "room", "words", F.posexplode(F.array(*least)).alias("order", "key"))
    lists = keyed.groupBy(F.col("cluster").alias("c"), F.col("order").alias("o"), F.col("key").alias("k")).agg(F.count("*").alias("held")).where("held > 1")
    met = keyed.join(lists, (F.col("cluster") == F.col("c")) & (F.col("order") == F.col("o")) & (F.col("key") == F.col("k")))
    # dealt anew in each order, so that the blocks of long lists are joined, too
    own = F.pmod(F.xxhash64("u", F.col("order") + seed), F.ceil(F.col("held") / F.col("room")))
    return met.select(F.struct("cluster", "order", "key", own.alias("own")).alias("g"), "u", "words")


def dealt(sets: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """``g, u``: groups in which every two alike sets of a cluster meet that ``labels`` do not join yet.

    ``labels`` has ``node, root`` of the sets that are joined. Elements are ordered by how
    many sets of the cluster have them, rarest first. Two sets of that similarity share one
    of the first ``n - ceil(n * similarity) + 1`` elements, so lists by these hold every pair.
    A list with sets of one root has nothing to find. In a longer one the sets of its
    commonest root need not meet each other: they stand in blocks, and the others, few as a
    rule, come to each block.
    """
    known = sets.join(labels, F.col("u") == F.col("node"), "left").select("cluster", "u", "room", "words", F.coalesce("root", "u").alias("root"))
    each = known.select("cluster", "u", "room", "root", F.explode("words").alias("e"))
    mixed = F.min("root") != F.max("root")
    counts = each.groupBy(F.col("cluster").alias("c"), F.col("e").alias("x")).agg(F.count("*").alias("held"), mixed.alias("mixed"))
    ranked = each.join(counts, (F.col("cluster") == F.col("c")) & (F.col("e") == F.col("x")))
    ranked = ranked.groupBy("cluster", "u", "room", "root").agg(F.array_sort(F.collect_list(F.struct("held", "e", "mixed"))).alias("r"))
    first = F.size("r") - F.ceil(F.size("r") * similarity - 1e-6) + 1
    rows = ranked.select("cluster", "u", "room", "root", F.explode(F.slice("r", F.lit(1), first.cast("int"))).alias("s")).where("s.mixed")
    lists = stored(rows.select("cluster", "u", "room", "root", F.col("s.e").alias("e")), "lists")

    same = (F.col("cluster") == F.col("c")) & (F.col("e") == F.col("x"))
    of_root = lists.groupBy(F.col("cluster").alias("c"), F.col("e").alias("x"), "root").agg(F.count("*").alias("n"), F.max("room").alias("room"))
    shape = of_root.groupBy("c", "x").agg(
        F.sum("n").alias("all"), F.max("n").alias("most"), F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots"),
        F.max("room").alias("room"),
    ).where("roots > 1")
    few = F.col("all") <= 2 * F.col("room")
    shape = shape.select(
        "c", "x", "main", "roots", few.alias("few"),
        F.ceil(F.col("most") / F.col("room")).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("most")) / F.col("room")).cast("int").alias("others"),
    )
    met = lists.drop("room").join(shape, same)
    main = F.col("root") == F.col("main")

    def place(kind: int, i: Column, j: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    until = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    in_block = F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")
    in_other = F.pmod(F.xxhash64("u"), F.col("others")).cast("int")
    at_main = F.transform(until("others"), lambda k: place(1, in_block, k))
    at_other = F.transform(until("blocks"), lambda k: place(1, k, in_other))
    among = F.transform(until("others"), lambda k: place(2, F.least(in_other, k), F.greatest(in_other, k)))
    at_other = F.when(F.col("roots") > 2, F.concat(at_other, among)).otherwise(at_other)
    places = F.when(F.col("few"), F.array(place(0, F.lit(0), F.lit(0)))).when(main, at_main).otherwise(at_other)
    return met.select("cluster", "e", "u", F.explode(places).alias("p")).select(F.struct("cluster", "e", "p").alias("g"), "u")


def crowd_links(sets: DataFrame, compare: Compare, similarity: float) -> DataFrame:
    """``a, b``: links that join the sets of each cluster as a comparison of all its pairs would.

    ``sets`` has ``cluster, u, words`` (hashes, each once) and ``room``, half of the sets that a
    task compares at a time. ``compare`` links two sets only if their Jaccard similarity is
    ``similarity`` or more. Sets of one least hash are compared first, so many at a time, then
    those not joined to a lesser one, so that copies are mostly joined; the pairs left are
    found by :func:`dealt`. Nothing is left out: only pairs that
    are joined already, or share no rare element and so cannot be alike, do not meet.
    """
    sets = stored(sets, "crowds")
    links = stored(compared(_by_least(sets, 0), compare), "links")
    labels = stored(components(links), "labels")
    rest = sets.join(labels, F.col("u") == F.col("node"), "left_anti")
    links = links.union(stored(compared(_by_least(rest, ORDERS), compare), "links"))
    labels = stored(components(links), "labels")
    left = dealt(sets, labels, similarity)
    words = sets.select(F.col("cluster").alias("c"), F.col("u").alias("x"), "words")
    groups = left.join(words, (F.col("g.cluster") == F.col("c")) & (F.col("u") == F.col("x"))).select("g", "u", "words")
    return links.union(compared(groups, compare))
