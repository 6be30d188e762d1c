"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum; all that the driver sees of the edges."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("sum")).first()
    return row["n"], row["sum"] or 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction; ``a > b`` in and out.

    The least neighbour of a node is an aggregate with map-side combine, and goes back to
    its edges by a join that Spark may split, so a node with very many edges is not a task.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        least = least.select("node", F.least("node", "least").alias("least"))
        out = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        moved = edges.join(least, F.col("a") == F.col("node")).where(F.col("b") != F.col("least"))
        out = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: every node that is not the least of its component, with the least.

    ``edges`` has two columns of one ordered type; direction, repeats and loops do not
    matter. Large-star and small-star steps in turn (Kiveris et al. 2014) take about
    log(diameter) rounds; each writes its edges to the shared folder, so lineage stays
    short and a lost executor costs one round at most.
    """
    first, second = edges.columns
    now = edges.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b")).where("a != b").distinct()
    now = stored(now, "edges")
    before = _state(now)
    while before[0]:
        now = stored(_star(_star(now, large=True), large=False), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
