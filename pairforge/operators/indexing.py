"""Dense ranks and order-statistic cutoffs without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def dense_index(df: DataFrame, order: list[str], name: str, keep: list[str] | None = None) -> DataFrame:
    """Add 0-based ``name`` = rank of the row by ``order`` (a unique key).

    Range partitioning sorts in parallel; each partition's rows are numbered locally and
    shifted by the row counts of the partitions before it (one row per partition, so the
    broadcast is bounded by the partition count). The sorted rows are written once, so
    the counts and the result see the same partitions. ``keep`` names the columns that are
    written and returned, all if it is not given.
    """
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    ordered = stored(numbered if keep is None else numbered.select(*keep, "_row"), "ranked")
    part = F.shiftright("_row", _ROW_BITS)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + local).cast("bigint"))
        .drop("_row", "_part", "_offset")
    )


def hash_cutoff(df: DataFrame, hash_col: str, size: Column) -> DataFrame:
    """One row ``cutoff``: the k-th smallest value of a hex digest column, null if k = 0.

    ``size`` gives k from the column ``n`` (the row count). Digests are uniform, so a
    histogram over their first five hex digits (at most 1,048,576 rows whatever the data
    size) finds the slot holding the k-th value, and only that slot, about a millionth of
    the rows, is ranked.
    """
    slots = df.groupBy(F.substring(hash_col, 1, 5).alias("slot")).agg(F.count("*").alias("c"))
    running = W.orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    whole = W.orderBy("slot").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    target = (
        slots.select(
            "slot",
            F.sum("c").over(running).alias("upto"),
            "c",
            F.sum("c").over(whole).alias("n"),
        )
        .withColumn("k", size.cast("bigint"))
        .where((F.col("k") > F.col("upto") - F.col("c")) & (F.col("k") <= F.col("upto")))
        .select("slot", (F.col("k") - (F.col("upto") - F.col("c"))).alias("rank"))
    )
    within = W.partitionBy("slot").orderBy(hash_col)
    return (
        df.select(hash_col, F.substring(hash_col, 1, 5).alias("slot"))
        .join(F.broadcast(target), "slot")
        .withColumn("_rn", F.row_number().over(within))
        .where(F.col("_rn") == F.col("rank"))
        .select(F.col(hash_col).alias("cutoff"))
    )
