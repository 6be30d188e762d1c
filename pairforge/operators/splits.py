"""Train/validation splits of exact size, by pair or by original sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import SEED, digest
from ..session import stored
from .indexing import hash_cutoff

VALIDATION_SHARE = 0.01


def _mark(df: DataFrame, cutoff: DataFrame) -> DataFrame:
    held = F.coalesce(F.col("_h") <= cutoff.scalar(), F.lit(False))
    return df.withColumn("split", F.when(held, "validation").otherwise("train")).drop("_h")


def split_pairs(pairs: DataFrame, share: float = VALIDATION_SHARE, seed: int = SEED) -> DataFrame:
    """Exactly ``int(share * n)`` pairs become validation: those with the smallest digests.

    The cutoff digest is one scalar, so marking the rows is a projection: no join. The
    pairs are written once, as finding the cutoff and marking read them three times.
    """
    hashed = stored(pairs.withColumn("_h", digest(seed, F.col("source"))), "hashed")
    return _mark(hashed, hash_cutoff(hashed, "_h", F.floor(F.col("n") * F.lit(share))))


def split_originals(pairs: DataFrame, share: float = VALIDATION_SHARE, seed: int = SEED) -> DataFrame:
    """As ``split_pairs``, but whole originals are held out, so no target is on both sides."""
    originals = pairs.groupBy("target").agg(F.lit(1).alias("one")).select(digest(seed, F.col("target")).alias("_h"))
    hashed = pairs.withColumn("_h", digest(seed, F.col("target")))
    return _mark(hashed, hash_cutoff(originals, "_h", F.floor(F.col("n") * F.lit(share))))


def split_sizes(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("n_pairs"))


def leaked_targets(split: DataFrame) -> DataFrame:
    """Originals present in both parts, with their pairs in each; combines map-side."""
    held = F.col("split") == "validation"
    return (
        split.groupBy("target")
        .agg(F.count_if(~held).alias("n_train"), F.count_if(held).alias("n_validation"))
        .where((F.col("n_train") > 0) & (F.col("n_validation") > 0))
    )
