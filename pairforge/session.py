"""Session helpers: local sessions for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and benches; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pairforge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: there the driver
    and the executors share one file system.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    named = tempfile.mkdtemp(prefix="pairforge-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries built and run inside drop their shuffle files as soon as they end.

    Otherwise these stay until the driver happens to collect its garbage, so a job of many
    queries holds the shuffles of all of them on disk.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage and stops a costly plan from running twice; survives the loss
    of an executor because the files are not kept on one. Packed more tightly than by
    default, as these files are most of what a query holds on disk besides its shuffles,
    and the shuffles of ``df`` go when it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with brief_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by ``keys`` only if the scan has fewer splits than there are cores.

    A large table keeps its scan splits and pays no shuffle here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (what ``--py-files`` does)."""
    root = os.path.dirname(os.path.abspath(__file__))
    key = "pairforge.shipped"
    if spark.conf.get(key, None) == root:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="pairforge-zip-"), "pairforge")
    archive = shutil.make_archive(target, "zip", os.path.dirname(root), "pairforge")
    spark.sparkContext.addPyFile(archive)
    spark.conf.set(key, root)
