"""Tables that are either whole or not there: staged writes and a commit record."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RECORD = "attempt string, at double, schemas string"


def fingerprint(rows: DataFrame) -> str:
    """Changes when a file of a file-based table is added, removed or rewritten; the driver sees two numbers."""
    meta = F.col("_metadata")
    files = rows.select(meta["file_path"].alias("p"), meta["file_size"].alias("s"), meta["file_modification_time"].alias("t")).distinct()
    got = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("p", "s", "t") % (1 << 40)).alias("h")).first()
    return f"{got['n']}-{got['h']}"


def key_path(root: str, key: dict[str, object]) -> str:
    """A folder per parameter set; its name starts with the values, its digest tells apart the rest."""
    text = json.dumps(key, sort_keys=True, default=str)
    return os.path.join(root, hashlib.sha256(text.encode()).hexdigest()[:32])


def committed(spark: SparkSession, home: str) -> dict[str, DataFrame] | None:
    """The tables of the first whole build under ``home``; None if there is none.

    Only what a commit record names is read, so what a build that died has left is never seen.
    """
    try:
        records = spark.read.schema(_RECORD).parquet(os.path.join(home, "commits", "*"))
        first = records.orderBy("at", "attempt").first()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if first is None:
        return None
    schemas = json.loads(first["schemas"])
    return {
        name: spark.read.schema(T.StructType.fromJson(schema)).parquet(os.path.join(home, first["attempt"], name))
        for name, schema in schemas.items()
    }


def read_or_build(
    spark: SparkSession, root: str, key: dict[str, object], build: Callable[[], dict[str, DataFrame]]
) -> dict[str, DataFrame]:
    """The tables stored under ``key``, built by ``build`` if no whole build is there.

    A build writes into a folder of its own; a record of one row, written last, makes it
    visible. Builders that run at the same time both finish; all then read the earlier one.
    """
    home = key_path(root, key)
    found = committed(spark, home)
    if found is None:
        attempt = f"build-{uuid.uuid4().hex}"
        tables = build()
        for name, rows in tables.items():
            rows.write.parquet(os.path.join(home, attempt, name))
        schemas = json.dumps({name: rows.schema.jsonValue() for name, rows in tables.items()})
        record = spark.range(1).select(F.lit(attempt).alias("attempt"), F.unix_micros(F.current_timestamp()).cast("double").alias("at"), F.lit(schemas).alias("schemas"))
        record.coalesce(1).write.parquet(os.path.join(home, "commits", attempt))
        found = committed(spark, home)
        assert found is not None
    return found
