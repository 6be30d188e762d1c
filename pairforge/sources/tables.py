"""Parquet tables of the pair builder, keyed by every parameter that shaped them."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import committed

PAIRS_SCHEMA = "source string, target string, doc_id bigint, sent_pos int, variant int, is_identity boolean"


def write_sentences(sentences: DataFrame, path: str) -> None:
    sentences.write.mode("overwrite").parquet(path)


def write_vocab(vocab: DataFrame, path: str, tokenizer: str = "word") -> None:
    """One table for both directions of both sides: ``side`` and ``tokenizer`` partitions."""
    vocab.withColumn("tokenizer", F.lit(tokenizer)).write.mode("overwrite").partitionBy("side", "tokenizer").parquet(path)


def read_vocab(spark: SparkSession, path: str, side: str, tokenizer: str = "word") -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where((F.col("side") == side) & (F.col("tokenizer") == tokenizer)).drop("tokenizer")


def pairs_key(n: int, rep: int, p: float, mode: str) -> dict[str, object]:
    return {"table": "pairs", "n": n, "rep": rep, "p": p, "mode": mode}


def read_pairs(spark: SparkSession, root: str, n: int, rep: int, p: float, mode: str) -> DataFrame | None:
    """The stored pairs of a parameter set; None if they were never built to the end."""
    found = committed.committed(spark, committed.key_path(root, pairs_key(n, rep, p, mode)))
    return None if found is None else found["pairs"]


def pairs_or_empty(spark: SparkSession, root: str, n: int, rep: int, p: float, mode: str) -> DataFrame:
    """The stored pairs, or an empty table and a warning."""
    found = read_pairs(spark, root, n, rep, p, mode)
    if found is None:
        warnings.warn(f"no pairs are stored for n={n}, rep={rep}, p={p}, mode={mode}", stacklevel=2)
        return spark.createDataFrame([], PAIRS_SCHEMA)
    return found


def read_or_build(spark: SparkSession, root: str, n: int, rep: int, p: float, mode: str, build) -> DataFrame:
    """Reuse the pairs of exactly these parameters, or build and store them."""
    return committed.read_or_build(spark, root, pairs_key(n, rep, p, mode), lambda: {"pairs": build()})["pairs"]


def append_scalars(rows: DataFrame, path: str) -> None:
    """Append long metric rows ``run_id, tag, step, value``."""
    rows.write.mode("append").partitionBy("tag").parquet(path)


def append_scalars_once(rows: DataFrame, batch_id: int, path: str) -> None:
    """Metric rows of one micro-batch (for ``foreachBatch``): a batch that comes again replaces its own rows.

    Rows go to the folder of their batch; :func:`read_scalars` reads all of them.
    """
    rows.write.mode("overwrite").partitionBy("tag").parquet(f"{path}/batch={batch_id}")


def read_scalars(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, tag, step, value`` of all micro-batches."""
    return spark.read.parquet(path).select("run_id", "tag", "step", "value")


def wide_scalars(rows: DataFrame, tags: list[str]) -> DataFrame:
    """One column per tag; the tag list is given, so no extra pass finds it."""
    return rows.groupBy("run_id", "step").pivot("tag", tags).agg(F.max("value"))


CONFIG_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("p_dropout", T.DoubleType()),
        T.StructField("hidden_dim", T.IntegerType()),
        T.StructField("encoderLayer", T.IntegerType()),
        T.StructField("decoderLayer", T.IntegerType()),
        T.StructField("batchSize", T.IntegerType()),
        T.StructField("dataSet_probability", T.DoubleType()),
        T.StructField("dataSet_repetition", T.IntegerType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Run configurations as JSON lines; malformed entries are left out, not fatal.

    The searched parameters are typed columns; ``config`` keeps every key of the entry.
    """
    lines = spark.read.text(path)
    typed = F.from_json("value", CONFIG_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select(typed.alias("c"), F.from_json("value", "map<string,string>").alias("config")).select("c.*", "config")
    return rows.where(F.col("_corrupt").isNull() & F.col("run_id").isNotNull()).drop("_corrupt")


# The files of a run's folder, and the key of its score.
CONFIG_FILES = ("config.yaml", "config.yml", "config.json")
SCORE_FILE = "best_model.json"
SCORE_KEY = "best_metric_ChrF"


def _yaml_map(text: Column) -> Column:
    """Flat ``key: value`` lines as a map; null if a line is neither that, blank, nor a comment."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: ~x.rlike(r"^\s*(#.*|---.*|\.\.\.\s*)?$"))
    key = lambda x: F.regexp_extract(x, r"^([A-Za-z_][\w.\-]*)\s*:(?:\s+|$)", 1)
    written = lambda x: F.regexp_extract(x, r"^[^:]+:\s*(.*)$", 1)
    quoted = r"""^(["'])(.*)\1\s*(#.*)?$"""
    bare = lambda x: F.trim(F.regexp_replace(written(x), r"(^|\s+)#.*$", ""))
    value = lambda x: F.when(written(x).rlike(quoted), F.regexp_extract(written(x), quoted, 2)).otherwise(bare(x))
    entries = F.transform(lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    last = F.filter(entries, lambda e, i: F.size(F.filter(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])) == 0)
    return F.when(F.forall(lines, lambda x: key(x) != "") & (F.size(lines) > 0), F.map_from_entries(last))


def read_run_folders(spark: SparkSession, path: str, score_file: str = SCORE_FILE, score_key: str = SCORE_KEY) -> tuple[DataFrame, DataFrame]:
    """Runs with ``run, path, best_chrf, config``, and what was wrong with the others: ``run, problem``.

    A run is a folder (at any depth below ``path``) with a score file, JSON with the key
    ``score_key``, and a configuration: flat YAML or JSON over any number of lines. A folder
    written by Spark may hold a file as ``file=<name>/part-...``. A folder that lacks one of
    the files, or holds a broken one, is listed with its problem and does not end the scan.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    at = F.col("_metadata.file_path")
    parts = r"^(.*?)(?:/file=([^/]+)/[^/]+|/([^/]+))$"
    name = F.concat(F.regexp_extract(at, parts, 2), F.regexp_extract(at, parts, 3))
    named = files.select(F.regexp_extract(at, parts, 1).alias("path"), name.alias("name"), "value")
    named = named.where(F.col("name").isin(*CONFIG_FILES, score_file))
    config_file = F.col("name") != score_file
    runs = named.groupBy("path").agg(
        F.max(F.when(~config_file, F.col("value"))).alias("score"),
        F.min_by(F.when(config_file, F.struct("name", "value")), F.when(config_file, F.col("name"))).alias("c"),
    )
    text = F.col("c.value")
    as_json = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    config = F.when(F.col("c.name").endswith(".json"), as_json).otherwise(_yaml_map(text))
    score = F.get_json_object("score", f"$.{score_key}")
    judged = runs.select(
        F.element_at(F.split("path", "/"), -1).alias("run"), "path", score.try_cast("double").alias("best_chrf"), config.alias("config"),
        F.when(F.col("score").isNull(), "no score file")
        .when(F.col("c").isNull(), "no configuration")
        .when(F.get_json_object("score", "$").isNull(), "broken score file")
        .when(score.try_cast("double").isNull(), "no score")
        .when(config.isNull() | (F.size(config) == 0), "broken configuration").alias("problem"),
    )
    bad = judged.where(F.col("problem").isNotNull()).select("run", "problem")
    return judged.where(F.col("problem").isNull()).drop("problem"), bad
