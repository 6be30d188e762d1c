"""Training-log sources and the log format itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_CHUNK = 65_536


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, chunk, line_no, value`` of plain log files, one file per run.

    The order of lines is (block start in the file, row number in the task), so one large
    file is still read by many tasks. ``chunk`` is the block, which running values use.
    """
    rows = spark.read.text(path).select(
        "value",
        F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("run_id"),
        F.col("_metadata.file_block_start").alias("chunk"),
    )
    return rows.withColumn("line_no", F.monotonically_increasing_id())


def tagged(run: Column, line_no: Column, value: Column) -> Column:
    """A shipped log line: run, line number and text between tabs."""
    return F.concat_ws("\t", run.cast("string"), line_no.cast("string"), value)


def parse_tagged(rows: DataFrame) -> DataFrame:
    """``run_id, chunk, line_no, value`` of shipped lines, in any number of files.

    Lines that are not tagged (no number of run or line, no text) are left out.
    """
    parts = F.split("value", "\t", 3)
    found = rows.select(
        F.get(parts, 0).try_cast("bigint").alias("run_id"),
        F.get(parts, 1).try_cast("bigint").alias("line_no"),
        F.get(parts, 2).alias("value"),
    )
    return found.dropna().withColumn("chunk", F.floor(F.col("line_no") / LINES_PER_CHUNK))


def epoch_line(epoch: Column, loss: Column, accuracy: Column) -> Column:
    return F.concat(
        F.lit("Epoch "), epoch.cast("string"), F.lit(" finished, average loss: "), loss.cast("string"),
        F.lit(", Accuracy: "), accuracy.cast("string"), F.lit("%"),
    )


def validation_line(values: dict[str, Column]) -> Column:
    """The console line of a validation; values come formatted as strings."""
    first, *rest = values.items()
    parts = [F.lit(f"Validation — {first[0]}: "), first[1]]
    for name, value in rest:
        parts += [F.lit(f", {name}: "), value]
    return F.concat(*parts)
