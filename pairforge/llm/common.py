"""What the operators share: words, Arrow helpers, input projection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Words are maximal runs of anything but the ASCII white space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; also makes this package importable in the Python workers."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """Project to ``alias=(column, type)``: extra columns, whatever their names, go before any work."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(a) for a, (c, t) in columns.items()))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of at most ``rows``, so that long texts are turned into Python objects in small lots."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def word_count(text: Column) -> Column:
    """Number of words of a text, null as 0, without building the words."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_SQL, "x")
    return F.length(F.regexp_replace(spaced, r"[\x20\x09-\x0D]+", "")).cast("bigint")


#: Bits of the filter that :func:`sieve` broadcasts: 2 MB in 2**18 rows, whatever the input.
SIEVE_BITS = 24


def sieve(rows: DataFrame, address: str, wanted: DataFrame, wanted_address: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have an address of ``wanted``, and those that surely have none.

    A Bloom filter of one hash and fixed size goes to the rows, so that texts that no join
    needs are not shuffled. It never loses a row; when very many addresses are wanted it
    lets more rows pass, and the join behind it does all the work.
    """
    slot = F.pmod(F.col(wanted_address), F.lit(1 << SIEVE_BITS))
    bits = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("sieve_word"))
    bits = bits.agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63L as int)))").alias("sieve_bits"))
    own = f"pmod(`{address}`, {1 << SIEVE_BITS}L)"
    met = rows.join(F.broadcast(bits), F.expr(f"shiftright({own}, 6) = sieve_word"), "left")
    hit = F.coalesce(F.expr(f"(shiftright(sieve_bits, cast({own} & 63L as int)) & 1L) = 1L"), F.lit(False))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return met.where(hit).select(*columns), met.where(~hit).select(*columns)
