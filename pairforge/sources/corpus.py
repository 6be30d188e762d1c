"""Corpus sources: page dumps and UTF-16 text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import article_body, clean_markup, is_redirect
from ..operators.scans import running

PAGE_END = "</page>"


def read_dump(spark: SparkSession, path: str, unescape: bool = False) -> DataFrame:
    """``doc_id, raw``: article bodies of an XML dump; redirects left out.

    Bodies stay escaped as they are there, since the cleaning chain decodes them, unless
    ``unescape`` is set.

    The text source splits the file on the page end tag, so one dump file is read by many
    tasks and never as one value. ``doc_id`` is the page's own ``<id>``, null without one. A
    page is a redirect by its body alone: title and comment may mention the word.
    """
    records = spark.read.option("lineSep", PAGE_END).text(path)
    body = article_body(F.col("value"))
    return records.where(F.col("value").contains("<text ") & ~is_redirect(body)).select(
        F.regexp_extract("value", r"<id>(\d+)</id>", 1).try_cast("bigint").alias("doc_id"), (unescaped(body) if unescape else body).alias("raw")
    )


def escaped(text: Column) -> Column:
    """Signs of markup as references."""
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(reference))
    return text


def unescaped(text: Column) -> Column:
    """What :func:`escaped` was given."""
    for sign, reference in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(reference), F.lit(sign))
    return text


def clean_dump(articles: DataFrame, newline: str = "glue") -> DataFrame:
    """``doc_id, text``: cleaned articles that still have text.

    Empty results are dropped inside the generator: a ``where`` on the cleaned column would
    run the whole chain a second time as a pushed-down filter.
    """
    kept = F.filter(F.array(clean_markup(F.col("raw"), newline)), lambda t: t != "")
    return articles.select("doc_id", F.explode(kept).alias("text"))


def write_dump(articles: DataFrame, path: str) -> None:
    """Write ``doc_id, raw`` as page records of a dump, signs of markup escaped."""
    page = F.concat(
        F.lit("<page><id>"), F.col("doc_id").cast("string"),
        F.lit('</id><revision><text xml:space="preserve">'), escaped(F.col("raw")), F.lit("</text></revision>"),
    )
    articles.select(page.alias("value")).write.option("lineSep", PAGE_END).text(path)


def write_utf16(rows: DataFrame, path: str, sep: str = "\n", encoding: str = "UTF-16LE") -> None:
    """Write column ``text`` as UTF-16 files, each row followed by ``sep``; texts must not hold it."""
    coded = rows.select(F.encode("text", encoding).cast("string").alias("value"))
    coded.write.option("encoding", encoding).option("lineSep", sep).text(path)


def read_utf16(spark: SparkSession, path: str, sep: str = "\n", encoding: str = "UTF-16LE") -> DataFrame:
    """``path, chunk, line_no, text``: the pieces of UTF-16 files between separators, in file order by the three.

    The text source cuts a file into byte ranges at the separator's two bytes, so one file is
    read by many tasks. For whole corpora cut into sentences, ``sep`` may be a sentence
    delimiter: lines then do not matter. A byte-order mark at the start is dropped, and the
    carriage return of a line; ``encoding`` names the order of bytes.

    The two bytes may also straddle two characters. The pieces beside such a false cut have an
    odd number of bytes; if the corpus has any, pieces are put together again by the running
    number of odd ones before them.
    """
    raw = spark.read.option("encoding", encoding).option("lineSep", sep).text(path)
    rows = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("line_no"), F.col("value").cast("binary").alias("bytes"),
    )
    odd = F.length("bytes") % 2
    if not rows.where(odd == 1).limit(1).isEmpty():
        before = running(rows, ["path"], "chunk", ["line_no"], {"before": ("sum", odd, False)})
        whole = (F.col("before") % 2 == 0) & (odd == 0)
        cut = before.where(~whole).groupBy("path", F.floor(F.col("before") / 2).alias("pair")).agg(
            F.array_sort(F.collect_list(F.struct("chunk", "line_no", "bytes"))).alias("parts")
        )
        glue = F.encode(F.lit(sep), encoding)
        rest = F.slice("parts", F.lit(2), F.size("parts"))
        joined = F.aggregate(rest, F.col("parts")[0]["bytes"], lambda got, part: F.concat(got, glue, part["bytes"]))
        mended = cut.select("path", F.col("parts")[0]["chunk"].alias("chunk"), F.col("parts")[0]["line_no"].alias("line_no"), joined.alias("bytes"))
        rows = before.where(whole).select("path", "chunk", "line_no", "bytes").unionByName(mended)
    text = F.decode("bytes", encoding)
    text = F.when(F.col("chunk") == 0, F.regexp_replace(text, "^\uFEFF", "")).otherwise(text)
    return rows.select("path", "chunk", "line_no", (F.regexp_replace(text, "\r$", "") if sep == "\n" else text).alias("text"))
