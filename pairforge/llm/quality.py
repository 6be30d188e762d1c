"""Operator 9: quality rules per document, and verdicts per host from shrunken failure rates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.joins import fits
from ..session import stored
from .common import WORD, fresh, only, slices, texts

#: Counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Failed hosts, short strings, that are broadcast at most; beyond, they are joined by a shuffle.
MOST_SENT = 100_000


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found at least twice in the text."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered = bytearray(len(words))
    for i in compress(range(len(windows)), [seen[w] > 1 for w in windows]):
        covered[i] = covered[i + 1] = covered[i + 2] = 1
    return sum(covered)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line and WORD.search(line)]
    return len(lines) - len(set(lines))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def text_counts(text: str) -> tuple[int, ...]:
    """The rule inputs of one whole text, in the order of ``COUNTS``."""
    words = WORD.findall(text)
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        duplicate_lines(text),
        repeated_words(words),
        text.count("\n") + 1,
        sum(map(len, filter(str.isupper, words))),
    )


def with_counts(docs: DataFrame, text_col: str, names: dict[str, str]) -> DataFrame:
    """``docs`` with one column per rule input, in one pass over whole texts and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [text_counts(t) for t in texts(batch, text_col)]
            added = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names.values()])
        pa.default_memory_pool().release_unused()

    schema = StructType([*docs.schema.fields, *(StructField(names[c], LongType()) for c in COUNTS)])
    return docs.mapInArrow(run, schema)


def base_rule(names: dict[str, str]) -> Column:
    """Too few words, or over half of them in repeated windows."""
    words, repeats = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    return (words < 50) | (100 * repeats > 50 * words)


def rules_failed(
    names: dict[str, str], symbol_share: float = 0.1, dup_line_share: float = 0.3, upper_share: float = 0.5
) -> Column:
    """How many rules a document fails: the base rule and three shares."""
    c = {k: F.col(v) for k, v in names.items()}
    return (
        base_rule(names).cast("int")
        + (c["n_symbols"] > symbol_share * c["n_words"]).cast("int")
        + (c["n_dup_lines"] > dup_line_share * c["n_lines"]).cast("int")
        + (c["n_upper"] > upper_share * c["word_chars"]).cast("int")
    )


def host_rates(counted: DataFrame, host_col: str, names: dict[str, str]) -> tuple[DataFrame, Column]:
    """``host, host_rate`` of every named host, and the corpus mean that stands for a null host.

    Failures are summed by host, combined before the shuffle, so a host with a third of all
    rows costs no more than another. A beta prior fitted by moments to the hosts' rates
    shrinks them: ``(failed + a) / (n + a + b)``; a host of few documents is hence judged
    mostly by the corpus. The prior's weight a + b is kept between 1 and 1,000 documents.
    """
    hosts = counted.groupBy(F.col(f"`{host_col}`").alias("host")).agg(
        F.count("*").alias("n"), F.sum((rules_failed(names) > 0).cast("bigint")).alias("failed")
    )
    rate = F.col("failed") / F.col("n")
    m, v = F.col("m"), F.col("v")
    prior = (
        hosts.agg(
            F.sum("n").alias("docs"),
            F.count("*").alias("hosts"),
            F.coalesce(F.sum("failed") / F.sum("n"), F.lit(0.0)).alias("m"),
            F.coalesce(F.sum(F.col("n") * rate * rate) / F.sum("n"), F.lit(0.0)).alias("square"),
        )
        # variance between hosts beyond the binomial noise
        .select("m", (F.col("square") - m * m - m * (1 - m) * F.col("hosts") / F.col("docs")).alias("v"))
        .select("m", F.when(v > 0, F.greatest(F.least(m * (1 - m) / v - 1, F.lit(1e3)), F.lit(1.0))).otherwise(1e3).alias("w"))
    )
    mean, weight = prior.select("m").scalar(), prior.select("w").scalar()
    rates = hosts.where(F.col("host").isNotNull()).select(
        "host", ((F.col("failed") + mean * weight) / (F.col("n") + weight)).alias("host_rate")
    )
    return rates, mean


def quality_verdicts(
    docs: DataFrame,
    max_host_rate: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Counts and verdict of every document.

    ``base_failed`` is the base rule; ``kept`` needs that a document fails no rule and that
    its host's shrunken failure rate is at most ``max_host_rate``. One row per input row:
    repeated rows, repeated and null ids stay; null and empty texts have no words and fail;
    extra columns are dropped; an empty table gives an empty table. The counts (a few dozen
    bytes a row) are written once to the shared folder, so the texts are read once.
    """
    names = {c: c for c in COUNTS}
    rows = only(docs, doc_id=(id_col, "bigint"), host=(host_col, "string"), text=(text_col, "string"))
    counted = stored(with_counts(rows, "text", names).drop("text"), "quality")
    rates, mean = host_rates(counted, "host", names)
    return (
        counted.withColumns({"base_failed": base_rule(names), "rules_failed": rules_failed(names)})
        .join(rates, "host", "left")
        .withColumn("host_rate", F.coalesce("host_rate", mean))
        .withColumn("kept", (F.col("rules_failed") == 0) & (F.col("host_rate") <= max_host_rate))
    )


def drop_rejected(docs: DataFrame, max_host_rate: float = 0.5, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that :func:`quality_verdicts` keeps, with their own columns.

    The counts are taken twice, for the hosts and for the rows, so that no text is shuffled
    or written. Only the failed hosts, one short row each, are joined.
    """
    names = {c: fresh(docs, f"q_{c}") for c in COUNTS}
    counted = with_counts(docs, text_col, names)
    rates, mean = host_rates(counted.select(host_col, *names.values()), host_col, names)
    passed = counted.where(rules_failed(names) == 0).drop(*names.values())
    bad = rates.where(F.col("host_rate") > max_host_rate).select(F.col("host").alias(fresh(docs, "bad_host")))
    bad = stored(bad, "bad-hosts")
    # failed hosts are sent to the rows if few; counted first, since hosts grow with the corpus
    bad = F.broadcast(bad) if fits(bad, MOST_SENT) else bad
    kept = passed.join(bad, passed[host_col] == bad[bad.columns[0]], "left_anti")
    return kept.where(F.col(f"`{host_col}`").isNotNull() | (mean <= max_host_rate))
