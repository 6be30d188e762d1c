"""Operator 7: mixing sources to target weights, cut at each source's exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.indexing import dense_index
from ..session import stored
from .common import WORD_SQL, fresh, only, word_count

#: Ranges of the hash key in which prefix sums are taken side by side: 4,096 for each source.
RANGES_HEX = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """``source, weight, target`` from ``source, source_size``.

    Sources in code-point order, null last, take the weights in turn. A target over
    ``epochs`` times its source's size stops there, and what is over goes to the others by
    weight, again until none is above: as many aggregate jobs as such rounds, each giving
    the driver two numbers. Sources are ranked by range partitions, not in one task.
    """
    order = [F.col("source").isNull().alias("unnamed"), F.coalesce("source", F.lit("")).alias("name")]
    ranked = dense_index(sizes.select(*order, "source", "source_size"), ["unnamed", "name"], "place")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stored(
        ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(epochs)).alias("most")),
        "weights",
    )
    total = rows.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, free = 0.0, F.lit(True)
    while True:
        left = rows.agg(
            F.sum(F.when(~free, F.col("most"))).alias("stopped"), F.sum(F.when(free, F.col("weight"))).alias("weight")
        ).first()
        if not left["weight"]:
            break
        new = max(0.0, share * total - (left["stopped"] or 0.0)) / left["weight"]
        if new == level:
            break
        level = new
        free = F.col("weight") * F.lit(level) <= F.col("most")
    return rows.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("most")))


def hash_key(doc_id: Column) -> Column:
    """The random key of a document: it depends on the id alone, so reruns agree."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")))


def cut_points(rows: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """One row per source: size, target, whole epochs, and the document where the budget of the last epoch is met.

    ``rows`` has ``doc_id, source, size, key``. Within a source, rows sort by key, size and
    id. Prefix sums go in two steps: totals of equal ranges of the key (combined before the
    shuffle) find the range that holds the cut, and only that range, about one row in
    4,096, is sorted and summed row by row. So no source, however large, is one task.
    """
    row_range = F.substring("key", 1, RANGES_HEX)
    ranges = rows.groupBy("source", row_range.alias("range")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = stored(ranges.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))), "ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    full = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("full", full.cast("bigint"))
    targets = stored(targets.withColumn("rest", (F.round("target") - F.col("full") * F.col("source_size")).cast("bigint")), "targets")
    named = targets.select(F.col("source").alias("s"), "rest")
    held = ranges.join(named, F.col("source").eqNullSafe(F.col("s"))).where(
        (F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("words"))
    )
    held = held.select("s", F.col("range").alias("r"), "start", "rest")
    inside = rows.join(held, F.col("source").eqNullSafe(F.col("s")) & (row_range == F.col("r"))).groupBy(
        "source", "key", "size", "doc_id"
    )
    order = Window.partitionBy("source").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.agg(F.count("*").alias("rows"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    words = F.col("rows") * F.col("size")
    first = F.col("start") + F.coalesce(F.sum(words).over(order), F.lit(0))
    cut = (
        inside.withColumn("first", first)
        .where((F.col("first") <= F.col("rest")) & (F.col("rest") < F.col("first") + words))
        .select(
            F.col("source").alias("s"),
            F.struct("key", "size", "doc_id").alias("cut"),
            F.floor((F.col("rest") - F.col("first")) / F.col("rows")).cast("bigint").alias("cut_words"),
        )
    )
    joined = targets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    return stored(joined.select(F.col("source").alias("cut_source"), "source_size", "target", "full", "cut", "cut_words"), "cuts")


def taken_words(key: Column, size: Column, doc_id: Column) -> Column:
    """Words that the mix takes of a row, repeats counted, given its source's cut."""
    here = F.struct(key.alias("key"), size.alias("size"), doc_id.alias("doc_id"))
    last = F.when(here < F.col("cut"), size).when(here == F.col("cut"), F.col("cut_words")).otherwise(0)
    return (F.col("full") * size + last).cast("bigint")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    epochs: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every document.

    Every document gets a hash-random key; documents sorted by it within their source are
    taken for whole epochs, and for one epoch more up to the point where the source's
    budget is met; the document at that point gives just the words missing.

    One row per input row: repeated rows count as often as they come, and if the cut falls
    on them, share its words evenly (whole words, so up to one a row may be missing). Rows
    that tie in key go by size. A null or empty text has size 0 and takes 0, a null source
    is a source of its own, extra columns are dropped, an empty table gives an empty table.
    """
    rows = only(docs, doc_id=(id_col, "bigint"), source=(source_col, "string"), text=(text_col, "string")).select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), hash_key(F.col("doc_id")).alias("key")
    )
    rows = stored(rows, "sizes")
    cuts = cut_points(rows, weights, share, epochs)
    joined = rows.join(cuts, rows["source"].eqNullSafe(cuts["cut_source"]), "left")
    taken = taken_words(F.col("key"), F.col("size"), F.col("doc_id"))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def take(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    epochs: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    length_col: str | None = None,
) -> DataFrame:
    """The mixed rows with the columns of ``docs``: a document once for each epoch that takes it.

    A document of which the mix takes only some words in its last copy has those words,
    joined by spaces, as the text of that copy (at most one document of a source, or its
    repeats); ``length_col``, if given, then follows the text. Documents without words are
    left out. Texts meet only the cut of their source, one row a source, so they are not
    shuffled while those rows are few.
    """
    size, key, copy = (fresh(docs, n) for n in ("mix_size", "mix_key", "mix_copy"))
    text, doc_id, source = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{source_col}`").cast("string")
    rows = only(docs, doc_id=(id_col, "bigint"), source=(source_col, "string"), text=(text_col, "string")).select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), hash_key(F.col("doc_id")).alias("key")
    )
    cuts = cut_points(stored(rows, "sizes"), weights, share, epochs)
    cuts = cuts.select(*(F.col(c).alias(fresh(docs, f"mix_{c}")) for c in cuts.columns))
    names = dict(zip(("cut_source", "source_size", "target", "full", "cut", "cut_words"), cuts.columns))
    sized = docs.withColumns({size: word_count(text), key: hash_key(doc_id)}).where(F.col(size) > 0)
    joined = sized.join(cuts, source.eqNullSafe(F.col(names["cut_source"])))
    here = F.struct(F.col(key).alias("key"), F.col(size).alias("size"), doc_id.alias("doc_id"))
    last = F.when(here < F.col(names["cut"]), F.col(size)).when(here == F.col(names["cut"]), F.col(names["cut_words"])).otherwise(0)
    copies = F.col(names["full"]) + (last > 0).cast("bigint")
    lengths = F.when(copies > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), copies), lambda k: F.when(k > F.col(names["full"]), last).otherwise(F.col(size))))
    rows = joined.withColumn(copy, F.explode(lengths))
    short = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD_SQL), F.lit(0)), 1, F.col(copy).cast("int")), " ")
    out = rows.withColumn(text_col, F.when(F.col(copy) < F.col(size), short).otherwise(text))
    if length_col is not None:
        out = out.withColumn(length_col, F.length(F.col(f"`{text_col}`")).cast(docs.schema[length_col].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
