"""Typo variants of sentences and the deduplicated corrupted -> original pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.noise import corrupt_forms
from ..functions.rng import SEED, key_of
from ..functions.text import words_of

# The shipped corpus parameters.
TIMES = 4
PROBABILITY = 0.1470863195582148
ON_THE_FLY = 0.02


def noisy_forms(rows: DataFrame, times: int = TIMES, p: float = PROBABILITY, seed: int = SEED) -> DataFrame:
    """``doc_id, sent_pos, target, sources``: the ``times`` noisy forms of a sentence in one row.

    A form that is the sentence itself, most are, is null, so the sentence is held once.
    """
    keys = [key_of(seed, F.col("doc_id"), F.col("sent_pos"), v) for v in range(1, times + 1)]
    forms = corrupt_forms(F.col("sentence"), keys, p)
    return rows.select("doc_id", "sent_pos", F.col("sentence").alias("target"), forms.alias("sources"))


def variants(rows: DataFrame, times: int = TIMES, p: float = PROBABILITY, seed: int = SEED) -> DataFrame:
    """``doc_id, sent_pos, variant, source, target``: ``times`` noisy forms per sentence."""
    # outer, as from an inner one Spark infers a filter by size, for which the noise is made a second time
    forms = noisy_forms(rows, times, p, seed).select("doc_id", "sent_pos", "target", F.posexplode_outer("sources").alias("v", "s"))
    return forms.where("v is not null").select(
        "doc_id", "sent_pos", (F.col("v") + 1).alias("variant"), F.coalesce("s", "target").alias("source"), "target"
    )


def _last_and_first(entries: DataFrame) -> DataFrame:
    """One row per source of ``source, target, first, last``: places of a variant, ``target`` null where it is the source.

    ``groupBy`` combines map-side, so a source that fills a third of the rows reaches
    the shuffle once per task.
    """
    return (
        entries.groupBy("source")
        .agg(F.max_by("target", "last").alias("target"), F.min("first").alias("first"))
        .select(
            "source",
            F.coalesce("target", "source").alias("target"),
            F.col("first.doc_id").alias("doc_id"),
            F.col("first.sent_pos").alias("sent_pos"),
            F.col("first.variant").alias("variant"),
            F.col("target").isNull().alias("is_identity"),
        )
    )


def unique_pairs(rows: DataFrame) -> DataFrame:
    """One row per source: the target of its last variant, the place of its first."""
    place = F.struct("doc_id", "sent_pos", "variant")
    target = F.when(F.col("source") != F.col("target"), F.col("target"))
    return _last_and_first(rows.select("source", target.alias("target"), place.alias("first"), place.alias("last")))


def unique_forms(forms: DataFrame) -> DataFrame:
    """:func:`unique_pairs` of noisy forms: the forms left alone reach the shuffle as one row with their first and last place."""
    place = lambda v: F.struct("doc_id", "sent_pos", v.cast("int").alias("variant"))
    entry = lambda s, t, a, b: F.struct(s.alias("source"), t.alias("target"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    numbered = F.transform("sources", lambda s, i: F.struct(s.alias("s"), (i + 1).alias("v")))
    alone = F.transform(F.filter(numbered, lambda x: x["s"].isNull()), lambda x: x["v"])
    changed = F.filter(numbered, lambda x: x["s"].isNotNull())
    none = F.lit(None).cast("string")
    same = F.filter(F.array(entry(F.col("target"), none, F.array_min(alone), F.array_max(alone))), lambda e: e["a"].isNotNull())
    others = F.transform(changed, lambda x: entry(x["s"], F.col("target"), x["v"], x["v"]))
    rows = forms.select("doc_id", "sent_pos", F.explode(F.concat(same, others)).alias("e"))
    return _last_and_first(
        rows.select("e.source", "e.target", place(F.col("e.a")).alias("first"), place(F.col("e.b")).alias("last"))
    )


def change_profile(rows: DataFrame) -> DataFrame:
    """Per effect: how many variants and words were left alone, shortened, kept or grown."""
    source, target = F.col("source"), F.col("target")
    entry = lambda s, t, n: F.struct(s.alias("s"), t.alias("t"), n.cast("int").alias("n"))
    # the words of a variant that was left alone are counted without being taken apart
    alone = F.filter(F.array(entry(F.lit(""), F.lit(""), F.size(words_of(target)))), lambda e: e["n"] > 0)
    each = F.zip_with(words_of(source), words_of(target), lambda s, t: entry(s, t, F.lit(1)))
    words = rows.select(F.explode(F.when(source == target, alone).otherwise(each)).alias("w"))
    delta = F.char_length("w.s") - F.char_length("w.t")
    effect = (
        F.when(F.col("w.s") == F.col("w.t"), "unchanged")
        .when(delta < 0, "shorter")
        .when(delta > 0, "longer")
        .otherwise("same_length")
    )
    return words.groupBy(effect.alias("effect")).agg(
        F.sum("w.n").alias("n_words"), F.sum(delta.cast("bigint")).alias("char_delta")
    )
