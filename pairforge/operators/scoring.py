"""Corpus scores of hypotheses against references.

Input ``predictions``: at least ``hyp`` and ``ref`` strings, plus any slice columns.
Per-pair counts are computed in the row, then summed: the only shuffle is that of the
partial sums, for the whole corpus or per slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import overlap as O
from ..functions import sequences as S
from ..functions import text as T

EPSILON = 1e-8


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, 0 where nothing was counted."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def f_measure(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def f_half(p: Column, r: Column) -> Column:
    """F with beta 0.5 and the small constant that guards an all-zero score."""
    return 1.25 * p * r / (0.25 * p + r + EPSILON)


def _counts(name: str, order: int) -> list[Column]:
    """Sums of the flat [match, hyp, ref] array ``name``, one column each."""
    return [
        _sum(F.col(name)[3 * n + k]).alias(f"{name}_{part}{n + 1}")
        for n in range(order)
        for k, part in enumerate(("m", "h", "r"))
    ]


# --- per-pair counts -------------------------------------------------------------------


def _with_counts(pred: DataFrame, name: str, part: str | None = None) -> DataFrame:
    """Adds the counts ``name`` of both texts, all from one pass over them; those of equal ones follow from the length."""
    return pred.withColumn(name, O.counts_of(F.col("hyp"), F.col("ref"), [part or name], (LONG_CHARS, LONG_WORDS)))


def with_bleu_counts(pred: DataFrame) -> DataFrame:
    return _with_counts(pred, "bleu")


def with_chrf_counts(pred: DataFrame) -> DataFrame:
    return _with_counts(pred, "chrf")


def with_word_counts(pred: DataFrame) -> DataFrame:
    """Whitespace-word n-grams (sentence GLEU)."""
    return _with_counts(pred, "gram")


def with_rouge_counts(pred: DataFrame, stemmed: bool = True) -> DataFrame:
    return _with_counts(pred, "rouge", "rouge" if stemmed else "rouge_plain")


# --- corpus formulas over summed counts ------------------------------------------------


def bleu_score(m: list[Column], h: list[Column], ref_len: Column) -> Column:
    """Corpus BLEU, 0-100: clipped precisions, exponential smoothing, brevity penalty."""
    zeros = F.lit(0)
    logs = []
    for match, total in zip(m, h):
        zeros = zeros + F.when(match == 0, 1).otherwise(0)
        smoothed = F.when(match > 0, match / total).otherwise(1 / (F.pow(F.lit(2.0), zeros) * total))
        logs.append(F.log(F.when(total > 0, smoothed)))
    mean = reduce(lambda a, b: a + b, logs) / len(logs)
    brevity = F.when(h[0] < ref_len, F.exp(1 - ref_len / F.when(h[0] > 0, h[0]))).otherwise(1.0)
    any_match = reduce(lambda a, b: a | b, [c > 0 for c in m])
    return F.coalesce(F.when(any_match, 100 * brevity * F.exp(mean)), F.lit(0.0))


def chrf_score(m: list[Column], h: list[Column], r: list[Column], beta: float = 2.0) -> Column:
    """Corpus chrF, 0-100: mean precision and recall over the orders both sides have."""
    usable = [F.when((hyp > 0) & (ref > 0), 1).otherwise(0) for hyp, ref in zip(h, r)]
    orders = reduce(lambda a, b: a + b, usable)
    mean = lambda parts: reduce(lambda a, b: a + b, parts) / F.when(orders > 0, orders)
    p = mean([F.when(u == 1, x / y).otherwise(0.0) for u, x, y in zip(usable, m, h)])
    q = mean([F.when(u == 1, x / y).otherwise(0.0) for u, x, y in zip(usable, m, r)])
    b2 = beta * beta
    return F.coalesce(F.when(p + q > 0, 100 * (1 + b2) * p * q / (b2 * p + q)), F.lit(0.0))


def corpus_bleu(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    summed = with_bleu_counts(pred).groupBy(*by).agg(*_counts("bleu", O.WORD_ORDER))
    col = lambda part: [F.col(f"bleu_{part}{n}") for n in range(1, O.WORD_ORDER + 1)]
    return summed.select(*by, bleu_score(col("m"), col("h"), F.col("bleu_r1")).alias("bleu"))


def corpus_chrf(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    counted = with_chrf_counts(pred)
    # hypothesis grams of an order count only where the reference has some
    fields = [c for n in range(O.CHAR_ORDER) for c in (
        F.col("chrf")[3 * n],
        F.when(F.col("chrf")[3 * n + 2] > 0, F.col("chrf")[3 * n + 1]).otherwise(0),
        F.col("chrf")[3 * n + 2],
    )]
    summed = counted.withColumn("chrf", F.array(*fields)).groupBy(*by).agg(*_counts("chrf", O.CHAR_ORDER))
    col = lambda part: [F.col(f"chrf_{part}{n}") for n in range(1, O.CHAR_ORDER + 1)]
    return summed.select(*by, chrf_score(col("m"), col("h"), col("r")).alias("chrf"))


def _rouge(rows: DataFrame) -> DataFrame:
    """``rouge1, rouge2, rougeL`` in place of the counts ``rouge``."""
    c = F.col("rouge")

    def f(match: Column, hyp: Column, ref: Column) -> Column:
        return f_measure(match / F.greatest(hyp, F.lit(1)), match / F.greatest(ref, F.lit(1)))

    return rows.withColumns({"rouge1": f(c[0], c[1], c[2]), "rouge2": f(c[3], c[4], c[5]), "rougeL": f(c[6], c[1], c[2])}).drop("rouge")


def sentence_rouge(pred: DataFrame, stemmed: bool = True) -> DataFrame:
    """Per pair ``rouge1, rouge2, rougeL`` F-measures."""
    return _rouge(with_rouge_counts(pred, stemmed))


def corpus_rouge(pred: DataFrame, by: list[str] = (), stemmed: bool = True) -> DataFrame:
    return sentence_rouge(pred, stemmed).groupBy(*by).agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("rouge1", "rouge2", "rougeL")]
    )


def _gleu(rows: DataFrame) -> DataFrame:
    """``gleu`` in place of the counts ``gram``."""
    c = F.col("gram")
    total = lambda k: reduce(lambda a, b: a + b, [c[3 * n + k] for n in range(O.WORD_ORDER)])
    return rows.withColumn("gleu", ratio(total(0), F.greatest(total(1), total(2)))).drop("gram")


def sentence_gleu(pred: DataFrame) -> DataFrame:
    """Per pair ``gleu``: matches of n = 1..4 over the larger side's gram count."""
    return _gleu(with_word_counts(pred))


def corpus_gleu(pred: DataFrame, by: list[str] = (), last_batch_only: bool = False) -> DataFrame:
    """Mean sentence GLEU. ``last_batch_only`` keeps the rows of the largest ``batch_id``."""
    if last_batch_only:
        pred = pred.where(F.col("batch_id") == pred.agg(F.max("batch_id")).scalar())
    return sentence_gleu(pred).groupBy(*by).agg(F.coalesce(F.avg("gleu"), F.lit(0.0)).alias("gleu"))


# --- error rates -----------------------------------------------------------------------


# longer pairs are compared one at a time
LONG_CHARS, LONG_WORDS = O.LONG_CHARS, O.LONG_WORDS


def _known() -> Column:
    return F.col("hyp").isNotNull() & F.col("ref").isNotNull()


def _edits(rows: DataFrame) -> DataFrame:
    """``char_edits, ref_chars, word_edits, ref_words`` in place of the counts ``edits``; no edits where a text is null."""
    c, known = F.col("edits"), _known()
    return rows.withColumns(
        {
            "char_edits": F.when(known, c[0]),
            "ref_chars": F.when(known, c[1]).otherwise(F.char_length(F.trim("ref"))),
            "word_edits": F.when(known, c[2]),
            "ref_words": F.when(known, c[3]).otherwise(F.size(T.split_words(F.col("ref")))),
        }
    ).drop("edits")


def with_edit_counts(pred: DataFrame) -> DataFrame:
    """``char_edits, ref_chars, word_edits, ref_words``; equal pairs skip the distance.

    Distances are bit-vector steps on many pairs at a time, so neither a long sentence nor
    many short ones cost a cell for every two characters.
    """
    return _edits(_with_counts(pred, "edits"))


def error_rates(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    """``cer, wer, ser``: edits over reference length, and the share of unequal pairs."""
    return with_edit_counts(pred).groupBy(*by).agg(
        ratio(_sum(F.col("char_edits")), _sum(F.col("ref_chars"))).alias("cer"),
        ratio(_sum(F.col("word_edits")), _sum(F.col("ref_words"))).alias("wer"),
        F.coalesce(F.avg((F.col("hyp") != F.col("ref")).cast("int")), F.lit(0.0)).alias("ser"),
    )


# --- token agreement -------------------------------------------------------------------


def _with_words(pred: DataFrame) -> DataFrame:
    """Adds the words ``_h`` and ``_r`` of both sides; equal sides are cut once."""
    rows = pred.withColumn("_h", T.split_words(F.col("hyp")))
    return rows.withColumn("_r", F.when(F.col("hyp") == F.col("ref"), F.col("_h")).otherwise(T.split_words(F.col("ref"))))


def _block_matches(ref: Column, hyp: Column) -> Column:
    """:func:`O.block_matches`; only arrays that differ go to the helper, equal ones match whole."""
    equal = ref.eqNullSafe(hyp)
    return F.when(equal, F.size(ref)).otherwise(O.block_matches(F.when(~equal, ref), F.when(~equal, hyp)))


def prefix_agreement(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    """``precision = recall = f1`` (micro average over aligned prefixes) and ``f05``."""
    hyp, ref = F.col("_h"), F.col("_r")
    acc = ratio(_sum(S.positional_hits(hyp, ref)), _sum(S.common_length(hyp, ref)))
    summed = _with_words(pred).groupBy(*by).agg(acc.alias("precision"))
    p = F.col("precision")
    return summed.select(*by, p, p.alias("recall"), p.alias("f1"), f_half(p, p).alias("f05"))


def token_accuracy(pred: DataFrame, by: list[str] = (), count_start: bool = False) -> DataFrame:
    """Share of equal ids at equal positions of ``hyp_ids`` and ``ref_ids``.

    Both sequences begin with the start marker; ``count_start`` counts it as a hit.
    """
    skip = 0 if count_start else 1
    tail = lambda c: F.slice(F.col(c), skip + 1, F.greatest(F.size(c) - skip, F.lit(0)))
    hyp, ref = tail("hyp_ids"), tail("ref_ids")
    return pred.groupBy(*by).agg(
        ratio(_sum(S.positional_hits(hyp, ref)), _sum(S.common_length(hyp, ref))).alias("token_accuracy")
    )


def block_agreement(pred: DataFrame, by: list[str] = (), last_batch_only: bool = False) -> DataFrame:
    """Precision, recall, F1 and F0.5 from longest-block alignments of the word sequences."""
    if last_batch_only:
        pred = pred.where(F.col("batch_id") == pred.agg(F.max("batch_id")).scalar())
    summed = _with_words(pred).groupBy(*by).agg(
        _sum(_block_matches(F.col("_r"), F.col("_h"))).alias("m"),
        _sum(F.size("_h")).alias("h"),
        _sum(F.size("_r")).alias("r"),
    )
    p, r = ratio(F.col("m"), F.col("h")), ratio(F.col("m"), F.col("r"))
    some = p + r > 0
    return summed.select(
        *by,
        p.alias("precision"),
        r.alias("recall"),
        F.when(some, 2 * p * r / (p + r + EPSILON)).otherwise(0.0).alias("f1"),
        F.when(some, f_half(p, r)).otherwise(0.0).alias("f05"),
    )


def block_accuracy(pred: DataFrame, by: list[str] = (), double_count: bool = False) -> DataFrame:
    """Block-aligned id matches over reference length.

    ``double_count`` adds the positional hits and lengths once more, as some published
    scores of this kind did.
    """
    hyp, ref = F.col("hyp_ids"), F.col("ref_ids")
    num, den = _block_matches(ref, hyp), F.size(ref)
    if double_count:
        num, den = num + S.positional_hits(hyp, ref), den + S.common_length(hyp, ref)
    return pred.groupBy(*by).agg(ratio(_sum(num), _sum(den)).alias("token_accuracy"))


# --- likelihood ------------------------------------------------------------------------


def with_nll(scores: DataFrame, pad: int) -> DataFrame:
    """``nll`` per position from ``logits`` and ``target``; null on padding."""
    return scores.withColumn(
        "nll", F.when(F.col("target") != pad, S.token_nll(F.col("logits"), F.col("target")))
    )


def perplexity(scores: DataFrame, pad: int, by: list[str] = ()) -> DataFrame:
    """``nll_sum, n_tokens, mean_nll, perplexity``; infinite when no token counts."""
    return with_nll(scores, pad).groupBy(*by).agg(
        F.coalesce(F.sum("nll"), F.lit(0.0)).alias("nll_sum"),
        F.count("nll").alias("n_tokens"),
        F.avg("nll").alias("mean_nll"),
        F.coalesce(F.exp(F.avg("nll")), F.lit(float("inf"))).alias("perplexity"),
    )


# --- the full record -------------------------------------------------------------------


def _fold(pred: DataFrame, by: list[str], parts: list[DataFrame]) -> DataFrame:
    keyed = by or ["_one"]
    frames = parts if by else [p.withColumn("_one", F.lit(1)) for p in parts]
    joined = reduce(lambda a, b: a.join(b, keyed), frames)
    return joined if by else joined.drop("_one")


def _text_counts(pred: DataFrame, aligned: str) -> DataFrame:
    """Every count of every pair, that all text scores are made of: each text goes to the helper once."""
    parts = ["bleu", "chrf", "gram", "rouge", "edits", *([] if aligned == "blocks" else ["agree"])]
    sizes = [O.PARTS[p][2] for p in parts]
    counted = pred.withColumn("_counts", O.counts_of(F.col("hyp"), F.col("ref"), parts, (LONG_CHARS, LONG_WORDS)))
    counted = counted.withColumns({p: F.slice("_counts", 1 + sum(sizes[:k]), sizes[k]) for k, p in enumerate(parts)}).drop("_counts")
    counted = _edits(_rouge(_gleu(counted)))
    if aligned == "blocks":
        counted = _with_words(counted).withColumnsRenamed({"_h": "_words_h", "_r": "_words_r"})
        hyp, ref = F.col("_words_h"), F.col("_words_r")
        agree = [_block_matches(ref, hyp), F.size(hyp), F.size(ref)]
    else:
        hits, common = (F.when(_known(), F.col("agree")[k]) for k in (0, 1))
        agree = [hits, common, common]
    counted = counted.withColumn("agree", F.array(*agree)).withColumn(
        "chrf",
        F.array(*[
            c for n in range(O.CHAR_ORDER) for c in (
                F.col("chrf")[3 * n],
                F.when(F.col("chrf")[3 * n + 2] > 0, F.col("chrf")[3 * n + 1]).otherwise(0),
                F.col("chrf")[3 * n + 2],
            )
        ]),
    )
    return counted.drop("_words_h", "_words_r")


def _text_sums() -> list[Column]:
    """Mergeable sums of what :func:`_text_counts` has of every pair."""
    differ = (F.col("hyp") != F.col("ref")).cast("int")
    named = {c: F.col(c) for c in ("rouge1", "rouge2", "rougeL", "gleu", "char_edits", "ref_chars", "word_edits", "ref_words")}
    return [
        *_counts("bleu", O.WORD_ORDER), *_counts("chrf", O.CHAR_ORDER), *_counts("agree", 1),
        *[_sum(c).alias(f"sum_{n}") for n, c in {**named, "differ": differ}.items()], F.count("*").alias("n_pairs"),
    ]


def _text_scores(summed: DataFrame, by: list[str], aligned: str, *more: str) -> DataFrame:
    """The scores of summed counts, one row for each row of sums."""
    mean = lambda c: ratio(F.col(f"sum_{c}"), F.col("n_pairs"))
    b = lambda part: [F.col(f"bleu_{part}{n}") for n in range(1, O.WORD_ORDER + 1)]
    c = lambda part: [F.col(f"chrf_{part}{n}") for n in range(1, O.CHAR_ORDER + 1)]
    p, r = ratio(F.col("agree_m1"), F.col("agree_h1")), ratio(F.col("agree_m1"), F.col("agree_r1"))
    guard = EPSILON if aligned == "blocks" else 0.0
    return summed.select(
        *by,
        *more,
        bleu_score(b("m"), b("h"), F.col("bleu_r1")).alias("bleu"),
        chrf_score(c("m"), c("h"), c("r")).alias("chrf"),
        *[mean(n).alias(n) for n in ("rouge1", "rouge2", "rougeL")],
        p.alias("precision"),
        r.alias("recall"),
        F.when(p + r > 0, 2 * p * r / (p + r + guard)).otherwise(0.0).alias("f1"),
        F.when(p + r > 0, f_half(p, r)).otherwise(0.0).alias("f05"),
        ratio(F.col("sum_char_edits"), F.col("sum_ref_chars")).alias("cer"),
        ratio(F.col("sum_word_edits"), F.col("sum_ref_words")).alias("wer"),
        mean("differ").alias("ser"),
        mean("gleu").alias("gleu"),
    )


def text_report(pred: DataFrame, by: list[str] = (), aligned: str = "prefix") -> DataFrame:
    """All text scores, one row per slice: a single pass sums every count.

    ``aligned`` picks the precision family: ``prefix`` for word mode, ``blocks`` for
    subword mode.
    """
    by = list(by)
    return _text_scores(_text_counts(pred, aligned).groupBy(*by).agg(*_text_sums()), by, aligned)


def full_report(pred: DataFrame, scores: DataFrame, pad: int, by: list[str] = (), aligned: str = "prefix") -> DataFrame:
    """The fifteen named values: text scores, token accuracy and perplexity."""
    by = list(by)
    accuracy = block_accuracy(pred, by) if aligned == "blocks" else token_accuracy(pred, by)
    likelihood = perplexity(scores, pad, by).select(*by, "perplexity")
    return _fold(pred, by, [text_report(pred, by, aligned), accuracy, likelihood])


def slice_report(pred: DataFrame, dims: list[str]) -> DataFrame:
    """Pair counts and sentence error rate over every combination of ``dims`` (cube)."""
    differ = pred.select(*dims, (F.col("hyp") != F.col("ref")).cast("int").alias("_differ"))
    finest = differ.groupBy(*dims).agg(
        F.count("*").alias("_n"), F.sum("_differ").alias("_d"), F.count("_differ").alias("_known")
    )
    # every combination adds up the slices' counts: no row is copied
    return finest.cube(*dims).agg(
        F.sum("_n").alias("n_pairs"),
        (F.sum("_d") / F.sum("_known")).alias("ser"),
        F.grouping_id().cast("int").alias("level"),
    )


def slice_scores(
    pred: DataFrame, dims: list[str], aligned: str = "prefix", scores: DataFrame | None = None, pad: int = 0
) -> DataFrame:
    """All scores over every combination of ``dims``: the columns of :func:`full_report`, ``n_pairs`` and ``level``.

    Every pair is counted once, for its finest slice; the cube only adds up the slices'
    counts. ``token_accuracy`` needs the columns ``hyp_ids`` and ``ref_ids``, ``perplexity``
    token scores that carry ``dims``; what is not given is left out.
    """
    sums, more = _text_sums(), []
    counted = _text_counts(pred, aligned)
    if {"hyp_ids", "ref_ids"} <= set(pred.columns):
        if aligned == "blocks":
            hits = [_block_matches(F.col("ref_ids"), F.col("hyp_ids")), F.size("ref_ids")]
        else:
            tail = lambda c: F.slice(F.col(c), 2, F.greatest(F.size(c) - 1, F.lit(0)))
            hits = [f(tail("hyp_ids"), tail("ref_ids")) for f in (S.positional_hits, S.common_length)]
        counted = counted.withColumns({"id_hits": hits[0], "id_total": hits[1]})
        sums += [_sum(F.col(c)).alias(c) for c in ("id_hits", "id_total")]
        more.append("token_accuracy")
    finest = counted.groupBy(*dims).agg(*sums)
    if scores is not None:
        nll = with_nll(scores, pad).groupBy(*dims).agg(F.sum("nll").alias("nll_sum"), F.count("nll").alias("n_tokens"))
        same = reduce(lambda x, y: x & y, [finest[d].eqNullSafe(nll[d]) for d in dims])
        finest = finest.join(nll, same, "left").drop(*[nll[d] for d in dims])
        more.append("perplexity")
    names = [c for c in finest.columns if c not in dims]
    cube = finest.cube(*dims).agg(*[_sum(F.col(c)).alias(c) for c in names], F.grouping_id().cast("int").alias("level"))
    if "token_accuracy" in more:
        cube = cube.withColumn("token_accuracy", ratio(F.col("id_hits"), F.col("id_total")))
    if "perplexity" in more:
        cube = cube.withColumn("perplexity", F.when(F.col("n_tokens") > 0, F.exp(F.col("nll_sum") / F.col("n_tokens"))).otherwise(float("inf")))
    return _text_scores(cube, dims, aligned, "level", "n_pairs", *more)
