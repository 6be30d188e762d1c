"""Array expressions over token id sequences and score vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rng import let


def cut_at(ids: Column, eos: int) -> Column:
    """The prefix before the first ``eos``; everything if there is none."""
    at = F.array_position(ids, eos).cast("int")
    return F.when(at > 0, F.slice(ids, 1, at - 1)).otherwise(ids)


def trim_ids(ids: Column, pad: int, sos: int, eos: int) -> Column:
    """Cut at the first ``eos`` and drop ``pad`` and ``sos``."""
    return F.filter(cut_at(ids, eos), lambda t: ~t.isin(pad, sos))


def pad_to(ids: Column, length: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), length - F.size(ids)))


def shift_left(ids: Column, eos: int) -> Column:
    """Teacher-forcing target: the first token goes, ``eos`` comes last."""
    return F.concat(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))), F.array(F.lit(eos)))


def positional_hits(a: Column, b: Column) -> Column:
    """Equal items on the common prefix length of two arrays; those of equal arrays are not compared one by one."""
    return F.when(a == b, F.size(F.array_compact(a))).otherwise(F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda hit: hit)))


def common_length(a: Column, b: Column) -> Column:
    return F.least(F.size(a), F.size(b))


def log_sum_exp(scores: Column) -> Column:
    return let(
        F.array_max(scores),
        lambda top: top + F.log(F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))),
    )


def log_softmax(scores: Column) -> Column:
    return let(log_sum_exp(scores), lambda z: F.transform(scores, lambda x: x - z))


def argmax(scores: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def token_nll(scores: Column, token: Column) -> Column:
    """Negative log-likelihood of a token id under unnormalised scores."""
    return log_sum_exp(scores) - F.get(scores, token)


def word_symbols(words: Column, alphabet: Column) -> Column:
    """Each word as one code point: its place in ``alphabet``, one shared symbol if absent.

    Edit distance over words is then the built-in character edit distance.
    """
    place = F.transform(words, lambda w: F.array_position(alphabet, w) + F.lit(65536))
    return F.array_join(
        F.transform(place, lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")), ""
    )


def word_edits(hyp: Column, ref: Column) -> Column:
    """Word-level edit distance of two word arrays."""
    return let(
        F.array_distinct(ref),
        lambda alphabet: F.levenshtein(word_symbols(hyp, alphabet), word_symbols(ref, alphabet)),
    )
