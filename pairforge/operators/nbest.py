"""Beam expansion and selection over tables of scored candidates.

``states(ex_id, beam, ids, score, logits)``: one live hypothesis per row with the scores
of every next token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequences as S


def log_probabilities(states: DataFrame) -> DataFrame:
    return states.withColumn("logprobs", S.log_softmax(F.col("logits")))


def expand(states: DataFrame, width: int, first_step: bool = False) -> DataFrame:
    """``ex_id, beam, token, flat, score, ids``: the ``width`` best continuations per state.

    No state can place more than ``width`` candidates, so each row cuts its own list
    before anything is shuffled. On the first step all beams are copies and only beam 0
    is expanded.
    """
    if first_step:
        states = states.where(F.col("beam") == 0)
    scored = F.transform(
        "logprobs", lambda x, i: F.struct((-(F.col("score") + x)).alias("cost"), i.alias("token"))
    )
    best = F.slice(F.array_sort(scored), 1, width)
    return (
        log_probabilities(states)
        .withColumn("vocab", F.size("logits"))
        .select("ex_id", "beam", "ids", "vocab", F.explode(best).alias("c"))
        .select(
            "ex_id",
            "beam",
            F.col("c.token").alias("token"),
            (F.col("beam") * F.col("vocab") + F.col("c.token")).cast("int").alias("flat"),
            (-F.col("c.cost")).alias("score"),
            F.concat("ids", F.array(F.col("c.token"))).alias("ids"),
        )
    )


def select_top(candidates: DataFrame, width: int) -> DataFrame:
    """The ``width`` best candidates per example as new beams 0.. (ties by flat index)."""
    order = W.partitionBy("ex_id").orderBy(F.desc("score"), "flat")
    return (
        candidates.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= width)
        .withColumn("rank", F.col("rank") - 1)
    )


def recover(flat: str, vocab: int) -> tuple:
    """Parent beam and token id of a flattened candidate index."""
    return (
        F.floor(F.col(flat) / vocab).cast("int").alias("parent"),
        (F.col(flat) % vocab).cast("int").alias("token"),
    )


def best_hypotheses(beams: DataFrame, eos: int) -> DataFrame:
    """Per example the ids with the best score per token, cut at the first ``eos``."""
    normal = F.struct((F.col("score") / F.size("ids")).alias("s"), (-F.col("rank")).alias("r"))
    return beams.groupBy("ex_id").agg(
        F.max_by("ids", normal).alias("ids"), F.max(normal)["s"].alias("norm_score")
    ).select("ex_id", S.cut_at(F.col("ids"), eos).alias("ids"), "norm_score")


def greedy_accuracy(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """Share of positions whose best-scored token is the target."""
    hit = (S.argmax(F.col("logits")) == F.col("target")).cast("int")
    return scores.groupBy(*by).agg(
        F.sum(hit).cast("bigint").alias("n_correct"),
        F.count("*").alias("n_tokens"),
        F.avg(hit).alias("accuracy"),
    )
