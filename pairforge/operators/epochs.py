"""Training telemetry: epoch aggregates, running values, plateau and resume decisions.

The plateau rule is a running computation, so it is written as scans over the epochs of
a run and no run is folded inside one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .scans import running

# Shipped schedule.
LEARNING_RATE = 0.315762073010458
DECAY = 0.1
PATIENCE = 2
LOWEST_RATE = 0.0001
EPOCHS_PER_CHUNK = 1024


def epoch_summary(batches: DataFrame) -> DataFrame:
    """``run_id, epoch, n_batches, loss, accuracy``: mean loss, correct over tokens."""
    return batches.groupBy("run_id", "epoch").agg(
        F.count("*").alias("n_batches"),
        F.avg("loss").alias("loss"),
        F.when(F.sum("tokens") > 0, F.sum("correct") / F.sum("tokens")).otherwise(0.0).alias("accuracy"),
    )


def global_steps(batches: DataFrame, chunk: str, order: list[str]) -> DataFrame:
    """0-based ``global_step`` of every batch in its run."""
    return running(batches, ["run_id"], chunk, order, {"global_step": ("sum", F.lit(1), False)})


def running_loss(batches: DataFrame, chunk: str, order: list[str]) -> DataFrame:
    """``running_loss``: the epoch's loss before this batch over its number of batches."""
    outputs = {"_before": ("sum", F.col("loss"), False), "_n": ("total", F.lit(1), True)}
    seen = running(batches, ["run_id", "epoch"], chunk, order, outputs)
    return seen.withColumn("running_loss", F.col("_before") / F.col("_n")).drop("_before", "_n")


def scalar_rows(batches: DataFrame) -> DataFrame:
    """Long metric rows ``run_id, tag, step, value`` of batch telemetry with ``global_step``."""
    values = F.array(
        F.struct(F.lit("Accuracy/train").alias("tag"), (F.col("correct") / F.col("tokens")).alias("value")),
        F.struct(F.lit("Loss/train").alias("tag"), F.col("loss").alias("value")),
    )
    return batches.select("run_id", F.col("global_step").alias("step"), F.explode(values).alias("v")).select(
        "run_id", F.col("v.tag").alias("tag"), "step", F.col("v.value").alias("value")
    )


def _chunked(epochs: DataFrame) -> DataFrame:
    return epochs.withColumn("_chunk", F.floor(F.col("epoch") / EPOCHS_PER_CHUNK))


def _flagged(epochs: DataFrame, metric: str) -> DataFrame:
    """``_chunk``, ``_place`` (1-based in the run), ``prev_best`` and ``improved``, by one running call."""
    outputs = {"prev_best": ("max", F.col(metric), False), "_place": ("sum", F.lit(1), True)}
    seen = running(_chunked(epochs), ["run_id"], "_chunk", ["epoch"], outputs)
    return seen.withColumn("improved", F.col("prev_best").isNull() | (F.col(metric) > F.col("prev_best")))


def best_so_far(epochs: DataFrame, metric: str = "chrf") -> DataFrame:
    """``prev_best`` over earlier epochs and ``improved`` (strictly better, or the first)."""
    return _flagged(epochs, metric).drop("_chunk", "_place")


def plateau(
    epochs: DataFrame,
    metric: str = "chrf",
    lr: float = LEARNING_RATE,
    patience: int = PATIENCE,
    decay: float = DECAY,
    lowest: float = LOWEST_RATE,
) -> DataFrame:
    """Learning-rate decisions per epoch.

    After an improvement the misses count 1, 2, …; each time they pass ``patience`` the
    rate is cut and counting restarts, so the counter is the misses since the last
    improvement modulo ``patience + 1`` and every wrap is a cut. ``executed`` says whether
    the rate before the epoch was still above ``lowest``.

    Three levels of running values. Each level reads its input twice, so the first two are
    stored: nested plans would double with every level.
    """
    run, order = ["run_id"], ["epoch"]
    flagged = stored(_flagged(epochs, metric), "plateau")
    at = F.when(F.col("improved"), F.col("_place"))
    ends = {"_last": ("last", at, True), "_before": ("last", at, False)}
    placed = stored(running(flagged, run, "_chunk", order, ends), "plateau")
    # an improvement closes the misses before it; every patience + 1 of them were a cut
    closed = F.when(F.col("improved"), F.floor((F.col("_place") - 1 - F.col("_before")) / (patience + 1)))
    counted = running(placed, run, "_chunk", order, {"_closed": ("sum", closed, True)})
    misses = F.col("_place") - F.col("_last")
    counted = counted.withColumns(
        {
            "reduced": (misses > 0) & (misses % (patience + 1) == 0),
            "_cuts": F.col("_closed") + F.floor(misses / (patience + 1)),
            "no_improve": (misses % (patience + 1)).cast("int"),
        }
    ).withColumn("_cuts_before", F.col("_cuts") - F.col("reduced").cast("int"))

    def rate(cuts: str) -> Column:
        return F.lit(lr) * F.pow(F.lit(decay), F.col(cuts))

    return (
        counted.withColumn("lr", rate("_cuts"))
        .withColumn("fine_tuning", F.col("_cuts") > 0)
        .withColumn("executed", rate("_cuts_before") > lowest)
        .drop("_chunk", "_place", "_last", "_before", "_closed", "_cuts", "_cuts_before")
    )


def checkpoints(decided: DataFrame) -> DataFrame:
    """Flags of the rows a run would keep: ``is_best`` (last improvement) and ``is_last``.

    A row is the last one if none follows it, so both are running counts from the end.
    """
    back = _chunked(decided).withColumns({"_chunk": -F.col("_chunk"), "_back": -F.col("epoch")})
    better = F.coalesce(F.col("improved"), F.lit(False))
    later = {"_later": ("sum", F.lit(1), False), "_better": ("sum", better.cast("int"), False)}
    return (
        running(back, ["run_id"], "_chunk", ["_back"], later)
        .withColumn("is_best", better & (F.col("_better") == 0))
        .withColumn("is_last", F.col("_later") == 0)
        .drop("_chunk", "_back", "_later", "_better")
    )


def resume_state(decided: DataFrame) -> DataFrame:
    """The last row of every run, as one combinable aggregate."""
    cols = [c for c in decided.columns if c != "run_id"]
    return decided.groupBy("run_id").agg(F.max_by(F.struct(*cols), F.col("epoch")).alias("s")).select("run_id", "s.*")
