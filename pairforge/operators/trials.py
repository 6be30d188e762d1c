"""Trial logs and search results: parsing, pruning, rankings."""

from __future__ import annotations

from bisect import insort
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import SEED, digest, uniform
from ..session import stored
from .indexing import dense_index
from .scans import running

# Search space (kind, low, high) in the order it is drawn.
SEARCH_SPACE = {
    "learning_rate": ("log", 0.3, 0.36),
    "p_dropout": ("float", 0.23, 0.35),
    "hidden_dim": ("int", 700, 950),
    "encoderLayer": ("int", 4, 6),
    "decoderLayer": ("int", 6, 12),
    "batchSize": ("int", 45, 75),
    "dataSet_probability": ("float", 0.1, 0.16),
    "dataSet_repetition": ("int", 3, 4),
}

# Log line formats.
VALIDATION_MARK = "Validation — BLEU:"
CHRF_VALUE = r"CHR-F:\s*([0-9.]+)"
EPOCH_VALUE = r"Epoch\s+(\d+)\s+finished"
VALUE_NAMES = (
    "BLEU", "CHR-F", "ROUGE-1", "ROUGE-2", "ROUGE-L", "Accuracy", "PPL", "Precision", "Recall",
    "F₀.₅", "F₁", "CER", "WER", "SER", "GLEU",
)

# Stop after this epoch; pruning starts after so many trials and steps.
STOP_EPOCH = 3
STARTUP_TRIALS = 3
WARMUP_STEPS = 1
TOP = 3

STEPS_PER_CHUNK = 1024
LINES_PER_CHUNK = 4096


def sample_trials(ids: DataFrame, seed: int = SEED) -> DataFrame:
    """One uniform draw of every parameter per ``trial_id``; tied sizes share one draw."""
    cols = {}
    for name, (kind, low, high) in SEARCH_SPACE.items():
        u = uniform(digest(seed, "trial", F.col("trial_id"), name))
        if kind == "log":
            cols[name] = F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low))))
        elif kind == "float":
            cols[name] = F.lit(low) + u * F.lit(high - low)
        else:
            cols[name] = (F.lit(low) + F.floor(u * (high - low + 1))).cast("int")
    return ids.select("trial_id", *[c.alias(n) for n, c in cols.items()], cols["hidden_dim"].alias("embedding_dim"))


def is_validation(line: Column) -> Column:
    return line.contains(VALIDATION_MARK)


def chrf_of(line: Column) -> Column:
    """The chrF of a validation line, null for any other line."""
    found = F.regexp_extract(line, CHRF_VALUE, 1)
    return F.when(is_validation(line) & (found != ""), found.try_cast("double"))


def epoch_of(line: Column) -> Column:
    """The number in an epoch line, null for any other line."""
    found = F.regexp_extract(line, EPOCH_VALUE, 1)
    return F.when(found != "", found.try_cast("int"))


def all_values(line: Column) -> Column:
    """Map of the fifteen values of a validation line; percentages become fractions."""
    entries = []
    for name in VALUE_NAMES:
        hit = F.regexp_extract(line, rf"(?:— |, ){name}: ([0-9.]+)(%?)", 1)
        percent = F.regexp_extract(line, rf"(?:— |, ){name}: ([0-9.]+)(%?)", 2)
        number = F.when(hit != "", hit.cast("double"))
        entries += [F.lit(name), F.when(percent == "%", number / 100).otherwise(number)]
    return F.create_map(*entries)


def validations(lines: DataFrame, chunk: str = "chunk", order: list[str] = ("line_no",)) -> DataFrame:
    """``run_id, line_no, epoch, chrf``: validation lines with the epoch carried forward.

    ``epoch`` is the last one finished before the line in the same run, 0 if none.
    """
    marks = lines.withColumns({"_e": epoch_of(F.col("value")), "chrf": chrf_of(F.col("value"))})
    marks = marks.where(F.col("_e").isNotNull() | F.col("chrf").isNotNull())
    carried = running(marks, ["run_id"], chunk, list(order), {"epoch": ("last", F.col("_e"), False)})
    return carried.where(F.col("chrf").isNotNull()).select(
        "run_id", *order, F.coalesce("epoch", F.lit(0)).alias("epoch"), "chrf"
    )


def until_stop(reports: DataFrame, stop: int = STOP_EPOCH) -> DataFrame:
    """Reports up to and including the first one of epoch ``stop`` or later."""
    chunked = reports.withColumn("_chunk", F.floor(F.col("line_no") / LINES_PER_CHUNK))
    passed = {"_passed": ("sum", (F.col("epoch") >= stop).cast("int"), False)}
    seen = running(chunked, ["run_id"], "_chunk", ["line_no"], passed)
    return seen.where(F.col("_passed") == 0).select(*reports.columns)


def best_per_trial(reports: DataFrame) -> DataFrame:
    return reports.groupBy("run_id").agg(F.greatest(F.lit(0.0), F.max("chrf")).alias("best_chrf"))


class _Middle:
    """The middle of the values of finished trials at one step, and how many lie below and in all.

    Holds as many values on both sides of the middle as trials may still be added, so the
    median stays exact while the others are only counted.
    """

    def __init__(self) -> None:
        self.values: list[float] = []
        self.below = self.total = self.above = 0

    def load(self, values: list[float], below: int, total: int) -> None:
        self.values, self.below, self.total = sorted(values), below, total
        self.above = total - below - len(values)

    def add(self, value: float) -> None:
        self.total += 1
        if self.below and value < self.values[0]:
            self.below += 1
        elif self.above and value > self.values[-1]:
            self.above += 1
        else:
            insort(self.values, value)

    def median(self) -> float | None:
        if not self.total:
            return None
        low, high = (self.total - 1) // 2 - self.below, self.total // 2 - self.below
        return (self.values[low] + self.values[high]) / 2


def _replay(startup: int, warmup: int, past_warmup: bool):
    """Runs the trials of a chunk in order against the finished ones."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        middles: dict[int, _Middle] = {}
        for step, part in rows[rows["kind"] == 0].groupby("step"):
            middles.setdefault(step, _Middle()).load(part["value"].tolist(), int(part["below"].iloc[0]), int(part["total"].iloc[0]))
        n_finished = int(rows["finished"].max())
        own = rows[rows["kind"] == 1].sort_values(["place", "step"], kind="stable")
        medians, counts, pruned, ended, completed = [], [], [], [], []
        for _, trial in own.groupby("place", sort=True):
            over = False
            for step, best in zip(trial["step"], trial["best"]):
                middle = middles.get(step)
                median = middle.median() if middle else None
                late = step > warmup if past_warmup else step >= warmup
                hit = not over and late and n_finished >= startup and median is not None and best < median
                medians.append(median)
                counts.append(n_finished)
                pruned.append(hit)
                ended.append(over)
                over = over or hit
            completed += [not over] * len(trial)
            if not over:
                n_finished += 1
                for step, value in zip(trial["step"], trial["value"]):
                    if not pd.isna(value):
                        middles.setdefault(step, _Middle()).add(value)
        out = own.drop(columns=["kind", "below", "total", "finished"])
        return out.assign(median=pd.Series(medians, index=out.index, dtype="float64"), n_earlier=counts, pruned=pruned, ended=ended, completed=completed)

    return run


def _middles(done: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Per search and step: the values up to ``reach`` ranks from the middle, ranked by range partitions."""
    ranked = stored(dense_index(done.where(F.col("value").isNotNull()), [*keys, "step", "value", "place"], "_rank"), "finished")
    sizes = ranked.groupBy(*keys, "step").agg(F.min("_rank").alias("_first"), F.count("*").alias("total"))
    placed = ranked.join(sizes, [*keys, "step"]).withColumn("_rank", F.col("_rank") - F.col("_first"))
    near = placed.where(F.abs(F.col("_rank") - F.floor(F.col("total") / 2)) <= reach)
    below = F.greatest(F.lit(0), F.floor(F.col("total") / 2) - reach).cast("bigint")
    return near.select(*keys, "step", "value", below.alias("below"), "total")


def median_pruning(
    reports: DataFrame, startup: int = STARTUP_TRIALS, warmup: int = WARMUP_STEPS, keys: list[str] = (),
    past_warmup: bool = True, cells: int = 1 << 18,
) -> DataFrame:
    """Adds ``best, median, n_earlier, pruned, ended`` to ``trial_id, step, value`` (unique on trial and step).

    Replays a search whose trials run one after the other. A trial is ``pruned`` at its first
    step whose best value so far is below the median of what earlier *finished* trials
    reported there; it has not finished then, and counts in no later median. Rows after that
    step are ``ended``. Nothing is pruned before ``startup`` trials have finished, nor up to
    step ``warmup`` (before it, if not ``past_warmup``). ``n_earlier`` counts the finished
    trials. Null values are passed over. ``keys`` name the search a row belongs to.

    Whether a trial finishes depends on all before it, so trials go in rounds of some
    ``cells`` reported values a search. Only a round's own values and those near the middle
    of the finished ones, as many as may still be added, meet in one task; the finished
    ones are ranked by range partitions, whatever their number at a step.
    """
    keys = list(keys)
    chunked = reports.select(*keys, "trial_id", "step", F.col("value").cast("double").alias("value")).withColumn("_chunk", F.floor(F.col("step") / STEPS_PER_CHUNK))
    best = running(chunked, [*keys, "trial_id"], "_chunk", ["step"], {"best": ("max", F.col("value"), True)})
    rows = stored(best.select(*keys, "trial_id", "step", "value", "best"), "reports")
    order = dense_index(rows.select(*keys, "trial_id").distinct(), [*keys, "trial_id"], "place")
    if keys:
        first = order.groupBy(*keys).agg(F.min("place").alias("_first"))
        order = order.join(first, keys).withColumn("place", F.col("place") - F.col("_first")).drop("_first")
    most = rows.groupBy(*keys, "trial_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    size = max(1, cells // most)
    rows = stored(rows.join(order, [*keys, "trial_id"]).withColumn("_round", F.floor(F.col("place") / size)), "trials")
    rounds = rows.agg(F.max("_round").alias("n")).first()["n"]
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.drop("_round").dtypes)
    schema = f"{kinds}, median double, n_earlier bigint, pruned boolean, ended boolean, completed boolean"
    columns = rows.drop("_round").columns
    parts: list[DataFrame] = []
    for k in range(0 if rounds is None else rounds + 1):
        now = rows.where(F.col("_round") == k).drop("_round").withColumns({"kind": F.lit(1), "below": F.lit(0).cast("bigint"), "total": F.lit(0).cast("bigint")})
        if parts:
            done = reduce(DataFrame.unionByName, parts).where("completed").select(*keys, "place", "step", "value")
            near = _middles(done, keys, size + 1).withColumn("kind", F.lit(0))
            finished = done.select(*keys, "place").distinct().groupBy(*keys).agg(F.count("*").alias("finished"))
            now = now.unionByName(near, allowMissingColumns=True)
            if keys:
                now = now.join(finished, keys, "left")
            else:
                now = now.withColumn("finished", F.lit(finished.first()["finished"]))
            now = now.withColumn("finished", F.coalesce("finished", F.lit(0)).cast("bigint"))
        else:
            now = now.withColumn("finished", F.lit(0).cast("bigint"))
        parts.append(stored(now.groupBy(*keys).applyInPandas(_replay(startup, warmup, past_warmup), schema).select(*columns, "median", "n_earlier", "pruned", "ended", "completed"), "pruning"))
    if not parts:
        empty = rows.drop("_round", "place")
        return empty.withColumns({"median": F.lit(None).cast("double"), "n_earlier": F.lit(None).cast("bigint"), "pruned": F.lit(None).cast("boolean"), "ended": F.lit(None).cast("boolean")})
    return reduce(DataFrame.unionByName, parts).drop("place", "completed")


def top_trials(results: DataFrame, k: int = TOP, score: str = "best_chrf", key: str = "run_id") -> DataFrame:
    """The ``k`` best trials with their rank; a top-k sort, then a window over k rows."""
    best = results.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), key)))


def results_document(top: DataFrame, score: str = "best_chrf", key: str = "run_id") -> DataFrame:
    """One JSON document with the best trial and the ranked list (of a top-k table).

    Columns besides rank, key and score are the trial's ``params``.
    """
    params = [c for c in top.columns if c not in ("rank", key, score)]
    entry = F.struct("rank", key, score, *([F.struct(*params).alias("params")] if params else []))
    return top.agg(F.array_sort(F.collect_list(entry)).alias("r")).select(
        F.to_json(F.struct(F.col("r")[0].alias("best_trial"), F.col("r").alias("top_3_trials"))).alias("document")
    )


def leaderboard(results: DataFrame, configs: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs that have both a score and a configuration, best first, with their position.

    Without a limit every run gets its rank, from a distributed sort.
    """
    joined = results.join(configs, "run_id").where(F.col("best_chrf").isNotNull())
    if limit is not None:
        return top_trials(joined, limit)
    keyed = joined.withColumn("_cost", -F.col("best_chrf"))
    ranked = dense_index(keyed, ["_cost", "run_id"], "rank")
    return ranked.withColumn("rank", F.col("rank") + 1).drop("_cost")


def parameter_effect(board: DataFrame, parameter: str, low: float, high: float, bins: int = 4) -> DataFrame:
    """Mean score per equal-width bin of one parameter."""
    at = F.width_bucket(F.col(parameter), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return board.groupBy(F.least(at, F.lit(bins).cast("bigint")).alias("bin")).agg(
        F.count("*").alias("n_runs"), F.avg("best_chrf").alias("mean_chrf")
    )
