import json
import os
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairforge.operators import epochs, scans, trials
from pairforge.sources import logs, tables
from pairforge.streaming import inflight, monitor
from pairforge.streaming.runner import run_to_table


def fold(values, patience=2, lr=0.5, lowest=1e-4):
    """The plateau rule, one epoch after the other."""
    best, misses, out = None, 0, []
    for value in values:
        before = lr
        if best is None or value > best:
            best, misses = value, 0
        else:
            misses += 1
        if misses > patience:
            lr, misses = lr * 0.1, 0
        out.append((misses, pytest.approx(lr), before > lowest))
    return out


@pytest.mark.parametrize("values", [[1, 1, 1, 1, 1, 1, 1], [3, 4, 2, 2, 5, 1, 1, 1, 1, 6], [1], list(range(9)), [9] + [1] * 20])
def test_plateau_equals_fold(spark, values, monkeypatch):
    monkeypatch.setattr(epochs, "EPOCHS_PER_CHUNK", 3)
    rows = spark.createDataFrame([("r", i + 1, float(v)) for i, v in enumerate(values)], "run_id string, epoch int, chrf double")
    got = epochs.plateau(rows, lr=0.5).orderBy("epoch").collect()
    assert [(r["no_improve"], r["lr"], r["executed"]) for r in got] == fold(values)


def test_running_over_chunks(spark):
    rows = spark.range(50).select(F.lit("a").alias("k"), "id", F.floor(F.col("id") / 7).alias("c"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    got = scans.running(rows, ["k"], "c", ["id"], {"total": ("sum", F.col("id"), True), "seen": ("last", F.col("v"), False), "top": ("max", F.col("id"), False)})
    for r in got.collect():
        i = r["id"]
        assert r["total"] == i * (i + 1) // 2
        assert r["seen"] == (None if i == 0 else (i - 1) // 5 * 5)
        assert r["top"] == (None if i == 0 else i - 1)


LINES = [
    "Validation — BLEU: 1.00, CHR-F: 40.50, ROUGE-1: 0.5",
    "Epoch 1 finished, average loss: 1.0, Accuracy: 50.00%",
    "noise",
    "Validation — BLEU: 61.00, CHR-F: 78.50, ROUGE-1: 0.81, Accuracy: 81.20%, PPL: 3.10",
    "Epoch 3 finished, average loss: 0.9, Accuracy: 60.00%",
    "Validation — BLEU: 60.00, CHR-F: 70.00, ROUGE-1: 0.80",
    "Validation — BLEU: 60.00, CHR-F: 99.00, ROUGE-1: 0.80",
]


def test_log_parsing(spark):
    rows = spark.createDataFrame([(7, i // 2, i, v) for i, v in enumerate(LINES)], "run_id bigint, chunk bigint, line_no bigint, value string")
    got = trials.validations(rows)
    assert [(r["epoch"], r["chrf"]) for r in got.orderBy("line_no").collect()] == [(0, 40.5), (1, 78.5), (3, 70.0), (3, 99.0)]
    kept = trials.until_stop(got)
    assert kept.count() == 3 and trials.best_per_trial(kept).first()["best_chrf"] == 78.5
    values = rows.where("line_no = 3").select(trials.all_values(F.col("value")).alias("m")).first()["m"]
    assert (values["BLEU"], values["Accuracy"], values["PPL"], values["SER"]) == (61.0, pytest.approx(0.812), 3.1, None)


def test_log_files(spark, tmp_path):
    (tmp_path / "run1.log").write_text("\n".join(LINES))
    rows = logs.read_log_files(spark, str(tmp_path))
    got = trials.validations(rows).orderBy("line_no").collect()
    assert [(r["run_id"], r["epoch"], r["chrf"]) for r in got][1] == ("run1", 1, 78.5)


def test_median_pruning(spark):
    rows = spark.createDataFrame([(t, s, float(v)) for t, s, v in [(1, 2, 5), (2, 2, 6), (3, 2, 7), (4, 2, 1), (5, 2, 9), (4, 1, 1)]], "trial_id int, step int, value double")
    got = {(r["trial_id"], r["step"]): (r["median"], r["pruned"]) for r in trials.median_pruning(rows).collect()}
    assert got[(4, 2)] == (6.0, True) and got[(5, 2)] == (6.0, False) and got[(3, 2)] == (5.5, False)
    assert got[(4, 1)] == (None, False)


def replayed(rows, startup=3, warmup=1):
    """Median pruning trial by trial, in plain Python."""
    out, finished = {}, []
    for trial in sorted({t for t, _, _ in rows}):
        own, best, over = sorted((s, v) for t, s, v in rows if t == trial), None, False
        for step, value in own:
            best = value if best is None else best if value is None else max(best, value)
            seen = [v for f in finished for s, v in f if s == step and v is not None]
            median = statistics.median(seen) if seen else None
            hit = not over and step > warmup and len(finished) >= startup and median is not None and best is not None and best < median
            out[trial, step] = (median, len(finished), hit, over)
            over = over or hit
        if not over:
            finished.append(own)
    return out


@pytest.mark.parametrize("cells", [40, 1 << 18])
def test_pruned_trials_leave_later_medians(spark, cells):
    rng = random.Random(5)
    many = {q: [(t, s, rng.choice([None, 1.0, 2.0, *[float(rng.randint(0, 30)) for _ in range(9)]])) for t in range(25) for s in range(1, 7) if rng.random() < 0.8] for q in "ab"}
    rows = spark.createDataFrame([(q, *r) for q in "ab" for r in many[q]], "search string, trial_id int, step int, value double")
    got = trials.median_pruning(rows, keys=["search"], cells=cells).collect()
    for q in "ab":
        assert {(r["trial_id"], r["step"]): (r["median"], r["n_earlier"], r["pruned"], r["ended"]) for r in got if r["search"] == q} == replayed(many[q])
    alone = trials.median_pruning(rows.where("search = 'a'").drop("search"), cells=cells).collect()
    assert {(r["trial_id"], r["step"]): (r["median"], r["n_earlier"], r["pruned"], r["ended"]) for r in alone} == replayed(many["a"])
    assert trials.median_pruning(rows.limit(0).drop("search")).count() == 0


def test_configs_tolerate_bad_entries(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"run_id": 1, "hidden_dim": 700, "device": "cpu"}\n{broken\n{"hidden_dim": 5}\n')
    got = tables.read_configs(spark, str(tmp_path)).collect()
    assert [(r["run_id"], r["hidden_dim"]) for r in got] == [(1, 700)]
    assert got[0]["config"] == {"run_id": "1", "hidden_dim": "700", "device": "cpu"}


def test_results_document_holds_params(spark):
    top = spark.createDataFrame([(1, 7, 80.5, 700), (2, 5, 70.0, 800)], "rank int, run_id bigint, best_chrf double, hidden_dim int")
    got = json.loads(trials.results_document(top).first()["document"])
    assert got["best_trial"] == {"rank": 1, "run_id": 7, "best_chrf": 80.5, "params": {"hidden_dim": 700}}
    assert [t["params"]["hidden_dim"] for t in got["top_3_trials"]] == [700, 800]


def test_plateau_reads_its_input_few_times(spark):
    rows = spark.createDataFrame([("r", 1, 1.0)], "run_id string, epoch int, chrf double")
    decided = epochs.plateau(rows)
    scans_of = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans_of(decided) <= 4 and scans_of(epochs.checkpoints(decided)) <= 5


def test_checkpoints(spark):
    values = [3, 4, 2, 9, 9, 1]
    rows = spark.createDataFrame([("r", i + 1, float(v)) for i, v in enumerate(values)], "run_id string, epoch int, chrf double")
    got = epochs.checkpoints(epochs.plateau(rows)).where("is_best or is_last").orderBy("epoch").collect()
    assert [(r["epoch"], r["is_best"], r["is_last"]) for r in got] == [(4, True, False), (6, False, True)]


def test_pairs_read_or_build(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("a", "b", 1, 0, 1, False)], tables.PAIRS_SCHEMA)

    key = (10, 4, 0.1, "word")
    assert tables.pairs_or_empty(spark, str(tmp_path), *key).count() == 0
    for _ in range(2):
        assert tables.read_or_build(spark, str(tmp_path), *key, build).count() == 1
    assert len(calls) == 1


def test_monitor_keeps_state_between_runs(spark, tmp_path):
    source, home = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(source)

    def feed(name, part):
        (source / name).write_text("\n".join(f"7\t{i}\t{LINES[i]}" for i in part))

    def run():
        lines = logs.parse_tagged(spark.readStream.text(str(source)))
        return run_to_table(monitor.monitor(lines), "monitor", keep=home)

    feed("a.txt", range(0, 3))
    run()
    feed("b.txt", range(3, 7))
    got = run().orderBy("line_no").collect()
    assert [(r["epoch"], r["best_chrf"], r["stop"]) for r in got] == [(0, 40.5, False), (1, 78.5, False), (3, 78.5, True), (3, 99.0, True)]


def test_monitor_flags_late_lines(spark, tmp_path):
    source, home = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(source)
    for name, part in (("a.txt", [0, 3, 4, 5]), ("b.txt", [1, 2, 6])):
        (source / name).write_text("\n".join(f"7\t{i}\t{LINES[i]}" for i in part))
        run_to_table(monitor.monitor(logs.parse_tagged(spark.readStream.text(str(source)))), "monitor", keep=home)
    (source / "c.txt").write_text(f"7\t2\t{LINES[3]}")
    got = run_to_table(monitor.monitor(logs.parse_tagged(spark.readStream.text(str(source)))), "monitor", keep=home)
    rows = sorted((r["line_no"], r["epoch"], r["late"]) for r in got.collect() if r["epoch"] is not None)
    assert rows == [(0, 0, False), (3, 0, False), (5, 3, False), (6, 3, False)]
    assert [(r["line_no"], r["late"], r["stop"]) for r in got.where("epoch is null").collect()] == [(2, True, False)]


def test_lines_in_any_order_equal_the_batch(spark, tmp_path):
    def numbered(part):
        return [f"{run}\t{i}\t{LINES[i]}" for run, i in part]

    every = [(run, i) for run in (7, 8) for i in range(7)]
    want = {(run, i) for run, i in every}
    results = []
    for k, batches in enumerate([[every], [[(7, 3), (7, 4), (7, 6), (8, 0)], [(7, 1), (8, 6), (8, 5)], [(7, 0), (7, 2), (8, 1), (8, 2), (8, 2)], [(7, 5), (8, 3), (8, 4)]]]):
        source = tmp_path / f"in{k}"
        source.mkdir()
        for n, part in enumerate(batches):
            (source / f"{n}.txt").write_text("\n".join(numbered(part)))
            lines = logs.parse_tagged(spark.readStream.text(str(source)))
            got = run_to_table(monitor.ordered_monitor(lines, first_line=0), "monitor", keep=str(tmp_path / f"out{k}"))
        results.append(sorted(tuple(r) for r in got.collect()))
    assert results[0] == results[1] and len(results[0]) == 8 and {r[:2] for r in results[0]} <= want
    batch = trials.validations(spark.createDataFrame([(7, 0, i, t) for i, t in enumerate(LINES)], "run_id bigint, chunk int, line_no bigint, value string"))
    assert [(r["line_no"], r["epoch"], r["chrf"]) for r in batch.orderBy("line_no").collect()] == [r[1:4] for r in results[0] if r[0] == 7]
    assert all(r[2] is not None and not r[6] for r in results[0])


class Clock:
    """State of one run, outside a stream."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.wait = None, False, False, None

    def update(self, value):
        self.get, self.exists, self.wait = value, True, None

    def setTimeoutDuration(self, ms):
        self.wait = ms


def test_a_lost_line_ends_the_wait():
    step, state = monitor._in_order(1, 500), Clock()
    lines = lambda *rows: [pd.DataFrame(rows, columns=["line_no", "mark", "chrf"])]
    assert len(next(step((7,), lines((3, 2.0, None), (4, None, 70.0)), state))) == 0 and state.wait == 500
    state.hasTimedOut = True
    got = next(step((7,), [], state))
    assert got[["line_no", "epoch", "late"]].values.tolist() == [[4, 2, False]] and state.wait is None
    state.hasTimedOut = False
    got = next(step((7,), lines((2, None, 90.0), (5, None, 60.0)), state))
    assert [(r.line_no, r.late, r.best_chrf) for r in got.itertuples()] == [(2, True, 90.0), (5, False, 90.0)]
    assert got["epoch"].isna().tolist() == [True, False]


def test_stream_equals_batch(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents*.parquet")
    got = run_to_table(inflight.clean(stream), "clean")
    assert got.exceptAll(inflight.clean(docs)).count() == 0 and got.count() == docs.count()
