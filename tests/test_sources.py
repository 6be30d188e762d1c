"""Stored tables, files and streams as sources."""

from __future__ import annotations

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pairforge.operators import trials
from pairforge.session import stored
from pairforge.sources import committed, corpus, folders, growing, tables
from pairforge.streaming.runner import run_to_table


def test_only_whole_builds_are_read(spark, tmp_path):
    root, key = str(tmp_path), {"n": 3, "p": 0.5}
    good = lambda: {"rows": spark.range(5).toDF("x"), "none": spark.range(0).toDF("y")}

    def dies():
        raise RuntimeError("half-way")

    def dies_in_a_task():
        return {"rows": spark.range(5).toDF("x"), "none": spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("y"))}

    home = committed.key_path(root, key)
    for build in (dies, dies_in_a_task):
        with pytest.raises(Exception, match="half-way|lost"):
            committed.read_or_build(spark, root, key, build)
        assert committed.committed(spark, home) is None
    # a record that was being written
    os.makedirs(os.path.join(home, "commits", "build-x", "_temporary", "0"))
    assert committed.committed(spark, home) is None
    got = committed.read_or_build(spark, root, key, good)
    assert got["rows"].count() == 5 and got["none"].columns == ["y"] and got["none"].count() == 0
    again = committed.read_or_build(spark, root, key, dies)
    assert again["rows"].count() == 5
    assert committed.committed(spark, committed.key_path(root, {"n": 4, "p": 0.5})) is None


def test_fingerprint_follows_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    first = committed.fingerprint(spark.read.parquet(path))
    assert first == committed.fingerprint(spark.read.parquet(path))
    spark.range(1).write.mode("append").parquet(path)
    assert first != committed.fingerprint(spark.read.parquet(path))


@pytest.mark.parametrize("sep", ["\n", "."])
def test_one_utf16_file_is_read_by_many_tasks(spark, tmp_path, sep):
    # U+0A05 U+4E00: its bytes hold those of a line break between the two; U+2E05 U+2000 those of a full stop
    odd = "\u0a05\u4e00" if sep == "\n" else "\u2e05\u2000"
    pieces = [f"line {i} \u00e9\U0001f642" + (f" {odd} a {odd}{odd} b" if i % 7 == 3 else "") + "x" * (i % 50) for i in range(2000)] + ["", odd]
    path = tmp_path / "corpus.txt"
    for text, encoding in ((sep.join(["\ufeff" + pieces[0], *pieces[1:]]), "utf-16-le"), (sep.join(pieces), "utf-16-be")):
        path.write_bytes(text.encode(encoding))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
        try:
            rows = corpus.read_utf16(spark, str(path), sep, encoding.upper().replace("16-", "16"))
            got = [r["text"] for r in rows.orderBy("path", "chunk", "line_no").collect()]
            assert spark.read.option("encoding", "UTF-16LE").option("lineSep", sep).text(str(path)).rdd.getNumPartitions() > 10
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == pieces


def test_utf16_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("\u4e00\u0a05 b",), ("",)], "text string")
    corpus.write_utf16(rows, str(tmp_path / "u"), sep="\x1e")
    assert sorted(r["text"] for r in corpus.read_utf16(spark, str(tmp_path / "u"), sep="\x1e").collect()) == ["", "a", "\u4e00\u0a05 b"]


def test_growing_files_give_each_line_once(spark, tmp_path, monkeypatch):
    logs, keep = tmp_path / "logs", str(tmp_path / "keep")
    logs.mkdir()
    (logs / "one.log").write_text("a1\na2\na3 is not")
    (logs / "two.log").write_text("b1\n" * 50)
    (logs / "_hidden.log").write_text("no\n")
    stream = lambda: growing.growing_logs(spark, str(logs), suffix=".log")
    first = run_to_table(stream(), "growing", keep=keep)
    assert first.count() == 52
    with open(logs / "one.log", "a") as file:
        file.write(" ended\na4\n")
    (logs / "three.log").write_text("c1\r\nc2")
    got = run_to_table(stream(), "growing", keep=keep)
    assert [r["value"] for r in got.where("run_id = 'one'").orderBy("line_no").collect()] == ["a1", "a2", "a3 is not ended", "a4"]
    assert [r["value"] for r in got.where("run_id = 'three'").collect()] == ["c1"] and got.count() == 55
    assert run_to_table(stream(), "growing", keep=keep).count() == 55


def test_ranges_of_a_file_hold_every_line_once(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "BLOCK", 7)
    lines = [f"{'x' * (i % 13)}{i}" for i in range(60)]
    path = tmp_path / "r.log"
    path.write_text("\n".join(lines) + "\nopen")
    reader = growing.GrowingReader({"path": str(tmp_path)})
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) > 20
    assert [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()] == lines


def test_run_folders(spark, tmp_path):
    def run(name, **files):
        (tmp_path / name).mkdir()
        for file, text in files.items():
            (tmp_path / name / file.replace("__", ".")).write_text(text)

    score = '{"best_metric_ChrF": 78.5,\n "epoch": 3}'
    run("good", best_model__json=score, config__yaml="# run\nhidden_dim: 700  # wide\np_dropout: 0.25\nname: 'a: b # c'\nhidden_dim: 701\nempty:\n")
    run("json", best_model__json=score, config__json='{\n "hidden_dim": 800,\n "deep": {"a": 1}\n}')
    run("no_config", best_model__json=score)
    run("no_score", config__yaml="a: 1")
    run("bad_score", best_model__json="{oops", config__yaml="a: 1")
    run("null_score", best_model__json="{}", config__yaml="a: 1")
    run("bad_yaml", best_model__json=score, config__yaml="a: 1\n  - what\n")
    run("bad_json", best_model__json=score, config__json="{oops")
    runs, bad = tables.read_run_folders(spark, str(tmp_path))
    got = {r["run"]: (r["best_chrf"], r["config"]) for r in runs.collect()}
    assert got["good"] == (78.5, {"hidden_dim": "701", "p_dropout": "0.25", "name": "a: b # c", "empty": ""})
    assert got["json"][1]["hidden_dim"] == "800" and set(got) == {"good", "json"}
    assert {r["run"]: r["problem"] for r in bad.collect()} == {
        "no_config": "no configuration", "no_score": "no score file", "bad_score": "broken score file",
        "null_score": "no score", "bad_yaml": "broken configuration", "bad_json": "broken configuration",
    }
    board = trials.leaderboard(runs.select(F.col("run").alias("run_id"), "best_chrf"), runs.select(F.col("run").alias("run_id"), "config"))
    assert [r["run_id"] for r in board.orderBy("rank").collect()] == ["good", "json"]


def test_a_batch_that_comes_again_appends_nothing(spark, tmp_path):
    path = str(tmp_path / "scalars")
    rows = spark.createDataFrame([("r", "loss", 1, 0.5), ("r", "acc", 1, 0.9)], "run_id string, tag string, step int, value double")
    for batch_id in (0, 1, 1, 0):
        tables.append_scalars_once(rows.withColumn("step", F.col("step") + batch_id), batch_id, path)
    assert tables.read_scalars(spark, path).count() == 4


def test_files_are_written_by_many_tasks_in_line_order(spark, tmp_path):
    rows = spark.range(400).select(
        F.concat(F.lit("run="), (F.col("id") % 40).cast("string"), F.lit("/a.txt")).alias("path"),
        (-F.col("id")).alias("line_no"), F.when(F.col("id") != 7, F.col("id").cast("string")).alias("value"),
    )
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("written", "files written")
    for _ in range(2):  # a write that comes again leaves the same files
        folders.write_lines(rows.coalesce(1), str(tmp_path), ["line_no"])
    spark.sparkContext.setJobGroup("rest", "rest of the tests")
    tasks = [seen.getStageInfo(s).numTasks for j in seen.getJobIdsForGroup("written") for s in seen.getJobInfo(j).stageIds if seen.getStageInfo(s)]
    assert max(tasks) == spark.sparkContext.defaultParallelism
    files = sorted(p for p in tmp_path.rglob("*") if p.is_file())
    assert len(files) == 40 and not any(p.name.startswith(".") for p in files)
    for run in range(40):
        lines = (tmp_path / f"run={run}" / "a.txt").read_text().splitlines()
        assert lines == [str(i) if i != 7 else "" for i in range(run, 400, 40)][::-1]


def test_shuffles_go_when_a_table_is_stored(spark):
    local = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    count = lambda: sum(1 for _ in local.rglob("shuffle_*"))
    before = count()
    rows = stored(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("n")))
    until = time.time() + 20
    while count() > before and time.time() < until:  # files go in the background
        time.sleep(0.1)
    assert count() <= before
    assert rows.count() == 100 and rows.agg(F.sum("n")).first()[0] == 499500
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
