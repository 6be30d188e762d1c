"""Live view of training logs: epoch, chrF and best chrF per run as lines arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.trials import STOP_EPOCH, chrf_of, epoch_of

OUTPUT = "run_id bigint, line_no bigint, epoch int, chrf double, best_chrf double, stop boolean, late boolean"
STATE = "epoch int, best double, top bigint, marked bigint"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    epoch, best, top, marked = state.get if state.exists else (0, 0.0, -1, -1)
    lines = pd.concat(list(batches)).sort_values("line_no", kind="stable")
    out = []
    for line_no, mark, chrf in zip(lines["line_no"], lines["mark"], lines["chrf"]):
        known = line_no >= marked
        if pd.notna(chrf):
            best = max(best, float(chrf))
            out.append((key[0], line_no, epoch if known else None, float(chrf), best, known and epoch >= STOP_EPOCH, line_no < top))
        if pd.notna(mark) and known:
            epoch, marked = int(mark), line_no
        top = max(top, line_no)
    state.update((epoch, best, int(top), int(marked)))
    rows = pd.DataFrame(out, columns=["run_id", "line_no", "epoch", "chrf", "best_chrf", "stop", "late"])
    yield rows.astype({"epoch": "Int32"})


def monitor(lines: DataFrame) -> DataFrame:
    """Stream of reports from a stream of ``run_id, line_no, value``.

    Only epoch and validation lines, two per epoch, reach the state; the rest is filtered
    in the scan. The state of a run is four numbers. Inside a micro-batch lines are sorted.
    A line that comes after a later one of its run is ``late``: its best may hold reports
    that follow it, and its epoch is null if a later epoch line was seen. An epoch line
    older than the last one does not set the epoch back.
    """
    marks = lines.select(
        "run_id", "line_no", epoch_of(F.col("value")).alias("mark"), chrf_of(F.col("value")).alias("chrf")
    ).where(F.col("mark").isNotNull() | F.col("chrf").isNotNull())
    return marks.groupBy("run_id").applyInPandasWithState(
        _advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )


ORDERED_STATE = "epoch int, best double, next bigint, held string"


def _in_order(first_line: int, wait_ms: int | None):
    """Releases the lines of a run by number: a line waits until all before it are there, or its wait is over."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, best, next_line, packed = state.get if state.exists else (0, 0.0, first_line, "[]")
        held = {line: (mark, chrf) for line, mark, chrf in json.loads(packed)}
        out = []
        if not state.hasTimedOut:
            for batch in batches:
                for line, mark, chrf in zip(batch["line_no"].tolist(), batch["mark"].tolist(), batch["chrf"].tolist()):
                    mark, chrf = (None if pd.isna(x) else x for x in (mark, chrf))
                    if line >= next_line:
                        held.setdefault(line, (mark, chrf))
                    elif chrf is not None:  # its place has been passed
                        best = max(best, chrf)
                        out.append((key[0], line, None, chrf, best, False, True))
        for line in sorted(held):
            if line != next_line and not state.hasTimedOut:
                break
            mark, chrf = held.pop(line)
            next_line = line + 1
            if mark is not None:
                epoch = int(mark)
            if chrf is not None:
                best = max(best, chrf)
                out.append((key[0], line, epoch, chrf, best, epoch >= STOP_EPOCH, False))
        state.update((epoch, best, next_line, json.dumps([(line, *held[line]) for line in sorted(held)])))
        if held and wait_ms is not None:
            state.setTimeoutDuration(wait_ms)
        rows = pd.DataFrame(out, columns=["run_id", "line_no", "epoch", "chrf", "best_chrf", "stop", "late"])
        yield rows.astype({"run_id": "int64", "line_no": "int64", "epoch": "Int32", "chrf": "float64", "best_chrf": "float64", "stop": "bool", "late": "bool"})

    return run


def ordered_monitor(lines: DataFrame, first_line: int = 1, wait_ms: int | None = None) -> DataFrame:
    """Like :func:`monitor`, but the same whatever order the lines come in.

    The lines of a run are numbered without gaps from ``first_line``. A line that comes
    before an earlier one is held in the state, without its text, and released when the gap
    closes; so micro-batches in any order give what one batch gives. Lines that come twice
    count once.

    With ``wait_ms``, for streams that run on, a gap counts as lost after that time without a
    line of the run: all held lines are released in order, and lines that fill it later are
    ``late``, as in :func:`monitor`. A stream that only takes what is available must not be
    given it, since waiting runs would keep it alive.
    """
    marks = lines.select("run_id", "line_no", epoch_of(F.col("value")).alias("mark"), chrf_of(F.col("value")).alias("chrf"))
    return marks.groupBy("run_id").applyInPandasWithState(
        _in_order(first_line, wait_ms), OUTPUT, ORDERED_STATE, "append",
        GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
