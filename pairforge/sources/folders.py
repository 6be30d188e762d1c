"""Many small text files, written by the tasks themselves."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .growing import opened


def write_lines(rows: DataFrame, root: str, order: list[str] = ()) -> None:
    """Every ``path`` of ``rows(path, value)`` becomes a file below ``root`` whose lines are its values, sorted by ``order``.

    A partitioned write opens a Spark writer for each file and moves each folder in the
    driver, which costs more than the files. Here files are dealt to as many tasks as there
    are cores, however small the table is. A file is written under a hidden name and renamed
    when it is whole, so an attempt that comes again or dies leaves nothing to be read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, home = opened(root)
        now, part, out, n = None, "", None, 0
        folders: set[str] = set()

        def done() -> None:
            if out is not None:
                out.close()
                files.move(part, f"{home}/{now}")

        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist()):
                if path != now:
                    done()
                    folder, _, name = f"{home}/{path}".rpartition("/")
                    if folder not in folders:
                        files.create_dir(folder, recursive=True)
                        folders = {folder}
                    now, part, n = path, f"{folder}/.{uuid.uuid4().hex}-{name}", n + 1
                    out = files.open_output_stream(part)
                out.write(f"{value or ''}\n".encode())
        done()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    dealt = rows.repartition(tasks, "path").sortWithinPartitions("path", *order).select("path", "value")
    dealt.mapInArrow(write, "n bigint").write.format("noop").mode("overwrite").save()
