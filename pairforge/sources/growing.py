"""Streaming source of log files that grow: every complete line once."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that one task reads, small files together; of the tail that is searched at a time; rows of a batch.
BLOCK, TAIL, ROWS = 32 << 20, 1 << 16, 1 << 14


class Ranges(InputPartition):
    """Byte ranges of files: the lines that start in [low, high); ``first`` says that ``low`` starts a line."""

    def __init__(self, ranges: list[tuple[str, int, int, bool]]) -> None:
        self.ranges = ranges


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address (local, hdfs, s3, gs, ...), and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(quote(path, safe=":/%=?&@"))
    return fs.LocalFileSystem(), path


def last_line_end(files: fs.FileSystem, path: str, size: int, known: int) -> int:
    """Just behind the last line break of a file, not before ``known``; reads from the end backwards."""
    with files.open_input_file(path) as file:
        end = size
        while end > known:
            start = max(known, end - TAIL)
            at = file.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return known


def lines_of(files: fs.FileSystem, path: str, low: int, high: int, first: bool) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the lines that start in a range."""
    with files.open_input_file(path) as file:
        at = low if first else low - 1
        rest, skip = b"", not first
        while True:
            got = file.read_at(min(BLOCK, 1 << 20), at + len(rest))
            if not got:
                return
            rest += got
            start = 0
            while (end := rest.find(b"\n", start)) >= 0:
                place = at + start
                if skip:
                    skip = False
                elif place >= high:
                    return
                else:
                    yield place, rest[start:end]
                start = end + 1
            at, rest = at + start, rest[start:]
            if not skip and at >= high:
                return


class GrowingReader(DataSourceStreamReader):
    """Offsets are the end of the last complete line of every file."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.suffix = options.get("suffix", "")
        self.by_folder = options.get("run", "file") == "folder"
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        files, root = opened(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        for info in found:
            hidden = info.base_name.startswith(("_", ".")) or "/_temporary/" in info.path
            if info.type != fs.FileType.File or hidden or not info.base_name.endswith(self.suffix):
                continue
            known = self.ends.get(info.path, 0)
            if info.size > known:
                self.ends[info.path] = last_line_end(files, info.path, info.size, known)
        return dict(self.ends)

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Ranges]:
        for path, upto in end.items():  # a restarted query goes on from its checkpoint
            self.ends[path] = max(self.ends.get(path, 0), upto)
        out: list[Ranges] = []
        held: list[tuple[str, int, int, bool]] = []
        size = 0
        for path in sorted(end):
            low = start.get(path, 0)
            for at in range(low, end[path], BLOCK):
                high = min(at + BLOCK, end[path])
                if held and size + high - at > BLOCK:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append((path, at, high, at == low))
                size += high - at
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        rows: list[tuple[str, int, str]] = []

        def ready() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["run_id", "line_no", "value"])

        for path, low, high, first in partition.ranges:
            folder, _, name = path.rpartition("/")
            run = folder.rpartition("/")[2] if self.by_folder else name.rpartition(".")[0] or name
            for place, line in lines_of(files, path, low, high, first):
                rows.append((run, place, line.removesuffix(b"\r").decode("utf-8", "replace")))
                if len(rows) == ROWS:
                    yield ready()
        if rows:
            yield ready()


class GrowingLogs(DataSource):
    """``spark.readStream.format("growing_logs").load(path)``: ``run_id, line_no, value``.

    One file a run, named by it (``run="folder"``: the files of a run in a folder named by
    it). ``line_no`` is the line's place in its file. A line that is still being written
    waits for its end. The offset has a number for each file, so it grows with the runs that
    are kept in the folder, not with their lines.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return "run_id string, line_no bigint, value string"

    def streamReader(self, schema) -> GrowingReader:  # noqa: ANN001
        return GrowingReader(self.options)


def growing_logs(spark: SparkSession, path: str, suffix: str = "", by_folder: bool = False) -> DataFrame:
    """Stream of the lines of growing files; see :class:`GrowingLogs`."""
    spark.dataSource.register(GrowingLogs)
    reader = spark.readStream.format("growing_logs").option("suffix", suffix)
    return reader.option("run", "folder" if by_folder else "file").load(path)
