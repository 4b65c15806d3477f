"""A stream of the lines that are added to growing files.

`line_tail` is a Python data source. Its offset is the size of each file; a
batch reads the byte ranges between two offsets, cut into chunks for tasks, and
nothing else. A line belongs to the range that holds its line feed, so offsets
need not lie at ends of lines, a torn last line waits for the batch that brings
its end, and a line that spans chunks is read by one task.

Files are listed and read through pyarrow: local or mounted folders, and the
stores whose schemes it knows. Workers need no copy of this package on their
path.
"""

from __future__ import annotations

import ast
import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINES = "path string, at long, line string"
BACK = 1 << 16


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def begin_of_line(file, at: int) -> int:
    """Where the line begins that byte `at` is in: after the line feed before it."""
    while at > 0:
        low = max(0, at - BACK)
        found = file.read_at(at - low, low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def lines_of(file, start: int, end: int, most: int = 1 << 22) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the lines whose line feed is in [start, end)."""
    held, place, at = [], None, start
    while at < end:
        piece = file.read_at(min(most, end - at), at)
        if not piece:
            return
        low = 0
        while (stop := piece.find(b"\n", low)) >= 0:
            if place is None:
                place = begin_of_line(file, start)
                if place < start:
                    held.insert(0, file.read_at(start - place, place))
            held.append(piece[low:stop])
            yield place, b"".join(held)
            held, low = [], stop + 1
            place = at + low
        held.append(piece[low:])
        at += len(piece)


class LineTailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix, self.chunk = options["path"], options.get("suffix", ".jsonl"), int(options.get("chunk", 1 << 26))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, path = _store(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(self.suffix)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, size in end.items():
            low = start.get(path, 0)
            low = 0 if size < low else low  # made anew: from its start
            out += [Range(path, at, min(size, at + self.chunk)) for at in range(low, size, self.chunk)]
        return out

    def read(self, partition: Range):
        import pyarrow as pa

        store, _ = _store(self.path)
        try:
            file = store.open_input_file(partition.path)
        except FileNotFoundError:  # gone since it was listed; coverage shows it
            return
        with file:
            rows, held = [], 0
            for place, line in lines_of(file, partition.start, partition.end):
                rows.append((place, line.decode("utf-8", "replace")))
                held += len(line)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows)), pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows])], ["path", "at", "line"])
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows)), pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows])], ["path", "at", "line"])


class LineTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> LineTailReader:
        return LineTailReader(dict(self.options))


def tail_lines(spark: SparkSession, path: str, suffix: str = ".jsonl", chunk: int = 1 << 26) -> DataFrame:
    """A stream of path, at (the line's first byte in its file), line, for whole
    lines of all files below path that end in suffix. A file that is shorter than
    what was read of it is read from its start again; one that was replaced by a
    longer one can't be told from one that grew."""
    spark.dataSource.register(LineTail)
    return spark.readStream.format("line_tail").option("path", path).option("suffix", suffix).option("chunk", chunk).load()


def coverage(spark: SparkSession, progress: dict) -> DataFrame:
    """path, before, size, state of one batch's progress (an entry of a query's
    recentProgress): read, no news, restarted, or gone."""
    source = progress["sources"][0]

    def offset(name: str) -> dict:
        value = source[name]
        if isinstance(value, str):  # JSON, or the dict's own form, by the version of Spark
            try:
                value = json.loads(value)
            except ValueError:
                value = ast.literal_eval(value)
        return value or {}

    start, end = offset("startOffset"), offset("endOffset")
    rows = []
    for path in sorted({*start, *end}):
        before, size = start.get(path), end.get(path)
        state = "gone" if size is None else "no news" if size == before else "restarted" if before is not None and size < before else "read"
        rows.append((path, before, size, state))
    return spark.createDataFrame(rows, "path string, before long, size long, state string")
