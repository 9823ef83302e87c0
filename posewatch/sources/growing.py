"""Growing series files as a stream that reads only what was appended.

The offset of the stream is the size of every watched file. A micro-batch reads the bytes
between two offsets, in ranges dealt to tasks, and gives each line to the batch in which
its line end lies; a line that is still being written waits for the next batch. The
offsets alone fix what a batch reads, so a restart or a replay gives each line once.

The offset has one entry per file. Watch one run's folder with one stream, so that it
stays as small as the run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from posewatch.sources.lines import parsed

RANGE = 64 << 20
LOOK_BACK = 4096
BATCH_LINES = 10_000
_LINES = "path string, at long, line string"


def _store(uri: str) -> tuple[FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(quote(uri, safe=":/"))


@dataclass
class _Range(InputPartition):
    path: str
    low: int
    high: int


class _Appended(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*")
        self.range = int(options.get("rangeBytes", RANGE))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = _store(self.root)
        found = store.get_file_info(FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in found if f.type == FileType.File and fnmatch(f.base_name, self.pattern)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for path, high in sorted(end.items()):
            low = start.get(path, 0)
            low = low if low <= high else 0  # a file that got shorter was written anew
            out += [_Range(path, at, min(at + self.range, high)) for at in range(low, high, self.range)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.root)
        with store.open_input_file(partition.path) as f:
            begin = self._line_start(f, partition.low)
            f.seek(begin)
            data = f.read(partition.high - begin)
        stop = data.rfind(b"\n") + 1
        if begin + stop <= partition.low:
            return  # no line ends in this range
        at, rows = begin, []
        for line in data[:stop].split(b"\n")[:-1]:
            rows.append((partition.path, at, line.removesuffix(b"\r")))
            at += len(line) + 1
        for lo in range(0, len(rows), BATCH_LINES):
            paths, places, lines = zip(*rows[lo : lo + BATCH_LINES], strict=True)
            text = pa.array([x.decode("utf-8", "replace") for x in lines])
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(places, pa.int64()), text], ["path", "at", "line"])

    @staticmethod
    def _line_start(f: pa.NativeFile, low: int) -> int:
        """Where the line begins that the byte before `low` belongs to, or `low` after a line end."""
        high = low
        while high:
            lo = max(0, high - LOOK_BACK)
            f.seek(lo)
            found = f.read(high - lo).rfind(b"\n")
            if found >= 0:
                return lo + found + 1
            high = lo
        return 0

    def commit(self, end: dict) -> None:
        pass


class AppendedLines(DataSource):
    """Complete lines (path, at, line) appended to files; options path, pattern, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return _LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Appended(self.options)


def appended_lines(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE) -> DataFrame:
    """Stream of the complete lines that are appended to the files below a folder."""
    spark.dataSource.register(AppendedLines)
    reader = spark.readStream.format("appended_lines").option("pattern", pattern).option("rangeBytes", range_bytes)
    return reader.load(path)


def appended_samples(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE) -> DataFrame:
    """Stream of data lines: (path, at, time_ps, rmsd_nm, reason to reject)."""
    found = parsed(appended_lines(spark, path, pattern, range_bytes), ["path", "at"])
    return found.where("data").drop("data", "utf8")
