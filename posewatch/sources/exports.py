"""Exports of a run as files, published all together or not at all.

An export is a folder of its own. Tasks write the files of their runs below a folder of
their attempt; the writer's commit keeps one attempt per task, its abort removes all, and
a killed job leaves only a folder that nothing points to. ``publish`` adds the artifact
manifest and the checksums and then replaces the pointer ``CURRENT`` in one step, so a
reader has the whole last export or the whole new one. The driver handles one message a
task, never a list of files.

A file lies in one task, which streams it. A table that may be too long for that is cut
into numbered files by ``rows_per_file``.
"""

from __future__ import annotations

import csv
import hashlib
import io
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSelector, FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from posewatch.operators import prefix
from posewatch.sources.growing import _store as store_of

# Names of the manifest files.
MANIFEST, CHECKSUMS, POINTER = "artifact_manifest.csv", "checksums.sha256", "CURRENT"
_LISTED = "run_id string, path string, size_bytes long, sha256 string"
_LIST = "listing.csv"


@dataclass
class _Task(WriterCommitMessage):
    part: int
    attempt: str


class _Open:
    """A file that is being written, with its size and digest."""

    def __init__(self, store: FileSystem, path: str):
        store.create_dir(path.rpartition("/")[0])
        self.stream, self.size, self.digest = store.open_output_stream(path), 0, hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.digest.update(data)
        self.size += len(data)


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def _plain(column: pa.Array) -> pa.Array:
    """Values as Python's ``str`` has them; nulls stay."""
    if pa.types.is_string(column.type) or pa.types.is_integer(column.type):
        return column.cast(pa.large_string())
    if pa.types.is_boolean(column.type):
        return pc.if_else(column, _text("True"), _text("False"))
    return pa.array([None if x is None else str(x) for x in column.to_pylist()], pa.large_string())


def _field(column: pa.Array) -> pa.Array:
    """Values as fields that ``csv.writer`` writes: quoted where they must be, nulls empty."""
    out = _plain(column).fill_null("")
    if pa.types.is_integer(column.type) or pa.types.is_boolean(column.type):
        return out
    whole = out.buffers()[2]
    whole = whole.to_pybytes() if whole is not None else b""
    if not any(mark in whole for mark in b'",\r\n'):
        return out
    marked = pc.match_substring_regex(out, '[",\r\n]')
    return pc.if_else(marked, pc.binary_join_element_wise(_text('"'), pc.replace_substring(out, '"', '""'), _text('"'), _text("")), out)


class _Writer(DataSourceArrowWriter):
    """Rows come sorted by file: (run_id, file, then the fields)."""

    def __init__(self, options: dict, fields: list[str]):
        self.root, self.lines, self.fields = options["path"], options["kind"] == "lines", fields

    def _rows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the rows, and where each begins."""
        columns = batch.columns[2:]
        if self.lines:
            rows = pc.binary_join_element_wise(_plain(columns[0]).fill_null("None"), _text(""), _text("\n"))
        else:
            fields = [_field(x) for x in columns]
            if len(fields) == 1:  # an empty line would be no row
                fields = [pc.if_else(pc.equal(fields[0], _text("")), _text('""'), fields[0])]
            rows = pc.binary_join_element_wise(pc.binary_join_element_wise(*fields, _text(",")), _text(""), _text("\r\n"))
        rows = rows.cast(pa.large_binary())
        data = rows.buffers()[2]
        return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.frombuffer(rows.buffers()[1], np.int64)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        store, root = store_of(self.root)
        attempt = f"{task.partitionId():05d}-{task.taskAttemptId()}"
        base = f"{root}/_attempts/{attempt}"
        store.create_dir(base)
        name, current, listed = None, None, []

        def close() -> None:
            if current is not None:
                current.stream.close()
                listed.append([name[0], name[1], current.size, current.digest.hexdigest()])

        for batch in iterator:
            data, starts = self._rows(batch)
            low = 0
            for high in np.union1d(*(pc.run_end_encode(batch.column(i)).run_ends.to_numpy() for i in range(2))).tolist():
                found = (batch.column(0)[low].as_py(), batch.column(1)[low].as_py())
                if found != name:
                    close()
                    name, current = found, _Open(store, f"{base}/{found[0]}/{found[1]}")
                    if not self.lines:
                        out = io.StringIO(newline="")
                        csv.writer(out).writerow(self.fields)
                        current.write(out.getvalue().encode())
                current.write(data[starts[low] : starts[high]].tobytes())
                low = high
        close()
        out = io.StringIO(newline="")
        csv.writer(out).writerows(listed)
        with store.open_output_stream(f"{base}/{_LIST}") as f:
            f.write(out.getvalue().encode())
        return _Task(task.partitionId(), attempt)

    def commit(self, messages: list[_Task | None]) -> None:
        store, root = store_of(self.root)
        for m in filter(None, messages):
            store.move(f"{root}/_attempts/{m.attempt}", f"{root}/part-{m.part:05d}")
        store.delete_dir(f"{root}/_attempts")

    def abort(self, messages: list[_Task | None]) -> None:
        store, root = store_of(self.root)
        if store.get_file_info(FileSelector(root, allow_not_found=True)):
            store.delete_dir(root)


class RunFiles(DataSource):
    """Sink of (run_id, file, fields); options path and kind (csv, lines)."""

    @classmethod
    def name(cls) -> str:
        return "run_files"

    def schema(self) -> str:
        return "run_id string, file string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, schema.names[2:])


class Export:
    """One export of runs below ``root``; nothing is visible before ``publish``."""

    def __init__(self, spark: SparkSession, root: str):
        spark.dataSource.register(RunFiles)
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = f"{self.root}/export-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def _write(self, df: DataFrame, kind: str, name: str, fields: list[Column | str], order: Sequence[str], rows_per_file: int | None) -> None:
        file = F.lit(name)
        if rows_per_file:
            df = prefix.scan(df, ["run_id"], list(order), "number", "__number")
            part = F.floor((F.col("__number") - 1) / rows_per_file).cast("long")
            stem, dot, end = name.rpartition(".")
            file = F.when(part == 0, name).otherwise(F.concat(F.lit(f"{stem}-"), F.lpad(part.cast("string"), 5, "0"), F.lit(dot + end)))
        # A given number of tasks: few large files would be put together into fewer.
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = df.withColumn("__file", file).repartition(tasks, "run_id", "__file").sortWithinPartitions("run_id", "__file", *order)
        out = placed.select(F.col("run_id").alias("__run"), F.col("__file").alias("file"), *fields)
        label = f"table-{len(self.tables)}"
        self.tables.append(label)
        out.write.format("run_files").mode("append").option("kind", kind).save(f"{self.folder}/{label}")

    def csv(self, df: DataFrame, name: str, fields: Sequence[str], order: Sequence[str], rows_per_file: int | None = None) -> None:
        """A CSV file per run with a header; nulls are empty, rows in the given order."""
        self._write(df, "csv", name, list(fields), order, rows_per_file)

    def lines(self, df: DataFrame, name: str, order: Sequence[str]) -> None:
        """A text file per run from the column ``line``."""
        self._write(df, "lines", name, ["line"], order, None)

    def files(self) -> DataFrame:
        """(run_id, path, size_bytes, sha256) of what has been written so far."""
        return listed(self.spark, self.folder)

    def publish(self) -> str:
        """Add the artifact manifest and the checksums of each run, then point to this export."""
        files = self.files()
        self.csv(files, MANIFEST, ["path", "size_bytes", "sha256"], ["path"])
        self.lines(files.withColumn("line", F.concat("sha256", F.lit("  "), "path")), CHECKSUMS, ["path"])
        store, root = store_of(self.root)
        with store.open_output_stream(f"{root}/{POINTER}.new") as f:
            f.write(self.folder.rpartition("/")[2].encode())
        store.move(f"{root}/{POINTER}.new", f"{root}/{POINTER}")
        return self.folder


def listed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_LISTED).csv(f"{folder}/*/*/{_LIST}")


def current(root: str) -> str:
    """Folder of the export that was published last."""
    store, base = store_of(root.rstrip("/"))
    with store.open_input_stream(f"{base}/{POINTER}") as f:
        return f"{root.rstrip('/')}/{f.read().decode()}"


def read_csv(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """Rows of one table over all runs of an export."""
    stem, dot, end = name.rpartition(".")
    files = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return files.csv(f"{folder}/table-*/part-*/*/{stem}*{dot}{end}")


def read_lines(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(run_id, line) of one text file over all runs of an export."""
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return spark.read.text(f"{folder}/table-*/part-*/*/{name}").select(run.alias("run_id"), F.col("value").alias("line"))
