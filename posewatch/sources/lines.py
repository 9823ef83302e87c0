"""RMSD series files of any size, scanned line by line in byte ranges.

The text source gives each task a range of a file and the lines that begin there, in
order, so one large file is read by many tasks. A range knows its own line numbers and
time order; one row per range then joins the ranges of a file: lines before it, and the
last time before its first. The samples themselves are written once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posewatch.functions import text
from posewatch.functions.staging import staged
from posewatch.operators.prefix import new_key
from posewatch.session import materialise

_SCANNED = "path string, block long, block_line long, time_ps double, rmsd_nm double, reason string, utf8 boolean, lines long"


class SeriesScan(NamedTuple):
    """``lines``: (path, block, block_line, time_ps, rmsd_nm, reason) of every data line;
    ``blocks``: (path, block, lines_before) of every range; ``files``: (path, file_reason)."""

    lines: DataFrame
    blocks: DataFrame
    files: DataFrame


def parsed(lines: DataFrame, keep: list[str | Column]) -> DataFrame:
    """Time, RMSD and reason of each ``line``; ``data`` is false for blanks and comments."""
    stripped = staged(lines, [*keep, F.is_valid_utf8("line").alias("utf8")], __line=text.strip(F.col("line")))
    names = [c for c in stripped.columns if c != "__line"]
    worded = staged(stripped, names, data=~text.is_comment(F.col("__line")), __w=F.when(~text.is_comment(F.col("__line")), text.words(F.col("__line"))))
    first, second = F.get("__w", F.lit(0)), F.get("__w", F.lit(1))
    valued = staged(
        worded, [*names, "data"],
        n=F.size("__w"), a=first, b=second, time_ps=text.parse_float(first), rmsd_nm=text.parse_float(second),
    )
    reason = text.sample_reason(*map(F.col, ("n", "a", "b", "time_ps", "rmsd_nm")))
    return valued.select(*names, "data", "time_ps", "rmsd_nm", F.when(F.col("data"), reason).alias("reason"))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line numbers and time order inside each range; a row of its own ends a range.

    The row that ends a range has its number of lines and no line number.
    """
    before, count, latest = None, 0, None

    def rows(path, block, line, time, rmsd, reason, utf8, lines):
        return pa.RecordBatch.from_arrays([path, block, line, time, rmsd, reason, utf8, lines], schema=schema)

    schema = pa.schema([
        ("path", pa.string()), ("block", pa.int64()), ("block_line", pa.int64()), ("time_ps", pa.float64()),
        ("rmsd_nm", pa.float64()), ("reason", pa.string()), ("utf8", pa.bool_()), ("lines", pa.int64()),
    ])

    def ends(paths: list, blocks: list, counts: list) -> pa.RecordBatch:
        none = [None] * len(paths)
        return pa.RecordBatch.from_pydict(dict(zip(schema.names, (paths, blocks, none, none, none, none, none, counts))), schema)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        path, block, data, utf8, time, rmsd, reason = batch.columns
        new = new_key([path, block], before, n)
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        line = np.arange(n) - start + 1
        line[start == 0] += 0 if new[0] else count
        first = np.flatnonzero(new)
        closed = [i - 1 for i in first if i] if before is None else [i - 1 for i in first]
        if closed:
            inside = [i for i in closed if i >= 0]
            outer = [(*before, count)] if before is not None and new[0] else []
            done = outer + [(path[i].as_py(), block[i].as_py(), int(line[i])) for i in inside]
            yield ends(*map(list, zip(*done, strict=True)))
        kept = data.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(kept)
        if len(at):
            value = time.to_numpy(zero_copy_only=False)[at]
            previous = np.r_[np.nan, value[:-1]]
            # The first data line of a range in this batch: what was before it?
            own = start[at]
            opens = np.r_[True, own[1:] != own[:-1]]
            previous[opens] = np.nan
            if not new[0] and own[0] == 0 and latest is not None:
                previous[0] = latest
            late = pa.array(value <= previous)
            picked = pa.array(at)
            why = reason.take(picked)
            why = pc.if_else(pc.and_(pc.is_null(why), late), "time_not_increasing", why)
            yield rows(
                path.take(picked), block.take(picked), pa.array(line[at]), time.take(picked), rmsd.take(picked), why,
                utf8.take(picked), pa.nulls(len(at), pa.int64()),
            )
        whole = start == start[-1]
        tail = at[start[at] == start[-1]]
        if len(tail):
            latest = time[int(tail[-1])].as_py()
        elif new[whole].any():
            latest = None
        before, count = [path[n - 1].as_py(), block[n - 1].as_py()], int(line[-1])
    if before is not None:
        yield ends([before[0]], [before[1]], [count])


def scan(spark: SparkSession, path: str, pattern: str = "*") -> SeriesScan:
    """Scan every file below a folder; a file of any size, without reading it whole.

    A byte-order mark at the start of a file is skipped by the text source.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    raw = files.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )
    columns = ["path", "block", "data", "utf8", "time_ps", "rmsd_nm", "reason"]
    found = materialise(parsed(raw, ["path", "block"]).select(*columns).mapInArrow(_in_order, _SCANNED), "series-lines")
    lines = found.where(F.col("block_line").isNotNull())
    # One row per range: hash aggregates of plain numbers.
    samples = lines.groupBy("path", "block").agg(
        F.min("block_line").alias("first_line"),
        F.min_by("time_ps", "block_line").alias("first_time"),
        F.max_by("time_ps", "block_line").alias("last_time"),
    )
    in_file = Window.partitionBy("path").orderBy("block")
    blocks = (
        found.where(F.col("lines").isNotNull()).select("path", "block", "lines")
        .join(samples, ["path", "block"], "left")
        .withColumn("lines_before", F.coalesce(F.sum("lines").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    # Ranges without data lines do not count as the one before.
    border = (
        blocks.where("first_line IS NOT NULL")
        .withColumn("before", F.lag("last_time").over(in_file))
        .where("first_time <= before")
        .select("path", "block", F.col("first_line").alias("block_line"), F.lit("time_not_increasing").alias("border"))
    )
    blocks, border = materialise(blocks, "series-blocks"), materialise(border, "series-borders")
    joined = lines.join(F.broadcast(border) if _few(border) else border, ["path", "block", "block_line"], "left")
    lines = joined.withColumn("reason", F.coalesce("reason", "border")).drop("border", "lines")
    faults = lines.where("reason IS NOT NULL").groupBy("path").agg(
        F.min_by("reason", F.struct("block", "block_line")).alias("fault")
    )
    counted = lines.groupBy("path").agg(F.count("*").alias("n"))
    listed = files.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
    broken = found.where(~F.col("utf8")).select("path", F.lit(True).alias("broken")).distinct()
    verdicts = (
        listed.join(counted, "path", "left").join(faults, "path", "left").join(broken, "path", "left")
        .select("path", F.when(F.col("broken"), "not_utf8").when(F.col("n").isNull(), "no_samples").otherwise(F.col("fault")).alias("file_reason"))
    )
    return SeriesScan(lines.drop("utf8"), blocks.select("path", "block", "lines_before"), materialise(verdicts, "series-files"))


def _few(df: DataFrame, rows: int = 100_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def accepted(found: SeriesScan) -> DataFrame:
    """Samples of the files without any fault."""
    bad = found.files.where("file_reason IS NOT NULL").select("path")
    return found.lines.join(bad, "path", "left_anti").select("path", "block", "block_line", "time_ps", "rmsd_nm")


def quarantine(found: SeriesScan) -> DataFrame:
    """(path, line_no, reason) of faulty lines, and one row for a file faulty as a whole."""
    whole = found.files.where(F.col("file_reason").isin("not_utf8", "no_samples"))
    undecodable = whole.where("file_reason = 'not_utf8'").select("path")
    numbered = (
        found.lines.where("reason IS NOT NULL").join(undecodable, "path", "left_anti")
        .join(found.blocks, ["path", "block"])
        .select("path", (F.col("lines_before") + F.col("block_line")).alias("line_no"), "reason")
    )
    return numbered.unionByName(whole.select("path", F.lit(None).cast("long").alias("line_no"), F.col("file_reason").alias("reason")))
