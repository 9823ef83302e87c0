"""RMSD series files: two numbers per line, ``#`` and ``@`` comments.

A file is one row of the binary source, so a whole series is parsed inside its
row: the line order is the array order and no shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posewatch.functions import text
from posewatch.functions.staging import staged
from posewatch.functions.units import nm_to_angstrom

BINARY_CELL_LIMIT = 2**31 - 1


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of every file below a folder.

    The content of a file that does not fit a binary cell is null; the scan rejects
    it as ``too_large``.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    fits = F.col("length") <= BINARY_CELL_LIMIT
    return files.filter(fits).select("path", "content").unionByName(
        files.filter(~fits).select("path", F.lit(None).cast("binary").alias("content"))
    )


def data_lines(content_text: Column, line_end: str) -> Column:
    """Array of (line_no, stripped line) without blanks and comments."""
    lines = F.transform(
        F.split(content_text, line_end),
        lambda line, i: F.struct((i + 1).alias("line_no"), text.strip(line).alias("line")),
    )
    return F.filter(lines, lambda item: ~text.is_comment(item["line"]))


def parsed_lines(lines: Column) -> Column:
    """Array of (line_no, time_ps, rmsd_nm, reason); each line is split and parsed once."""
    worded = F.transform(
        lines,
        lambda x: F.struct(x["line_no"].alias("line_no"), text.words(x["line"]).alias("w")),
    )

    def valued(x: Column) -> Column:
        first, second = F.get(x["w"], F.lit(0)), F.get(x["w"], F.lit(1))
        return F.struct(
            x["line_no"].alias("line_no"),
            F.size(x["w"]).alias("n"),
            first.alias("a"),
            second.alias("b"),
            text.parse_float(first).alias("t"),
            text.parse_float(second).alias("r"),
        )

    def checked(x: Column) -> Column:
        return F.struct(
            x["line_no"].alias("line_no"),
            x["t"].alias("time_ps"),
            x["r"].alias("rmsd_nm"),
            text.sample_reason(x["n"], x["a"], x["b"], x["t"], x["r"]).alias("reason"),
        )

    return F.transform(F.transform(worded, valued), checked)


def scan_series(files: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row per data line with its reason to reject; one row per empty file.

    ``file_reason`` is the first fault of the file; a series counts only when it
    is null.
    """
    content = F.col("content")
    parsed = staged(
        files,
        keep,
        __utf8=F.is_valid_utf8(content),
        __rows=parsed_lines(data_lines(content.cast("string"), text.FILE_LINE_END)),
    )

    def in_order(x: Column, i: Column) -> Column:
        before = F.get(F.col("__rows"), i - 1)["time_ps"]
        late = F.when((i > 0) & (x["time_ps"] <= before), "time_not_increasing")
        return F.struct(
            x["line_no"].alias("line_no"),
            x["time_ps"].alias("time_ps"),
            x["rmsd_nm"].alias("rmsd_nm"),
            F.coalesce(x["reason"], late).alias("reason"),
        )

    checked = staged(parsed, [*keep, "__utf8"], __rows=F.transform("__rows", in_order))
    first_fault = F.get(F.filter("__rows", lambda r: r["reason"].isNotNull()), F.lit(0))["reason"]
    judged = checked.withColumn(
        "file_reason",
        F.when(F.col("__utf8").isNull(), "too_large")
        .when(~F.col("__utf8"), "not_utf8")
        .when(F.size("__rows") == 0, "no_samples")
        .otherwise(first_fault),
    )
    return judged.select(*keep, "file_reason", F.explode_outer("__rows").alias("r")).select(
        *keep, "file_reason", "r.line_no", "r.time_ps", "r.rmsd_nm", "r.reason"
    )


def accepted(scan: DataFrame) -> DataFrame:
    return scan.filter(F.col("file_reason").isNull()).drop("file_reason", "reason")


def quarantine(scan: DataFrame) -> DataFrame:
    """Faulty lines, and one row for a file that is faulty as a whole."""
    whole = F.col("file_reason").isin("too_large", "not_utf8", "no_samples") & F.col("line_no").isNull()
    undecodable = F.col("file_reason") == "not_utf8"
    return (
        scan.filter(F.col("reason").isNotNull() | whole | undecodable)
        .withColumn("reason", F.when(undecodable, "not_utf8").otherwise(F.coalesce("reason", "file_reason")))
        .withColumn("line_no", F.when(~undecodable, F.col("line_no")))
        .drop("file_reason", "time_ps", "rmsd_nm")
        .distinct()
    )


def numeric_digest(content_text: Column) -> Column:
    """SHA-256 of the stripped numeric lines, each ended by a line feed."""
    kept = F.transform(data_lines(content_text, text.TEXT_LINE_END), lambda item: item["line"])
    return F.sha2(F.concat(F.array_join(kept, "\n"), F.lit("\n")).cast("binary"), 256)


ANGSTROM_SERIES = (
    "pose_id string, replica_id string, simulation_time_ps double, rmsd_angstrom double, "
    "run_id string, pose_bucket int"
)


def write_angstrom_series(samples: DataFrame, path: str, buckets: int = 256) -> None:
    """(simulation_time_ps, rmsd_angstrom) of every replica below run and pose-bucket folders.

    One folder per replica would be millions of folders. The rebalance step groups
    the rows of a folder into few files and splits a folder that is too large.
    """
    rows = samples.select(
        "pose_id",
        "replica_id",
        F.col("time_ps").alias("simulation_time_ps"),
        nm_to_angstrom(F.col("rmsd_nm")).alias("rmsd_angstrom"),
        "run_id",
        F.pmod(F.xxhash64("pose_id"), F.lit(buckets)).cast("int").alias("pose_bucket"),
    )
    (
        rows.hint("rebalance", "run_id", "pose_bucket")
        .sortWithinPartitions("run_id", "pose_bucket", "pose_id", "replica_id", "simulation_time_ps")
        .write.mode("overwrite")
        .partitionBy("run_id", "pose_bucket")
        .option("header", True)
        .csv(path)
    )


def read_angstrom_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANGSTROM_SERIES).option("header", True).csv(path)
