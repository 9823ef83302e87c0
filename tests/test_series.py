"""Series texts: valid, invalid and golden ones."""

import os
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from posewatch.functions.units import convert_rmsd
from posewatch.operators import score
from posewatch.operators.integrity import provenance_check
from posewatch.sources import series
from posewatch.sources.files import read_transformations

# A folder ``reference`` with five published series and its provenance beside it.
GOLDEN = os.environ.get("GOLDEN_SERIES_DIR")
INVALID = {
    "empty": (b"", "no_samples"),
    "comments": (b"# a\n@ b\n", "no_samples"),
    "text": (b"0 value", "non_numeric"),
    "nan": (b"0 nan", "non_finite"),
    "inf": (b"0 inf", "non_finite"),
    "huge": (b"0 1e999", "non_finite"),
    "negative": (b"0 -0.1", "negative_rmsd"),
    "three": (b"0 0.1 2", "column_count"),
    "one": (b"0", "column_count"),
    "falling": (b"10 0.1\n5 0.2", "time_not_increasing"),
    "equal": (b"0 0.1\n0 0.2", "time_not_increasing"),
    "utf8": (b"0.0 0.1\n\xff", "not_utf8"),
    "suffix": (b"0 1d", "non_numeric"),
    "hex": (b"0 0x1p3", "non_numeric"),
}


def scan(spark, cases):
    data = [(name, bytearray(text)) for name, text in cases.items()]
    return series.scan_series(spark.createDataFrame(data, "path string, content binary"))


def test_invalid_texts(spark):
    found = dict(
        rows(scan(spark, {k: v[0] for k, v in INVALID.items()}).select("path", "file_reason").distinct())
    )
    assert found == {k: v[1] for k, v in INVALID.items()}
    assert series.accepted(scan(spark, {k: v[0] for k, v in INVALID.items()})).count() == 0


def test_quarantine_names_the_line(spark):
    got = rows(series.quarantine(scan(spark, {"a": b"# c\n0 0.1\n1 x\n2 0.3\n", "u": b"\xff"})), "path")
    assert got == [("a", 3, "non_numeric"), ("u", None, "not_utf8")]


def test_valid_texts(spark):
    text = b'# comment\n@ title "RMSD"\n0 0.10\r\n10 0.25\r  20\t0.20  \n30 1_0.5e-1'
    got = rows(series.accepted(scan(spark, {"ok": text})), "line_no")
    assert [r[1:] for r in got] == [(3, 0.0, 0.10), (4, 10.0, 0.25), (5, 20.0, 0.20), (6, 30.0, 1.05)]


@pytest.mark.skipif(not GOLDEN, reason="GOLDEN_SERIES_DIR is not set")
def test_golden_series(spark):
    files = series.read_files(spark, GOLDEN, "*.xvg")
    samples = (
        series.accepted(series.scan_series(files))
        .withColumn("run_id", F.lit("r"))
        .withColumn("pose_id", F.lit("p"))
        .withColumn("replica_id", F.regexp_extract("path", r"(replica_\d+)", 1))
    )
    assert samples.count() == 5 * 501
    maxima = rows(score.replica_maxima(samples).select("replica_id", "max_rmsd_angstrom", "time_ps"), "replica_id")
    expected = [4.872631, 2.629156, 2.638972, 2.343307, 2.827962]
    assert [m[1] for m in maxima] == pytest.approx(expected, abs=1e-12)
    assert [m[2] for m in maxima] == [1950.0, 2850.0, 360.0, 1920.0, 1600.0]
    poses = spark.createDataFrame([("r", "p", 5, False)], "run_id string, pose_id string, n_replicas_requested int, pruned boolean")
    goal = spark.createDataFrame([("r", "p", 4.872631)], "run_id string, pose_id string, expected_md_score_angstrom double")
    assert score.golden_check(score.pose_scores(samples, poses), goal).first()["within_tolerance"]


@pytest.mark.skipif(not GOLDEN, reason="GOLDEN_SERIES_DIR is not set")
def test_golden_digests(spark):
    root = Path(GOLDEN).parent
    entries = read_transformations(spark, str(root / "provenance" / "transformations.json"))
    digests = series.read_files(spark, GOLDEN, "*.xvg").select(
        F.concat(F.lit("reference/"), F.element_at(F.split("path", "/"), -1)).alias("destination"),
        series.numeric_digest(F.col("content").cast("string")).alias("numeric_sha256"),
    )
    checked = provenance_check(digests, entries)
    assert checked.count() == 5
    assert checked.filter("failure IS NOT NULL").count() == 0


def test_units(spark):
    one = spark.range(1).select(F.lit(0.4).alias("v"))
    assert one.select(convert_rmsd(F.col("v"), "nm", "angstrom")).first()[0] == 4.0
    assert one.select(convert_rmsd(F.lit(4.0), "angstrom", "nm")).first()[0] == 0.4
    assert one.select(convert_rmsd(F.col("v"), "nm", "nm")).first()[0] == 0.4
    with pytest.raises(ValueError):
        convert_rmsd(F.col("v"), "pm", "nm")
    with pytest.raises(Exception, match="unsupported RMSD unit"):
        one.select(convert_rmsd(F.col("v"), F.lit("pm"), "nm")).collect()


def test_series_folder_roundtrip(spark, tmp_path):
    samples = spark.createDataFrame(
        [("r", f"p{i % 3}", f"replica_0{i % 2}", float(i), i / 10) for i in range(60)],
        "run_id string, pose_id string, replica_id string, time_ps double, rmsd_nm double",
    )
    path = str(tmp_path / "series")
    series.write_angstrom_series(samples, path, buckets=4)
    back = series.read_angstrom_series(spark, path)
    assert back.count() == 60
    assert back.agg(F.max("rmsd_angstrom")).first()[0] == 59.0
