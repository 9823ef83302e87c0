"""Series files in byte ranges against the scan of whole files."""

import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from posewatch.sources import lines, series


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        spark.conf.unset(key)


def series_text(draw, n, faults, end):
    out, t = ["# title", "@ legend"], 0.0
    for i in range(n):
        t += draw.choice([0.5, 1.0])
        out.append(f"{t} {draw.randint(0, 900) / 1000}")
        if i in faults:
            out.append({"late": f"{t} 0.1", "text": "x y", "three": f"{t + 0.1} 1 2", "inf": f"{t + 0.1} inf"}[faults[i]])
        if draw.random() < 0.05:
            out += ["", "   ", "# note"]
    return end.join(out) + (end if n % 2 else "")


def names(df, *columns):
    return rows(df.select(F.element_at(F.split("path", "/"), -1).alias("f"), *columns), "f", *columns)


def test_ranges_equal_whole_files(spark, tmp_path, small_ranges):
    draw = random.Random(11)
    kinds = ["late", "text", "three", "inf"]
    for k in range(24):
        n = draw.choice([0, 1, 5, 60, 300])
        faults = {draw.randrange(n): kinds[k % 4] for _ in range(k % 3)} if n else {}
        body = series_text(draw, n, faults, ["\n", "\r\n", "\r"][k % 3])
        (tmp_path / f"s{k:02d}.xvg").write_bytes(body.encode())
    (tmp_path / "empty.xvg").write_bytes(b"")
    (tmp_path / "broken.xvg").write_bytes(b"0 0.1\n1 \xff\xfe\n0 0.2\n")
    # In small ranges nearly every order fault of this one lies on a border.
    (tmp_path / "equal.xvg").write_bytes(b"".join(b"%d 0.1234567890123\n" % (i // 37) for i in range(600)))
    found = lines.scan(spark, str(tmp_path), "*.xvg")
    assert found.blocks.where("block > 0").count() > 20
    whole = series.scan_series(series.read_files(spark, str(tmp_path), "*.xvg"))
    assert names(lines.quarantine(found), "line_no", "reason") == names(series.quarantine(whole), "line_no", "reason")
    assert names(lines.accepted(found), "time_ps", "rmsd_nm") == names(series.accepted(whole), "time_ps", "rmsd_nm")
    assert names(found.files, "file_reason") == names(whole.select("path", "file_reason").distinct(), "file_reason")


def test_a_file_beyond_a_binary_cell(spark, tmp_path):
    comment = b"#" * (1 << 20) + b"\n"
    try:
        with open(tmp_path / "big.xvg", "wb") as f:
            f.write(b"0 0.1\n")
            for _ in range(2060):
                f.write(comment)
            f.write(b"1 0.9\n")
        assert os.path.getsize(tmp_path / "big.xvg") > series.BINARY_CELL_LIMIT
        found = lines.scan(spark, str(tmp_path))
        assert found.blocks.count() >= 8
        good = lines.accepted(found)
        assert good.agg(F.count("*"), F.max("rmsd_nm"), F.max("time_ps")).first()[:] == (2, 0.9, 1.0)
    finally:
        os.truncate(tmp_path / "big.xvg", 0)


def test_all_tasks_read_one_file(spark, tmp_path):
    with open(tmp_path / "one.xvg", "w") as f:
        for i in range(400_000):
            f.write(f"{i} 0.{i % 1000:03d}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(500_000))
    try:
        found = lines.scan(spark, str(tmp_path))
        assert found.blocks.count() >= 8
        good = lines.accepted(found)
        assert good.agg(F.count("*"), F.max("rmsd_nm")).first()[:] == (400_000, 0.999)
        assert lines.quarantine(found).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
