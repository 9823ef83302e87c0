"""Files that grow while a stream watches them."""

from collections import Counter

import pytest
from conftest import rows

from posewatch.sources import growing
from posewatch.streaming import monitor


def read(spark, folder, log, **more):
    found = monitor.run_changelog(growing.appended_samples(spark, str(folder), "*.xvg", **more), "append", log)
    return found.select("path", "at", "time_ps", "rmsd_nm", "reason", monitor.BATCH)


@pytest.mark.parametrize("range_bytes", [5, 1 << 20])
def test_three_growths_give_each_line_once(spark, tmp_path, range_bytes):
    folder, log = tmp_path / "run", str(tmp_path / "log")
    folder.mkdir()
    a, b = folder / "a.xvg", folder / "b.xvg"
    (folder / "notes.txt").write_text("9 9\n")
    steps = [
        {a: b"# c\n0 0.1\n1 0.", b: b""},  # the second line is not finished
        {a: b"2\r\n2 0.3\n", b: b"0 0.5"},
        {a: b"3 x\n", b: b"\n1 0.6\n2 0.7\n"},
    ]
    whole = Counter()
    for n, step in enumerate(steps):
        for path, more in step.items():
            with open(path, "ab") as f:
                f.write(more)
        got = read(spark, folder, log, range_bytes=range_bytes)  # each call is a restart
        whole = Counter((r.path[-5:], r.time_ps, r.rmsd_nm, r.reason) for r in got.collect())
        assert max(whole.values()) == 1
        if n == 0:
            assert set(whole) == {("a.xvg", 0.0, 0.1, None)}
    assert set(whole) == {
        ("a.xvg", 0.0, 0.1, None), ("a.xvg", 1.0, 0.2, None), ("a.xvg", 2.0, 0.3, None), ("a.xvg", 3.0, None, "non_numeric"),
        ("b.xvg", 0.0, 0.5, None), ("b.xvg", 1.0, 0.6, None), ("b.xvg", 2.0, 0.7, None),
    }
    again = read(spark, folder, log, range_bytes=range_bytes)
    assert again.count() == 7 and len({r[0] for r in again.select(monitor.BATCH).collect()}) == 3


def test_only_new_bytes_are_read(tmp_path):
    """Ranges cover what lies between two offsets, and a file that shrank from its start."""
    (tmp_path / "s.xvg").write_bytes(b"0 1\n" * 10)
    reader = growing._Appended({"path": str(tmp_path), "rangeBytes": "16"})
    first = reader.latestOffset()
    with open(tmp_path / "s.xvg", "ab") as f:
        f.write(b"1 2\n" * 5)
    second = reader.latestOffset()
    parts = reader.partitions(first, second)
    assert [(p.low, p.high) for p in parts] == [(40, 56), (56, 60)]
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 5
    assert [(p.low, p.high) for p in reader.partitions(second, dict.fromkeys(second, 8))] == [(0, 8)]
    assert reader.partitions(second, second) == []


def test_overlapping_samples_of_growing_files(spark, tmp_path):
    """Lines of a growing file feed the watch of its replica."""
    folder, log = tmp_path / "run", str(tmp_path / "log")
    folder.mkdir()
    from pyspark.sql import functions as F

    for lo in (0, 50, 100):
        with open(folder / "r1.xvg", "ab") as f:
            f.write(b"".join(b"%d 0.%03d\n" % (i, i) for i in range(lo, lo + 50)))
        lines = growing.appended_samples(spark, str(folder)).where("reason IS NULL")
        named = lines.select(F.lit("r").alias("run_id"), F.lit("p").alias("pose_id"), F.lit("r1").alias("replica_id"), "time_ps", "rmsd_nm")
        state = monitor.latest(monitor.run_changelog(monitor.replica_state(named), "update", log), ["run_id", "pose_id", "replica_id"])
    assert rows(state.select("samples_observed", "latest_time_ps", "maximum_rmsd_nm")) == [(150, 149.0, 0.149)]
