"""Streams fed in several files must end where the batch operators end."""

import random
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from posewatch.operators import pruning
from posewatch.operators.score import REPLICA_KEY
from posewatch.streaming import monitor

SAMPLE = "run_id string, pose_id string, replica_id string, time_ps double, rmsd_nm double"
POSE = "run_id string, pose_id string, pruning_threshold_angstrom double"


def land(spark, tmp_path, schema, *parts):
    """One parquet file per part, with rising modification times."""
    import os

    folder = tmp_path / "landing"
    folder.mkdir(parents=True)
    for i, part in enumerate(parts):
        target = folder / f"part-{i:03d}.parquet"
        spark.createDataFrame(part, schema).toPandas().to_parquet(target, index=False)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def stream(spark, path, schema, files=1):
    return monitor.parquet_stream(spark, path, spark.createDataFrame([], schema).schema, files)


def test_overlapping_snapshots(spark, tmp_path):
    one = [("r", "p", "a", 0.0, 0.1), ("r", "p", "a", 10.0, 0.3)]
    two = [*one, ("r", "p", "a", 20.0, 0.41)]
    path = land(spark, tmp_path, SAMPLE, one, two)
    poses = spark.createDataFrame([("r", "p", 4.0)], POSE)
    log = monitor.run_changelog(monitor.deduplicated(stream(spark, path, SAMPLE)), "append")
    assert rows(log.select("time_ps"), "time_ps") == [(0.0,), (10.0,), (20.0,)]
    newer = monitor.newer_samples(stream(spark, path, SAMPLE))
    assert rows(newer.select("time_ps", monitor.BATCH), "time_ps") == [(0.0, 0), (10.0, 0), (20.0, 1)]
    state = monitor.latest(monitor.run_changelog(monitor.replica_state(stream(spark, path, SAMPLE))), REPLICA_KEY)
    row = state.first()
    assert (row.samples_observed, row.latest_time_ps, row.maximum_rmsd_angstrom) == (3, 20.0, pytest.approx(4.1))
    triggers = monitor.run_changelog(monitor.replica_triggers(stream(spark, path, SAMPLE), poses))
    assert [(r.trigger_simulation_time_ps, r.code) for r in monitor.pruning_events(triggers).collect()] == [(20.0, "POSE_PRUNED")]


def test_trigger_moves_earlier(spark, tmp_path):
    path = land(spark, tmp_path, SAMPLE, [("r", "p", "r01", 30.0, 0.5)], [("r", "p", "r02", 20.0, 0.45)])
    poses = spark.createDataFrame([("r", "p", 4.0)], POSE)
    log = monitor.run_changelog(monitor.triggers(stream(spark, path, SAMPLE), poses))
    reports = monitor.run_changelog(monitor.replica_triggers(stream(spark, path, SAMPLE), poses))
    assert rows(monitor.pruning_events(reports).select("code", "trigger_replica_id"), "code") == [
        ("POSE_PRUNED", "r01"), ("PRUNING_TRIGGER_OBSERVED", "r02")]
    row = monitor.latest(log, ["run_id", "pose_id"]).first()
    assert (row.trigger_replica_id, row.max_crossing_angstrom) == ("r02", 5.0)


def test_every_replica_reports_once(spark, tmp_path):
    """Three replicas cross in one batch and cross again in the next."""
    first = [("r", "p", f"r0{i}", 30.0 - i, 0.5) for i in (1, 2, 3)]
    path = land(spark, tmp_path, SAMPLE, first, [(*x[:3], 40.0, 0.6) for x in first])
    poses = spark.createDataFrame([("r", "p", 4.0)], POSE)
    reports = monitor.run_changelog(monitor.replica_triggers(stream(spark, path, SAMPLE), poses))
    got = rows(monitor.pruning_events(reports).select("trigger_replica_id", "trigger_simulation_time_ps", "code"), "trigger_replica_id")
    assert got == [("r01", 29.0, "PRUNING_TRIGGER_OBSERVED"), ("r02", 28.0, "PRUNING_TRIGGER_OBSERVED"), ("r03", 27.0, "POSE_PRUNED")]


def test_random_splits_equal_batch(spark, tmp_path):
    rng = random.Random(5)
    data = [("r", f"p{i % 3}", f"r{i % 7 % 4}", float(i), rng.randint(0, 600) / 1000) for i in range(400)]
    parts = [[] for _ in range(4)]
    for d in data:
        parts[rng.randrange(4)].append(d)
    path = land(spark, tmp_path, SAMPLE, *parts)
    batch = spark.createDataFrame(data, SAMPLE)
    poses = spark.createDataFrame([("r", "p0", 5.5), ("r", "p1", 5.9), ("r", "p2", None)], POSE)
    hits = pruning.crossings(batch, poses)
    log = monitor.run_changelog(monitor.triggers(stream(spark, path, SAMPLE), poses))
    want = rows(pruning.canonical_trigger(hits), "pose_id")
    assert rows(monitor.latest(log, ["run_id", "pose_id"]).select(*pruning.canonical_trigger(hits).columns), "pose_id") == want
    seen = batch.filter("time_ps < 300")
    live = pruning.canonical_trigger(pruning.crossings(seen, poses))
    merged = monitor.caught_up_triggers(live, batch.filter("time_ps >= 300"), poses)
    assert rows(merged.select(*pruning.canonical_trigger(hits).columns), "pose_id") == want


def test_failure_runs_span_batches(spark, tmp_path):
    schema = "k string, n bigint, failed boolean"
    flags = {"a": "FFSFFFFSFF", "b": "FFFSSSSSSS", "c": "SFSFSFSFSF"}
    data = [(k, i, f == "F") for k, text in flags.items() for i, f in enumerate(text)]
    parts = [[d for d in data if lo <= d[1] < lo + 2] for lo in range(0, 10, 2)]
    path = land(spark, tmp_path, schema, *parts)
    got = rows(monitor.failure_runs(stream(spark, path, schema), ["k"], "n", 3), "k", "first_failure")
    assert got == [("a", 2, 4, 3, 6), ("b", None, 3, 0, 2)]
    log = str(tmp_path / "runs")
    first = land(spark, tmp_path / "again", schema, *parts[:2])
    monitor.failure_runs(stream(spark, first, schema), ["k"], "n", 3, log)
    for i, part in enumerate(parts[2:]):
        spark.createDataFrame(part, schema).toPandas().to_parquet(f"{first}/z{i}.parquet", index=False)
    again = monitor.failure_runs(stream(spark, first, schema), ["k"], "n", 3, log)
    assert rows(again, "k", "first_failure") == [("a", 2, 4, 3, 6), ("b", None, 3, 0, 2)]
    batch = pruning.consecutive_failures(spark.createDataFrame(data, schema), ["k"], "n", 3)
    assert rows(batch, "k", "first_failure") == [("a", 2, 4, 3, 6), ("b", None, 3, 0, 2)]


def test_export_is_exactly_once(spark, tmp_path):
    schema = "run_id string, sequence bigint, code string"
    path = land(spark, tmp_path, schema, [("r", 1, "A"), ("r", 2, "B")], [("r", 2, "B"), ("r", 3, "C"), ("r", 3, "C")])
    log = str(tmp_path / "log")
    monitor.export_events(stream(spark, path, schema), log)
    assert rows(spark.read.parquet(log).select("sequence"), "sequence") == [(1,), (2,), (3,)]
    spark.createDataFrame([("r", 1, "A"), ("r", 4, "D")], schema).toPandas().to_parquet(f"{path}/later.parquet", index=False)
    monitor.export_events(stream(spark, path, schema), log)
    assert rows(spark.read.parquet(log).select("sequence"), "sequence") == [(1,), (2,), (3,), (4,)]


def test_state_rows_are_replicas(spark, tmp_path):
    """Four growing snapshots of many samples: one state row a replica, equal to batch."""
    data = [("r", f"p{i % 3}", f"r{i % 2}", float(i), (i * 37 % 101) / 100) for i in range(600)]
    path = land(spark, tmp_path, SAMPLE, *[data[max(0, n - 200) : n] for n in (150, 300, 450, 600)])
    log = str(tmp_path / "state")
    found = monitor.latest(monitor.run_changelog(monitor.replica_state(stream(spark, path, SAMPLE)), "update", log), REPLICA_KEY)
    poses = spark.createDataFrame([("r", f"p{i}", 5.0) for i in range(3)], POSE)
    batch = spark.createDataFrame(data, SAMPLE)
    want = pruning.observation_summary(batch, poses, batch.select(*REPLICA_KEY).distinct())
    columns = [*REPLICA_KEY, "samples_observed", "latest_time_ps", "maximum_rmsd_nm"]
    assert rows(found.select(*columns), *REPLICA_KEY) == rows(want.select(*columns), *REPLICA_KEY)
    state = spark.read.format("statestore").option("stateVarName", "watch").load(f"{log}/_checkpoint")
    assert state.count() == 6


def test_export_keeps_intervals_and_not_the_log(spark, tmp_path):
    schema = "run_id string, sequence bigint, code string"
    parts = [[("r", i, "A") for i in range(lo, lo + 300)] + [("s", 70_000 + lo, "B"), (None, lo, "C")] for lo in (0, 200, 600)]
    path = land(spark, tmp_path, schema, *parts)
    log = str(tmp_path / "log")
    monitor.export_events(stream(spark, path, schema), log)
    got = rows(spark.read.parquet(log).groupBy("run_id").agg(F.count("*"), F.count_distinct("sequence")), "run_id")
    assert got == [(None, 3, 3), ("r", 800, 800), ("s", 3, 3)]
    state = spark.read.format("statestore").option("stateVarName", "done").load(f"{log}/_checkpoint")
    kept = {tuple(r.key): r.value["intervals"] for r in state.collect()}
    assert kept[("r", 0)] == "[[0, 600], [499, 899]]" and len(kept) == 3


def test_series_files_as_a_stream(spark, tmp_path):
    folder = tmp_path / "xvg"
    folder.mkdir()
    (folder / "a.xvg").write_text("# c\n0 0.1\n10 0.2\n")
    (folder / "b.xvg").write_text("0 0.1\n0 0.2\n")
    got = monitor.run_changelog(monitor.series_file_stream(spark, str(folder)), "append")
    assert rows(got.select(F.element_at(F.split("path", "/"), -1), "time_ps"), "time_ps") == [("a.xvg", 0.0), ("a.xvg", 10.0)]


def many_files(spark, folder, n=40_000):
    """Events in a file of several row groups, which a scan of small splits reads in many tasks."""
    rows_ = spark.range(n).selectExpr(
        "id AS event_id", "timestamp_micros(id * 1000) AS ts", "id % 3 AS user_id",
        "CASE WHEN id DIV 3 % 5 < 4 THEN 'error' ELSE 'view' END AS event_type",
        "CAST(id % 977 AS DOUBLE) AS value", "'{}' AS props",
    )
    rows_.toPandas().to_parquet(
        folder / "events.parquet", index=False, row_group_size=n // 13, coerce_timestamps="us", allow_truncated_timestamps=True
    )
    return str(folder)


@pytest.mark.parametrize("name", ["stream_failures", "stream_dedup", "stream_maximum"])
def test_parts_of_many_files_arrive_in_order(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as contract

    sf = many_files(spark, tmp_path)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        found = contract.queries()[name](spark, sf)
        found = sorted(map(tuple, found.select(*sorted(found.columns)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    columns = ", ".join(sorted(r[0] for r in db.execute("DESCRIBE " + contract.oracle_sql()[name]).fetchall()))
    wanted = db.execute(f"SELECT {columns} FROM ({contract.oracle_sql()[name]})").fetchall()
    assert found == sorted(wanted, key=str)


def test_maximum_counts_samples_of_one_time(spark, tmp_path):
    path = land(spark, tmp_path, SAMPLE, [("r", "p", "a", 0.0, 0.1), ("r", "p", "a", 0.0, 0.3)], [("r", "p", "a", 1.0, 0.2)])
    log = monitor.run_changelog(monitor.replica_state(stream(spark, path, SAMPLE)))
    row = monitor.latest(log, REPLICA_KEY).first()
    assert (row.samples_observed, row.latest_time_ps, row.maximum_rmsd_nm) == (2, 1.0, 0.3)


def test_replicas_are_watched_in_buckets(spark, tmp_path):
    """Far fewer groups than replicas, and still one entry a replica, equal to batch."""
    data = [("r", f"p{i % 2500}" if i % 2500 else None, f"r{i // 2500 % 2}", float(i // 5000), i % 97 / 100) for i in range(20_000)]
    data[7] = (*data[7][:3], None, 5.0)
    path = land(spark, tmp_path, SAMPLE, data[:12_000], data[11_000:], data[:2])
    log = str(tmp_path / "state")
    found = monitor.latest(monitor.run_changelog(monitor.replica_state(stream(spark, path, SAMPLE)), "update", log), REPLICA_KEY)
    want = spark.createDataFrame(data, SAMPLE).groupBy(*REPLICA_KEY).agg(
        F.count_distinct("time_ps"), F.max("time_ps"), F.max("rmsd_nm"), F.max("rmsd_nm") * 10
    )
    assert rows(found, *REPLICA_KEY) == rows(want, *REPLICA_KEY)
    state = spark.read.format("statestore").option("stateVarName", "watch").load(f"{log}/_checkpoint")
    assert state.count() == 5000 and state.select("key").distinct().count() <= 512


def test_maximum_of_later_rows_of_one_time(spark, tmp_path):
    path = land(spark, tmp_path, SAMPLE, [("r", "p", "a", 1.0, 0.1)], [("r", "p", "a", 1.0, 0.3)])
    row = monitor.latest(monitor.run_changelog(monitor.replica_state(stream(spark, path, SAMPLE))), REPLICA_KEY).first()
    assert (row.samples_observed, row.latest_time_ps, row.maximum_rmsd_nm) == (1, 1.0, 0.3)


def test_new_samples_are_found_in_buckets(spark, tmp_path):
    """Far fewer groups than replicas, one entry a replica, each time once, columns as they came."""
    schema = SAMPLE + ", event_id long, seen timestamp"
    data = [
        ("r", f"p{i % 2500}" if i % 2500 else None, f"r{i // 2500 % 2}", float(i // 5000), i % 97 / 100, 2**60 + i if i % 3 else None, datetime(2024, 1, 1))
        for i in range(20_000)
    ]
    untimed = ("r", "p1", "r0", None, 0.5, None, None)
    folder, log = str(tmp_path / "landing"), str(tmp_path / "log")
    for part in ([untimed, *data[:12_000], untimed], data[11_000:], data[:2]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        found = monitor.newer_samples(monitor.parquet_stream(spark, folder, spark.createDataFrame([], schema).schema), log)
    order = ["event_id", "pose_id", "replica_id", "time_ps"]
    assert rows(found.drop(monitor.BATCH), *order) == rows(spark.createDataFrame([untimed, *data], schema), *order)
    state = spark.read.format("statestore").option("stateVarName", "latest").load(f"{log}/_checkpoint")
    assert state.count() == 5000 and state.select("key").distinct().count() <= 512
