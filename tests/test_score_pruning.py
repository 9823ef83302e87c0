"""Scores, triggers, ordered scans, and their brute-force twins."""

import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from posewatch.operators import pruning, score

SAMPLE = "run_id string, pose_id string, replica_id string, time_ps double, rmsd_nm double"
POSE = "run_id string, pose_id string, n_replicas_requested int, pruned boolean, pruning_threshold_angstrom double"


def samples(spark, data, pose="p"):
    return spark.createDataFrame([("r", pose, *d) for d in data], SAMPLE)


def poses(spark, *data):
    return spark.createDataFrame([("r", *d) for d in data], POSE)


TWO = [("a", 0.0, 0.1), ("a", 10.0, 0.4), ("a", 20.0, 0.2), ("b", 0.0, 0.3), ("b", 10.0, 0.2), ("b", 20.0, 0.45)]


@pytest.mark.parametrize(
    "requested, pruned, expected",
    [
        (2, False, ("COMPLETED", 4.5, 4.5, None)),
        (None, False, ("COMPLETED", 4.5, 4.5, None)),
        (3, False, ("INCOMPLETE", None, 4.5, None)),
        (2, True, ("PRUNED", None, 4.5, None)),
        (1, False, ("INCOMPLETE", None, 4.5, "completed replica count exceeds requested replica count")),
    ],
)
def test_completion_gate(spark, requested, pruned, expected):
    out = score.pose_scores(samples(spark, TWO), poses(spark, ("p", requested, pruned, None)))
    row = out.first()
    assert (row.status, row.md_score_angstrom, row.observed_max_rmsd_angstrom, row.violation) == expected


def test_pose_without_series(spark):
    row = score.pose_scores(samples(spark, TWO), poses(spark, ("other", 2, False, None))).first()
    assert (row.status, row.md_score_angstrom, row.violation) == ("INCOMPLETE", None, "no series")


def test_first_time_wins_on_ties(spark):
    out = score.replica_maxima(samples(spark, [("a", 10.0, 0.4), ("a", 0.0, 0.4), ("a", 5.0, 0.1)]))
    assert out.first().time_ps == 0.0


def test_document_holds_all_replicas(spark):
    names = [f"replica_{i:02d}" for i in range(1, 1501)] + ["last"]
    data = samples(spark, [(name, 0.0, 0.1) for name in names])
    docs = score.score_documents(score.pose_scores(data, poses(spark, ("p", 1501, False, None))), score.replica_maxima(data))
    (one,) = docs.collect()
    listed = [m["replica_id"] for m in json.loads(one.document)["replica_maxima"]]
    assert listed == sorted(names)


def test_unreadable_series_blocks_the_score(spark):
    data = samples(spark, [("a", 0.0, 0.1)])
    one = poses(spark, ("p", None, False, None))
    assert score.pose_scores(data, one).first().status == "COMPLETED"
    row = score.pose_scores(data, one, rejected=data.select("run_id", "pose_id")).first()
    assert (row.status, row.md_score_angstrom) == ("INCOMPLETE", None)


def test_rank_counts_lower_scores(spark):
    data = [("r", f"p{i}", s) for i, s in enumerate([1.0, 1.0, 2.0, None, 0.5, 2.0])]
    df = spark.createDataFrame(data, "run_id string, pose_id string, md_score_angstrom double")
    for window_rows in (None, 0):
        got = dict(rows(score.rank_of(df, window_rows).select("pose_id", "score_rank")))
        assert got == {"p0": 2, "p1": 2, "p2": 4, "p3": None, "p4": 1, "p5": 4}
    order = [r.pose_id for r in score.ranked(df).collect()]
    assert order == ["p4", "p0", "p1", "p2", "p5", "p3"]


def test_threshold_is_strict(spark):
    data = samples(spark, [("a", 0.0, 0.4), ("a", 1.0, 0.4000001)])
    hit = pruning.crossings(data, poses(spark, ("p", 1, False, 4.0)))
    assert [r.time_ps for r in hit.collect()] == [1.0]
    assert pruning.crossings(data, poses(spark, ("p", 1, False, None))).count() == 0


def test_canonical_trigger(spark):
    data = samples(spark, [("r01", 20.0, 0.9), ("r05", 10.0, 0.41), ("r02", 10.0, 0.42)])
    hit = pruning.crossings(data, poses(spark, ("p", 3, False, 4.0)))
    row = pruning.canonical_trigger(hit).first()
    assert (row.trigger_simulation_time_ps, row.trigger_replica_id) == (10.0, "r02")
    assert row.max_crossing_angstrom == 9.0


def test_thousand_samples_one_crossing(spark):
    data = samples(spark, [("a", float(i), 0.41 if i >= 500 else 0.1) for i in range(1000)])
    hit = pruning.crossings(data, poses(spark, ("p", 1, False, 4.0)))
    assert rows(pruning.first_crossing(hit).select("time_ps")) == [(500.0,)]


def test_observation_of_overlapping_snapshots(spark):
    data = samples(spark, [("a", 0.0, 0.1), ("a", 10.0, 0.3), ("a", 0.0, 0.1), ("a", 10.0, 0.3), ("a", 20.0, 0.41)])
    known = spark.createDataFrame([("r", "p", "a"), ("r", "p", "b")], "run_id string, pose_id string, replica_id string")
    row, idle = pruning.observation_summary(data, poses(spark, ("p", 1, False, 4.0)), known).orderBy("replica_id").collect()
    assert (idle.samples_observed, idle.latest_time_ps, idle.maximum_rmsd_nm, idle.triggered_pruning) == (0, 0.0, None, False)
    assert (row.samples_observed, row.latest_time_ps, row.triggered_pruning) == (3, 20.0, True)
    assert row.maximum_rmsd_angstrom == pytest.approx(4.1)


def test_unobserved_samples(spark):
    data = samples(spark, [("a", 0.0, 0.1), ("a", 10.0, 0.3), ("b", 0.0, 0.1)])
    seen = spark.createDataFrame([("r", "p", "a", 0.0)], "run_id string, pose_id string, replica_id string, latest_time_ps double")
    got = rows(pruning.unobserved_samples(data, seen).select("replica_id", "time_ps"), "replica_id")
    assert got == [("a", 10.0), ("b", 0.0)]


def test_preconditions(spark):
    data = samples(spark, [("a", -1.0, 0.1), ("b", 1.0, -0.1)])
    got = rows(pruning.precondition_violations(data, poses(spark, ("p", 1, False, 0.0))).select("reason"), "reason")
    assert got == [("negative_rmsd",), ("negative_time",), ("threshold_not_positive",)]


@pytest.fixture(scope="module")
def hot(spark):
    """A table where one key holds most rows."""
    rng = random.Random(3)
    data = [("hot" if i % 5 else f"k{i % 7}", i * 3 + 1, rng.randint(0, 10_000), rng.random() < 0.6) for i in range(3000)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, o bigint, v bigint, failed boolean").repartition(6).persist()


def brute(hot):
    by_key = {}
    for r in sorted(hot.collect(), key=lambda r: r.o):
        by_key.setdefault(r.k, []).append(r)
    return by_key


@pytest.mark.parametrize("window_rows", [None, 0])
def test_running_maximum_of_a_hot_replica(hot, window_rows):
    named = hot.select(F.lit("r").alias("run_id"), F.col("k").alias("pose_id"), F.col("k").alias("replica_id"),
                       F.col("o").alias("time_ps"), F.col("v").cast("double").alias("rmsd_nm"))
    got = {(r.pose_id, r.time_ps): r.running_max_rmsd_nm for r in pruning.running_maximum(named, window_rows).collect()}
    want = {}
    for k, items in brute(hot).items():
        top = 0
        for r in items:
            top = max(top, r.v)
            want[(k, r.o)] = top
    assert got == want


@pytest.mark.parametrize("window_rows", [None, 0])
def test_failure_runs_of_a_hot_key(hot, window_rows):
    got = {(r.k, r.first_failure): r.n_failures for r in pruning.consecutive_failures(hot, ["k"], "o", 3, window_rows).collect()}
    want = {}
    for k, items in brute(hot).items():
        run = []
        for r in [*items, None]:
            if r is not None and r.failed:
                run.append(r.o)
                continue
            if len(run) >= 3:
                want[(k, run[0])] = len(run)
            run = []
    assert got == want


@pytest.mark.parametrize("window_rows", [None, 0])
def test_time_order_over_tasks(spark, window_rows):
    data = [("f", i, float(i if i % 40 else i - 2)) for i in range(1, 400)]
    lines = spark.createDataFrame(data, "source string, line_no bigint, time_ps double")
    got = rows(pruning.time_order_faults(lines, ["source"], "line_no", window_rows).select("line_no"), "line_no")
    assert got == [(i,) for i in range(40, 400, 40)]
