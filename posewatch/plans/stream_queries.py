"""Streams over ``events``, run to the end; the checking SQL is the batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from posewatch.operators.score import REPLICA_KEY
from posewatch.plans import standins as s
from posewatch.plans.registry import query
from posewatch.plans.sample_queries import BASE, CROSSED_SQL, FAILURES_SQL, TRIGGER_SQL
from posewatch.plans.state_queries import OWNED_SQL
from posewatch.session import scratch_dir
from posewatch.streaming import monitor


PARTS = 4
# Rows of an arriving file; the tasks that read a part are as many as its files allow.
FILE_ROWS = 250_000


def arriving(spark, sf, drained):
    """The events arrive in four parts, in the order of their id; the result of the last drain.

    ``drained(events)`` runs a stream over what has landed to its end and goes on from its own
    checkpoint. A part is written only after the one before it was drained, so a batch never
    holds earlier ids than the batches before it, whatever the number of files and their times.
    A part reads the row groups of its ids.
    """
    events = s.table(spark, sf, "events")
    path = scratch_dir(spark, "arriving")
    lo, hi = events.agg(F.min("event_id"), F.max("event_id")).first()
    lo, hi = lo or 0, hi or 0
    step = (hi - lo) // PARTS + 1
    for k in range(PARTS):
        low = lo + k * step
        part = (F.col("event_id") >= low) & (F.col("event_id") < low + step)
        if k == 0:
            part = part | F.col("event_id").isNull()
        events.filter(part).write.option("maxRecordsPerFile", FILE_ROWS).mode("append").parquet(path)
        result = drained(monitor.parquet_stream(spark, path, events.schema))
    return result


def timed(events):
    time_ps = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return s.with_time(events, time_ps)


def changes(spark, sf, job):
    """Changelog of the stream ``job(events)`` over the arriving events."""
    path = scratch_dir(spark, "changelog")
    return arriving(spark, sf, lambda events: monitor.run_changelog(job(events), path=path))


@query(
    "stream_dedup",
    s.with_ctes(
        BASE,
        """SELECT run_id, pose_id, replica_id, count(*) AS samples_observed, min(rmsd_nm) AS least_rmsd_nm
           FROM (SELECT DISTINCT run_id, pose_id, replica_id, time_ps, rmsd_nm FROM samples) GROUP BY ALL""",
    ),
)
def stream_dedup(spark, sf):
    """Every sample arrives twice, as in overlapping snapshots."""
    path = scratch_dir(spark, "changelog")

    def drained(events):
        samples = timed(events).drop("event_id")
        twice = samples.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
        return monitor.newer_samples(twice, path)

    return arriving(spark, sf, drained).groupBy(*REPLICA_KEY).agg(
        F.count("*").alias("samples_observed"), F.min("rmsd_nm").alias("least_rmsd_nm")
    )


@query(
    "stream_maximum",
    s.with_ctes(
        BASE,
        """SELECT run_id, pose_id, replica_id, count(DISTINCT time_ps) AS samples_observed,
             max(time_ps) AS latest_time_ps, max(rmsd_nm) AS maximum_rmsd_nm,
             max(rmsd_nm) * 10 AS maximum_rmsd_angstrom FROM samples GROUP BY ALL""",
    ),
)
def stream_maximum(spark, sf):
    log = changes(spark, sf, lambda events: monitor.replica_state(timed(events)))
    return monitor.latest(log, REPLICA_KEY)


@query("stream_trigger", s.with_ctes([*BASE, CROSSED_SQL], TRIGGER_SQL))
def stream_trigger(spark, sf):
    poses = s.sample_poses(spark, sf)
    log = changes(spark, sf, lambda events: monitor.triggers(timed(events), poses))
    return monitor.latest(log, ["run_id", "pose_id"])


@query(
    "stream_pruning_events",
    s.with_ctes(
        [*BASE, CROSSED_SQL],
        """SELECT run_id, pose_id, 1 AS n_pruned, count(DISTINCT replica_id) AS n_reports,
             max(replica_id) AS last_replica FROM crossed GROUP BY run_id, pose_id""",
    ),
)
def stream_pruning_events(spark, sf):
    """Every crossing replica gives one event, the first of a pose prunes it."""
    poses = s.sample_poses(spark, sf)
    reports = changes(spark, sf, lambda events: monitor.replica_triggers(timed(events), poses))
    events = monitor.pruning_events(reports)
    return events.groupBy("run_id", "pose_id").agg(
        F.count_if(F.col("code") == "POSE_PRUNED").alias("n_pruned"),
        F.count("*").alias("n_reports"),
        F.max("trigger_replica_id").alias("last_replica"),
    )


@query("stream_catch_up", s.with_ctes([*BASE, CROSSED_SQL], TRIGGER_SQL))
def stream_catch_up(spark, sf):
    """The stream sees two thirds of the samples; the rest is scanned afterwards."""
    poses = s.sample_poses(spark, sf)
    log = changes(spark, sf, lambda events: monitor.triggers(timed(events).filter("event_id % 3 <> 0"), poses))
    seen = monitor.latest(log, ["run_id", "pose_id"])
    late = s.samples(spark, sf).filter("event_id % 3 = 0")
    return monitor.caught_up_triggers(seen, late, poses)


@query("stream_failures", FAILURES_SQL)
def stream_failures(spark, sf):
    path = scratch_dir(spark, "changelog")

    def drained(events):
        snapshots = events.select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
        return monitor.failure_runs(snapshots, ["user_id"], "event_id", 3, path)

    return arriving(spark, sf, drained)


@query(
    "stream_progress",
    s.with_ctes(
        OWNED_SQL,
        """SELECT task_id, arg_max(stage_reached, sequence) AS stage_reached,
             arg_max(trajectory_time_completed_ps, sequence) AS trajectory_time_completed_ps,
             arg_max(max_rmsd_nm, sequence) FILTER (max_rmsd_nm IS NOT NULL) AS max_rmsd_nm, count(*) AS n_heartbeats
           FROM messages GROUP BY task_id""",
    ),
)
def stream_progress(spark, sf):
    log = changes(spark, sf, lambda events: monitor.progress(events.selectExpr(*s.exprs(s.MESSAGE))))
    return monitor.latest(log, ["task_id", *REPLICA_KEY]).select(
        "task_id", "stage_reached", "trajectory_time_completed_ps", "max_rmsd_nm", "n_heartbeats"
    )


@query(
    "stream_event_export",
    "SELECT user_id % 4 AS run_id, event_id AS sequence, event_type AS code FROM events",
)
def stream_event_export(spark, sf):
    """State events appended to a log once, although each arrives twice."""
    path = scratch_dir(spark, "event-log")

    def drained(arrived):
        events = arrived.select(
            (F.col("user_id") % 4).alias("run_id"), F.col("event_id").alias("sequence"),
            F.col("event_type").alias("code"),
        )
        twice = events.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
        monitor.export_events(twice, path)
        return spark.read.schema(events.schema).parquet(path).select(*events.columns)

    return arriving(spark, sf, drained)
