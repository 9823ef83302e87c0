"""Threshold crossings, canonical triggers and replica observation in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posewatch.functions.units import nm_to_angstrom
from posewatch.operators import prefix
from posewatch.operators.score import POSE_KEY, REPLICA_KEY


def crossings(samples: DataFrame, poses: DataFrame) -> DataFrame:
    """Samples strictly above the threshold of their pose.

    A null threshold never matches, so those poses drop out before the join. No
    crossing lies at or below the least threshold of all; that one number removes
    most samples before they are joined.
    """
    limits = poses.filter(F.col("pruning_threshold_angstrom").isNotNull()).select(
        *POSE_KEY, "pruning_threshold_angstrom"
    )
    least = limits.agg(F.min("pruning_threshold_angstrom")).scalar()
    return (
        samples.withColumn("rmsd_angstrom", nm_to_angstrom(F.col("rmsd_nm")))
        .filter(F.col("rmsd_angstrom") > least)
        .join(limits, POSE_KEY)
        .filter(F.col("rmsd_angstrom") > F.col("pruning_threshold_angstrom"))
        .select(*REPLICA_KEY, "time_ps", "rmsd_angstrom", "pruning_threshold_angstrom")
    )


def first_crossing(crossed: DataFrame) -> DataFrame:
    """Earliest crossing of each replica."""
    return (
        crossed.groupBy(*REPLICA_KEY)
        .agg(F.min(F.struct("time_ps", "rmsd_angstrom")).alias("c"))
        .select(*REPLICA_KEY, "c.time_ps", "c.rmsd_angstrom")
    )


def canonical_trigger(crossed: DataFrame) -> DataFrame:
    """Earliest crossing of each pose, ties broken by replica.

    Taken over all crossings, so it does not depend on arrival order and the
    stream gives the same row.
    """
    return (
        crossed.groupBy(*POSE_KEY)
        .agg(
            F.min(F.struct("time_ps", "replica_id", "rmsd_angstrom")).alias("t"),
            F.max("rmsd_angstrom").alias("max_crossing_angstrom"),
        )
        .select(
            *POSE_KEY,
            F.col("t.time_ps").alias("trigger_simulation_time_ps"),
            F.col("t.replica_id").alias("trigger_replica_id"),
            F.col("t.rmsd_angstrom").alias("trigger_observed_rmsd_angstrom"),
            "max_crossing_angstrom",
        )
    )


def precondition_violations(samples: DataFrame, poses: DataFrame) -> DataFrame:
    """Thresholds that are not positive; samples with negative time or RMSD."""
    bad_limit = poses.filter(F.col("pruning_threshold_angstrom") <= 0).select(
        *POSE_KEY,
        F.lit(None).cast("string").alias("replica_id"),
        F.lit("threshold_not_positive").alias("reason"),
    )
    reason = F.when(F.col("time_ps") < 0, "negative_time").when(
        F.col("rmsd_nm") < 0, "negative_rmsd"
    )
    bad_sample = samples.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return bad_limit.unionByName(bad_sample.select(*REPLICA_KEY, "reason"))


def observation_summary(samples: DataFrame, poses: DataFrame, replicas: DataFrame) -> DataFrame:
    """Per replica: samples, latest time, maximum in both units, crossing seen.

    A replica without samples has none observed, time zero and no maximum.

    Overlapping snapshots repeat a simulation time, so rows are first reduced to
    one per time; that step carries map-side partials. A replica has crossed when
    its maximum has, so thresholds are joined to replicas and not to samples.
    """
    per_time = samples.groupBy(*REPLICA_KEY, "time_ps").agg(F.max("rmsd_nm").alias("rmsd_nm"))
    summary = per_time.groupBy(*REPLICA_KEY).agg(
        F.count("*").alias("samples_observed"),
        F.max("time_ps").alias("latest_time_ps"),
        F.max("rmsd_nm").alias("maximum_rmsd_nm"),
    )
    limits = poses.select(*POSE_KEY, "pruning_threshold_angstrom")
    top = nm_to_angstrom(F.col("maximum_rmsd_nm"))
    known = replicas.select(*REPLICA_KEY).join(summary, REPLICA_KEY, "left")
    return known.join(limits, POSE_KEY, "left").select(
        *REPLICA_KEY,
        F.coalesce("samples_observed", F.lit(0)).alias("samples_observed"),
        F.coalesce("latest_time_ps", F.lit(0.0)).alias("latest_time_ps"),
        "maximum_rmsd_nm",
        top.alias("maximum_rmsd_angstrom"),
        F.coalesce(top > F.col("pruning_threshold_angstrom"), F.lit(False)).alias("triggered_pruning"),
    )


def running_maximum(samples: DataFrame, window_rows: int | None = None) -> DataFrame:
    """Maximum RMSD so far at every sample, in time order."""
    return prefix.scan(
        samples, REPLICA_KEY, ["time_ps"], "maximum", "running_max_rmsd_nm", F.col("rmsd_nm"), window_rows
    )


def time_order_faults(
    lines: DataFrame, keys: Sequence[str], order: str, window_rows: int | None = None
) -> DataFrame:
    """Lines whose time is not above the time of the line before."""
    before = prefix.scan(lines, keys, [order], "previous", "previous_time_ps", F.col("time_ps"), window_rows)
    return before.filter(F.col("time_ps") <= F.col("previous_time_ps"))


def consecutive_failures(
    snapshots: DataFrame, keys: Sequence[str], order: str, limit: int = 3, window_rows: int | None = None
) -> DataFrame:
    """Runs of at least ``limit`` failed snapshots in a row.

    A run is named by the success before it, so it is counted by a plain
    aggregate even when it is long.
    """
    success = F.when(~F.col("failed"), F.col(order))
    marked = prefix.scan(snapshots, keys, [order], "latest", "last_success", success, window_rows)
    return (
        marked.filter("failed")
        .groupBy(*keys, "last_success")
        .agg(
            F.count("*").alias("n_failures"),
            F.min(order).alias("first_failure"),
            F.max(order).alias("last_failure"),
        )
        .filter(F.col("n_failures") >= limit)
    )


def unobserved_samples(samples: DataFrame, observed: DataFrame) -> DataFrame:
    """Samples later than the latest observed time of their replica; all when none was."""
    latest = observed.select(*REPLICA_KEY, F.col("latest_time_ps").alias("__latest"))
    return (
        samples.join(latest, REPLICA_KEY, "left")
        .filter(F.col("__latest").isNull() | (F.col("time_ps") > F.col("__latest")))
        .drop("__latest")
    )
