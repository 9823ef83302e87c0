"""MD-scores: maximum over time, then over replicas, behind a completion gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posewatch.functions.units import nm_to_angstrom
from posewatch.operators import prefix

REPLICA_KEY = ["run_id", "pose_id", "replica_id"]
POSE_KEY = ["run_id", "pose_id"]


def replica_maxima(samples: DataFrame) -> DataFrame:
    """Largest RMSD of each replica, the first time it was reached, and its source.

    ``source`` is the series file of the sample; null where the samples have none.
    """
    if "source" not in samples.columns:
        samples = samples.withColumn("source", F.lit(None).cast("string"))
    peak = F.max_by(
        F.struct("time_ps", "rmsd_nm", "source"), F.struct(F.col("rmsd_nm"), -F.col("time_ps"))
    )
    return (
        samples.groupBy(*REPLICA_KEY)
        .agg(peak.alias("p"))
        .select(
            *REPLICA_KEY,
            F.col("p.source").alias("source"),
            F.col("p.time_ps").alias("time_ps"),
            F.col("p.rmsd_nm").alias("max_rmsd_nm"),
            nm_to_angstrom(F.col("p.rmsd_nm")).alias("max_rmsd_angstrom"),
        )
    )


def observed_maxima(samples: DataFrame) -> DataFrame:
    """Replica count and largest RMSD per pose.

    Only primitive maxima are kept, so both steps are hash aggregates with
    map-side partials; what is shuffled is one row per replica and task.
    """
    return (
        samples.groupBy(*REPLICA_KEY)
        .agg(F.max("rmsd_nm").alias("m"))
        .groupBy(*POSE_KEY)
        .agg(
            F.count("*").alias("n_replicas_completed"),
            nm_to_angstrom(F.max("m")).alias("observed_max_rmsd_angstrom"),
        )
    )


def pose_scores(
    samples: DataFrame, poses: DataFrame, rejected: DataFrame | None = None
) -> DataFrame:
    """Score of every pose.

    ``poses`` has n_replicas_requested (null: what was found) and pruned. A score
    is null unless every requested replica is there and the pose is not pruned.
    ``rejected`` names the poses of series files that could not be read; those are
    never complete.
    """
    found = observed_maxima(samples)
    done = F.coalesce("n_replicas_completed", F.lit(0))
    requested = F.coalesce(F.col("n_replicas_requested").cast("bigint"), done)
    whole = F.lit(True)
    if rejected is not None:
        poses = poses.join(
            rejected.select(*POSE_KEY).distinct().withColumn("__rejected", F.lit(True)), POSE_KEY, "left"
        )
        whole = F.col("__rejected").isNull()
    status = (
        F.when(F.col("pruned"), "PRUNED")
        .when((done == requested) & (done > 0) & whole, "COMPLETED")
        .otherwise("INCOMPLETE")
    )
    violation = F.when(done == 0, "no series").when(
        done > requested, "completed replica count exceeds requested replica count"
    )
    score = F.when(
        (status == "COMPLETED") & violation.isNull(), F.col("observed_max_rmsd_angstrom")
    )
    return poses.join(found, POSE_KEY, "left").select(
        *POSE_KEY,
        status.alias("status"),
        requested.alias("n_replicas_requested"),
        done.alias("n_replicas_completed"),
        score.alias("md_score_angstrom"),
        "observed_max_rmsd_angstrom",
        violation.alias("violation"),
    )


def ranked(scores: DataFrame, limit: int | None = None) -> DataFrame:
    """Poses from the most to the least stable; poses without a score last."""
    ordered = scores.orderBy(F.asc_nulls_last("md_score_angstrom"), *POSE_KEY)
    return ordered.limit(limit) if limit is not None else ordered


def rank_of(scores: DataFrame, window_rows: int | None = None) -> DataFrame:
    """Add ``score_rank``: 1 + poses of the same run with a lower score, null without one.

    Poses are first counted per (run, score), so equal scores need no window of their own.
    """
    level = ["run_id", "md_score_angstrom"]
    levels = scores.filter("md_score_angstrom IS NOT NULL").groupBy(*level).agg(F.count("*").alias("__n"))
    below = prefix.scan(levels, level[:1], level[1:], "sum_before", "__below", F.col("__n"), window_rows)
    return scores.join(below.drop("__n"), level, "left").select(
        *scores.columns, (F.col("__below") + 1).alias("score_rank")
    )


def score_documents(scores: DataFrame, maxima: DataFrame) -> DataFrame:
    """Score document of each pose as JSON with the maxima of all its replicas."""
    lists = (
        maxima.groupBy(*POSE_KEY)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("replica_id", "max_rmsd_angstrom", "max_rmsd_nm", "time_ps", "source")
                )
            ).alias("replica_maxima")
        )
    )
    body = F.to_json(
        F.struct(
            F.lit("nm").alias("input_unit"),
            "md_score_angstrom",
            "n_replicas_completed",
            "n_replicas_requested",
            "observed_max_rmsd_angstrom",
            F.lit("angstrom").alias("output_unit"),
            F.transform(
                F.coalesce("replica_maxima", F.array().cast(lists.schema["replica_maxima"].dataType)),
                lambda m: F.struct(
                    m["max_rmsd_angstrom"].alias("max_rmsd_angstrom"),
                    m["max_rmsd_nm"].alias("max_rmsd_nm"),
                    m["replica_id"].alias("replica_id"),
                    m["source"].alias("source"),
                    m["time_ps"].alias("time_ps"),
                ),
            ).alias("replica_maxima"),
            "status",
        ),
        {"ignoreNullFields": "false"},
    )
    return (
        scores.join(lists, POSE_KEY, "left")
        .select(*POSE_KEY, body.alias("document"))
    )


def golden_check(scores: DataFrame, expected: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Compare scores with expected ones; a missing score never passes."""
    gap = F.abs(F.col("md_score_angstrom") - F.col("expected_md_score_angstrom"))
    return expected.join(scores, POSE_KEY, "left").select(
        *POSE_KEY,
        "expected_md_score_angstrom",
        "md_score_angstrom",
        F.coalesce(gap <= tolerance, F.lit(False)).alias("within_tolerance"),
    )
