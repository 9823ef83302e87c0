"""Reports over pending tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSE_KEY = ["run_id", "pose_id"]
REPLICA_KEY = ["run_id", "pose_id", "replica_id"]


def pending_tasks(tasks: DataFrame, poses: DataFrame) -> DataFrame:
    """Pending tasks of running poses."""
    running = poses.filter(F.col("status") == "RUNNING").select(*POSE_KEY)
    return tasks.filter(F.col("status") == "PENDING").join(running, POSE_KEY, "left_semi")


def task_context(tasks: DataFrame, replicas: DataFrame, poses: DataFrame) -> DataFrame:
    """Pending tasks of running poses with seed and threshold."""
    limits = poses.filter(F.col("status") == "RUNNING").select(
        *POSE_KEY, "pruning_threshold_angstrom"
    )
    seeds = replicas.select(*REPLICA_KEY, "velocity_seed")
    return (
        tasks.filter(F.col("status") == "PENDING")
        .select("task_id", *REPLICA_KEY, "assigned_gpu_id")
        .join(limits, POSE_KEY)
        .join(seeds, REPLICA_KEY)
        .select("task_id", *REPLICA_KEY, "assigned_gpu_id", "velocity_seed",
                "pruning_threshold_angstrom")
    )


def running_tasks(tasks: DataFrame, poses: DataFrame) -> DataFrame:
    """Running tasks with the status of their pose."""
    status = poses.select(*POSE_KEY, F.col("status").alias("pose_status"))
    return tasks.filter(F.col("status") == "RUNNING").join(status, POSE_KEY)


def queue_depth(pending: DataFrame) -> DataFrame:
    return pending.groupBy("run_id", "assigned_gpu_id").agg(F.count("*").alias("pending_count"))


def busiest_queue(depth: DataFrame) -> DataFrame:
    """Deepest queue per run, the lower queue number on ties."""
    best = F.min(F.struct((-F.col("pending_count")).alias("d"), F.col("assigned_gpu_id").alias("g")))
    return depth.groupBy("run_id").agg(best.alias("b")).select(
        "run_id", F.col("b.g").alias("assigned_gpu_id"), (-F.col("b.d")).alias("pending_count")
    )


def next_task(pending: DataFrame) -> DataFrame:
    """First pending task of each queue by task id; a minimum, no per-queue sort."""
    return pending.groupBy("run_id", "assigned_gpu_id").agg(F.min("task_id").alias("task_id"))
