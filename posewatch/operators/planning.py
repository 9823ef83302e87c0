"""From a pose manifest to replicas, tasks and their first queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posewatch.functions.documents import document_lines, json_text
from posewatch.functions.identity import pose_id_valid, replica_id, resname_valid, task_id
from posewatch.operators import prefix
from posewatch.schemas import EXTERNAL_DESTINATION, RUN_SCOPE, SEED_MAX


# --- seeds ---------------------------------------------------------------


def base_seeds(base_seed: Column, replicas: Column) -> Column:
    """Consecutive seeds from a base."""
    base = base_seed.cast("bigint")
    return F.sequence(base, base + replicas - 1)


def seed_violation(replicas: Column, seeds: Column, base_seed: Column) -> Column:
    """First broken seed rule, null when seeds or base are usable or both absent."""
    # Texts of the violations.
    return (
        F.when(replicas < 1, "replicas must be positive")
        .when(seeds.isNotNull() & base_seed.isNotNull(), "base_seed and seeds are mutually exclusive")
        .when((base_seed < 1) | (base_seed > SEED_MAX), "base_seed must be a positive 32-bit integer")
        .when(
            base_seed.cast("bigint") + replicas - 1 > SEED_MAX,
            "base_seed range exceeds the 32-bit seed limit",
        )
        .when(F.size(seeds) != replicas, "seeds length must equal replicas")
        .when(F.size(F.array_distinct(seeds)) != F.size(seeds), "explicit seeds must be unique")
        .when(
            F.exists(seeds, lambda s: (s < 1) | (s > SEED_MAX)),
            "explicit seeds must be positive 32-bit integers",
        )
    )


def generated_seed(task_number: Column, multiplier: int, shift: int) -> Column:
    """A seed in 1…2^31-1 for each dense task number.

    The modulus is prime and the multiplier not a multiple of it, so numbers
    below the modulus map one-to-one and no seed repeats. All terms fit 64 bits.
    """
    if multiplier % SEED_MAX == 0:
        raise ValueError("the multiplier must not be a multiple of 2^31-1")
    product = (task_number % SEED_MAX) * F.lit(multiplier % SEED_MAX)
    return (product % SEED_MAX + F.lit(shift % SEED_MAX)) % SEED_MAX + 1


# --- manifest ------------------------------------------------------------


def overlay_manifest(entries: DataFrame, defaults: dict) -> DataFrame:
    """Run defaults overlaid by the overrides of each pose.

    Presence decides, not value: a present null replaces a default. ``entries`` has
    ``o_<field>`` and ``has_<field>`` per override. ``defaults`` are the settings of
    one run and become literals.
    """

    def default(name: str, kind: str) -> Column:
        return F.lit(defaults.get(name)).cast(kind)

    def over(name: str, kind: str) -> Column:
        return F.when(F.col(f"has_{name}"), F.col(f"o_{name}").cast(kind)).otherwise(
            default(name, kind)
        )

    seeds_default = defaults.get("seeds")
    seeds_default = (
        F.lit(None).cast("array<bigint>")
        if seeds_default is None
        else F.array(*[F.lit(s).cast("bigint") for s in seeds_default])
    )
    own_base = F.col("has_base_seed") & F.col("o_base_seed").isNotNull()
    own_seeds = F.col("has_seeds") & F.col("o_seeds").isNotNull()
    seeds = (
        F.when(F.col("has_seeds"), F.col("o_seeds").cast("array<bigint>"))
        .when(own_base, F.lit(None).cast("array<bigint>"))
        .otherwise(seeds_default)
    )
    base_seed = F.when(own_seeds, F.lit(None).cast("bigint")).otherwise(over("base_seed", "bigint"))
    replicas = F.when(own_seeds & ~F.col("has_replicas"), F.size("o_seeds")).otherwise(
        over("replicas", "int")
    )
    kept = [c for c in entries.columns if not c.startswith(("o_", "has_"))]
    return entries.select(
        *kept,
        replicas.alias("replicas"),
        base_seed.alias("base_seed"),
        seeds.alias("seeds"),
        over("enabled", "boolean").alias("pruning_enabled"),
        over("threshold_angstrom", "double").alias("pruning_threshold_angstrom"),
        over("grace_period_seconds", "double").alias("grace_period_seconds"),
    )


def manifest_violations(resolved: DataFrame, key: Sequence[str] = ("run_id", "pose_id")) -> DataFrame:
    """One row per broken rule of a resolved manifest."""
    enabled = F.coalesce("pruning_enabled", F.lit(False))
    limit = F.col("pruning_threshold_angstrom")
    checks = [
        F.when(~pose_id_valid(F.col("pose_id")), "pose_id invalid"),
        F.when(~resname_valid(F.col("ligand_resname")), "ligand_resname invalid"),
        seed_violation(F.col("replicas"), F.col("seeds"), F.col("base_seed")),
        F.when(F.col("replicas").isNull(), "replicas missing"),
        F.when(enabled & limit.isNull(), "threshold required when pruning is enabled"),
        F.when(~enabled & limit.isNotNull(), "threshold must be null when pruning is disabled"),
        F.when(limit <= 0, "threshold must be positive"),
        F.when(F.col("grace_period_seconds") < 0, "grace period must not be negative"),
    ]
    per_row = resolved.select(*key, F.explode(F.array_compact(F.array(*checks))).alias("reason"))
    repeated = (
        resolved.groupBy(*key)
        .count()
        .filter("count > 1")
        .select(*key, F.lit("pose_id values must be unique").alias("reason"))
    )
    return per_row.unionByName(repeated)


def manifest_payload() -> Column:
    """Normalised manifest entry as JSON."""
    return F.to_json(
        F.struct(
            "pose_id",
            "prepared_system_dir",
            "start_structure",
            "topology",
            "index",
            "ligand_resname",
            F.struct(
                F.struct(
                    "replicas", F.lit(None).cast("bigint").alias("base_seed"), "seeds"
                ).alias("trajectory"),
                F.struct(
                    F.col("pruning_enabled").alias("enabled"),
                    F.col("pruning_threshold_angstrom").alias("threshold_angstrom"),
                    "grace_period_seconds",
                ).alias("pruning"),
            ).alias("overrides"),
        ),
        {"ignoreNullFields": "false"},
    )


# --- expansion -----------------------------------------------------------


def expand_tasks(
    poses: DataFrame, gpu_ids: str = "gpu_ids", order: str = "pose_no", window_rows: int | None = None
) -> DataFrame:
    """One row per replica with seed, task id and round-robin queue.

    ``poses`` has seeds, the list of queues of its run and a numeric ``order`` column
    that is unique within a run. Each run numbers its tasks from 0; the number is the
    offset of the pose in its run plus the place of the replica, and takes the queue
    at that place of the run's list, over and over.
    """
    n_seeds = F.size("seeds").cast("bigint")
    placed = prefix.scan(poses, ["run_id"], [order], "sum_before", "__first", n_seeds, window_rows)
    kept = [c for c in poses.columns if c not in ("seeds", gpu_ids)]
    index = F.col("__first") + F.col("__i")
    return placed.select(
        *kept, gpu_ids, "__first", F.posexplode("seeds").alias("__i", "velocity_seed")
    ).select(
        *kept,
        replica_id(F.col("__i") + 1).alias("replica_id"),
        task_id(F.col("pose_id"), replica_id(F.col("__i") + 1)).alias("task_id"),
        "velocity_seed",
        index.alias("task_index"),
        F.get(gpu_ids, (index % F.size(gpu_ids)).cast("int")).alias("assigned_gpu_id"),
    )


def expand_with_generated_seeds(
    poses: DataFrame, multiplier: int, shift: int, gpu_ids: str = "gpu_ids",
    order: str = "pose_no", window_rows: int | None = None,
) -> DataFrame:
    """As ``expand_tasks`` for poses that name a replica count but no seeds.

    Seeds are unique within a run.
    """
    places = poses.withColumn("seeds", F.sequence(F.lit(1), F.col("replicas")))
    tasks = expand_tasks(places, gpu_ids, order, window_rows)
    return tasks.withColumn("velocity_seed", generated_seed(F.col("task_index"), multiplier, shift))


def plan_tables(runs: DataFrame, tasks: DataFrame, poses: DataFrame, now: Column) -> dict[str, DataFrame]:
    """First state of the pose, replica and task tables and their events.

    The poses that a STATE_CREATED event lists are rows of ``event_members``.
    """
    pose_rows = poses.select(
        "run_id",
        "pose_id",
        F.lit("RUNNING").alias("status"),
        F.size("seeds").alias("n_replicas_requested"),
        "pruning_enabled",
        "pruning_threshold_angstrom",
        now.alias("started_at"),
    )
    replica_rows = tasks.select(
        "run_id", "pose_id", "replica_id", "velocity_seed", "resolved_ntomp",
        F.lit("PENDING").alias("status"),
    )
    task_rows = tasks.select(
        "task_id", "run_id", "pose_id", "replica_id", F.lit("PENDING").alias("status"),
        "assigned_gpu_id", "resolved_ntomp",
    )
    registered = poses.select(
        "run_id",
        "pose_id",
        F.lit("STATE").alias("category"),
        F.lit("POSE_REGISTERED").alias("code"),
        F.to_json(
            F.struct("pose_id", F.size("seeds").alias("replica_count"), "resolved_ntomp")
        ).alias("payload_json"),
    )
    created = plan_totals(tasks, runs).join(runs.select("run_id", "journal_mode"), "run_id").select(
        "run_id",
        F.lit(RUN_SCOPE).alias("pose_id"),
        F.lit("STATE").alias("category"),
        F.lit("STATE_CREATED").alias("code"),
        F.to_json(
            F.struct("journal_mode", F.col("poses").alias("pose_count"),
                     F.col("replicas").alias("replica_count"))
        ).alias("payload_json"),
    )
    return {
        "poses": pose_rows,
        "replicas": replica_rows,
        "tasks": task_rows,
        "events": registered.unionByName(created),
        "event_members": poses.select("run_id", F.lit("STATE_CREATED").alias("code"), "pose_id"),
    }


def plan_totals(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Poses and replicas per run, and workers: the queues that the run lists.

    Tasks are first counted per pose, with map-side partials, so a very large run is
    not counted in one task.
    """
    counts = (
        tasks.groupBy("run_id", "pose_id")
        .agg(F.count("*").alias("replicas"))
        .groupBy("run_id")
        .agg(F.count("*").alias("poses"), F.sum("replicas").alias("replicas"))
    )
    workers = runs.select("run_id", F.size("gpu_ids").cast("bigint").alias("workers"))
    return counts.join(workers, "run_id").select("run_id", "poses", "replicas", "workers")


def plan_lines(
    runs: DataFrame, tasks: DataFrame, poses: DataFrame, stages: Sequence[str], work_stealing: bool = True,
    available_cpus: int | None = None,
) -> DataFrame:
    """Lines of the execution plan of each run; see ``documents.document_lines``.

    ``runs`` has (run_id, gpu_ids), ``tasks`` the task rows with resolved_ntomp and
    ``poses`` (run_id, pose_id, pose_json) as of ``pose_documents``.
    """
    threads = tasks.groupBy("run_id").agg(F.max("resolved_ntomp").alias("__ntomp"))
    # Names and constants of the document.
    members = {
        "schema_version": F.lit("2"),
        "plan_type": json_text(F.lit("local_single_node_multi_pose")),
        "run_id": json_text(F.col("run_id")),
        "gpu_ids": F.to_json("gpu_ids"),
        "worker_count": F.size("gpu_ids").cast("string"),
        "worker_model": json_text(F.lit("one_persistent_worker_per_gpu")),
        "tasks_per_gpu": F.lit("1"),
        "resolved_ntomp_per_task": json_text(F.col("__ntomp")),
        "available_cpu_count": json_text(F.lit(available_cpus).cast("int")),
        "stages": F.to_json(F.array(*map(F.lit, stages))),
        "work_stealing": json_text(F.lit(work_stealing)),
        "launches_external_processes": F.lit("false"),
    }
    task_item = F.lpad(F.col("task_index").cast("string"), 20, "0").alias("item")
    item = F.col("pose_id").alias("item")
    return document_lines(
        runs.join(threads, "run_id", "left"), members,
        {
            "pose_ids": poses.select("run_id", item, json_text(F.col("pose_id")).alias("entry")),
            "tasks": plan_documents(tasks, work_stealing).select("run_id", task_item, F.col("task_json").alias("entry")),
            "poses": poses.select("run_id", item, F.col("pose_json").alias("entry")),
        },
    )


def plan_documents(tasks: DataFrame, work_stealing: bool = True) -> DataFrame:
    """Task entries of the execution plan as sorted-key JSON, one row per task."""
    body = F.to_json(
        F.struct(
            F.lit(work_stealing).alias("eligible_for_work_stealing"),
            F.col("assigned_gpu_id").alias("initial_gpu_id"),
            "pose_id",
            "replica_id",
            "resolved_ntomp",
            "task_id",
            "velocity_seed",
        )
    )
    return tasks.select("run_id", "task_index", body.alias("task_json"))


def checksum_maps(checksums: DataFrame, key: Sequence[str] = ("run_id", "pose_id")) -> DataFrame:
    """Input checksums of each pose as one map sorted by destination.

    A map holds the files of one pose. External inputs have no own destination and
    stay out.
    """
    own = checksums.filter(F.col("destination") != EXTERNAL_DESTINATION)
    entries = F.array_sort(F.collect_set(F.struct("destination", "sha256")))
    return own.groupBy(*key).agg(F.map_from_entries(entries).alias("input_checksums"))


def pose_documents(poses: DataFrame, maps: DataFrame) -> DataFrame:
    """Pose entries of the execution plan as JSON, one row per pose."""
    body = F.to_json(
        F.struct(
            F.coalesce("input_checksums", F.create_map().cast("map<string,string>")).alias(
                "input_checksums"
            ),
            "pose_id",
            F.struct(
                F.col("pruning_enabled").alias("enabled"),
                F.lit(">").alias("strict_operator"),
                F.col("pruning_threshold_angstrom").alias("threshold_angstrom"),
            ).alias("pruning"),
            F.col("n_replicas_requested").alias("replica_count"),
        ),
        {"ignoreNullFields": "false"},
    )
    return poses.join(maps, ["run_id", "pose_id"], "left").select(
        "run_id", "pose_id", body.alias("pose_json")
    )
