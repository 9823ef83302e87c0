"""Watching growing series: the streaming side of the batch pruning operators.

Aggregating streams run in update mode. Each micro-batch writes its changed rows
to its own folder of a changelog, overwriting that folder when the batch is
replayed, so the result is exactly-once. ``latest`` folds a changelog to its
current rows. Checkpoints and changelogs live in the shared scratch folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from posewatch.functions.units import nm_to_angstrom
from posewatch.operators import pruning
from posewatch.operators.score import POSE_KEY, REPLICA_KEY
from posewatch.operators.transitions import progress_fold
from posewatch.session import scratch_dir
from posewatch.sources.series import accepted, scan_series
from posewatch.streaming import keyed

BATCH = "__batch"


def parquet_stream(
    spark: SparkSession, path: str, schema: StructType | str, max_files: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def series_file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Accepted samples of series files as they land in a folder."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )
    return accepted(scan_series(files.select("path", "content")))


# --- sinks ---------------------------------------------------------------


def drain(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str, checkpoint: str
) -> None:
    """Process everything that is there, batch by batch, then stop.

    A later call with the same checkpoint goes on where this one ended.
    """
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def changelog(path: str) -> Callable[[DataFrame, int], None]:
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return sink


def run_changelog(stream: DataFrame, mode: str = "update", path: str | None = None) -> DataFrame:
    """Drain a stream into a changelog and return it with its batch column.

    The checkpoint lies inside the changelog folder, so a call with the same path
    continues it.
    """
    spark = stream.sparkSession
    path = path or scratch_dir(spark, "changelog")
    drain(stream, changelog(path), mode, f"{path}/_checkpoint")
    schema = StructType(list(stream.schema.fields)).add(BATCH, IntegerType())
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def latest(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key."""
    values = [c for c in log.columns if c not in (*keys, BATCH)]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("v"))
    return newest.select(*keys, "v.*")


# --- streams -------------------------------------------------------------


def deduplicated(samples: DataFrame) -> DataFrame:
    """Each simulation time of a replica once, in any order of arrival.

    Keeps a state row per sample; ``keyed.new_samples`` keeps one per replica where
    samples arrive in time order.
    """
    return samples.dropDuplicates([*REPLICA_KEY, "time_ps"])


def newer_samples(samples: DataFrame, path: str | None = None) -> DataFrame:
    """Changelog of samples later than all earlier ones of their replica.

    A sample that arrives after a later one is not taken; the catch-up scan over the
    finished series finds it.
    """
    return run_changelog(keyed.new_samples(samples), "append", path)


def replica_state(samples: DataFrame) -> DataFrame:
    """Samples seen, latest time and maximum RMSD per replica; overlaps count once."""
    return keyed.replica_watch(samples).withColumn(
        "maximum_rmsd_angstrom", nm_to_angstrom(F.col("maximum_rmsd_nm"))
    )


def triggers(samples: DataFrame, poses: DataFrame) -> DataFrame:
    """Canonical trigger per pose; it may move to an earlier time as data arrives."""
    return pruning.canonical_trigger(pruning.crossings(samples, poses))


def replica_triggers(samples: DataFrame, poses: DataFrame) -> DataFrame:
    """First crossing per replica, which is what a replica reports."""
    return pruning.first_crossing(pruning.crossings(samples, poses))


def pruning_events(reports: DataFrame) -> DataFrame:
    """One event per reporting replica from the changelog of ``replica_triggers``.

    The first report of a pose is POSE_PRUNED, those of its other replicas are
    PRUNING_TRIGGER_OBSERVED. Reports of one batch count by (time, replica). A replica
    reports once, with what it had found when it first did.
    """
    own = reports.groupBy(*REPLICA_KEY).agg(
        F.min(BATCH).alias("__batch_no"),
        F.min_by(F.struct("time_ps", "rmsd_angstrom"), BATCH).alias("r"),
    )
    opening = own.groupBy(*POSE_KEY).agg(
        F.min(F.struct("__batch_no", "r.time_ps", "replica_id")).alias("o")
    )
    return own.join(opening, POSE_KEY).select(
        *POSE_KEY,
        F.col("r.time_ps").alias("trigger_simulation_time_ps"),
        F.col("replica_id").alias("trigger_replica_id"),
        F.col("r.rmsd_angstrom").alias("trigger_observed_rmsd_angstrom"),
        F.when(F.col("replica_id") == F.col("o.replica_id"), "POSE_PRUNED")
        .otherwise("PRUNING_TRIGGER_OBSERVED")
        .alias("code"),
    )


def caught_up_triggers(streamed: DataFrame, late: DataFrame, poses: DataFrame) -> DataFrame:
    """Streamed triggers merged with crossings among samples seen only afterwards."""
    columns = [*POSE_KEY, "trigger_simulation_time_ps", "trigger_replica_id",
               "trigger_observed_rmsd_angstrom", "max_crossing_angstrom"]
    found = pruning.canonical_trigger(pruning.crossings(late, poses))
    both = streamed.select(*columns).unionByName(found.select(*columns))
    return (
        both.groupBy(*POSE_KEY)
        .agg(
            F.min(F.struct(*columns[2:5])).alias("t"),
            F.max("max_crossing_angstrom").alias("max_crossing_angstrom"),
        )
        .select(*POSE_KEY, "t.*", "max_crossing_angstrom")
    )


def progress(messages: DataFrame) -> DataFrame:
    """Progress messages folded per task while they arrive."""
    return progress_fold(messages)


def failure_runs(
    snapshots: DataFrame, keys: Sequence[str], order: str, limit: int = 3, path: str | None = None
) -> DataFrame:
    """Runs of failed snapshots, also when a run spans micro-batches.

    Returns the runs as (keys, last_success, n_failures, first_failure, last_failure). A
    batch writes only the runs that grew in it, at or beyond the limit.
    """
    log = run_changelog(keyed.failure_runs(snapshots, keys, order, limit), "update", path)
    return latest(log, [*keys, "first_failure"]).select(
        *keys, "last_success", "n_failures", "first_failure", "last_failure"
    )


def export_events(events: DataFrame, log_path: str) -> None:
    """Append state events to a log exactly once.

    Which sequences of a run are in the log is kept as state, so a batch reads no more
    than its own rows. A replayed batch overwrites its own folder. The checkpoint
    belongs to the log.
    """
    drain(keyed.fresh_events(events), changelog(log_path), "append", f"{log_path}/_checkpoint")
