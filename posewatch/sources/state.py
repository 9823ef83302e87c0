"""State tables as partitioned parquet snapshots, and the log of exported events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posewatch import schemas

POINTER = "_current"


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The current snapshot of one state table."""
    if table not in schemas.STATE_TABLES:
        raise ValueError(f"unsupported state table: {table}")
    version = spark.read.schema("version string").json(f"{root}/{table}/{POINTER}").first()[0]
    return spark.read.schema(schemas.STATE_TABLES[table]).parquet(f"{root}/{table}/{version}")


def write_table(df: DataFrame, root: str, table: str) -> None:
    """Write a new snapshot, then switch the pointer to it.

    Parquet has no row update. Readers keep the old snapshot until the one-row
    pointer is replaced, so a failed write changes nothing.
    """
    if table not in schemas.STATE_TABLES:
        raise ValueError(f"unsupported state table: {table}")
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    # The rebalance step writes few files per run and splits a run that is too large.
    df.hint("rebalance", "run_id").write.mode("errorifexists").partitionBy("run_id").parquet(
        f"{root}/{table}/{version}"
    )
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode(
        "overwrite"
    ).json(f"{root}/{table}/{POINTER}")


def ordered(df: DataFrame, table: str) -> DataFrame:
    return df.orderBy(*schemas.STATE_ORDER[table])


def replace_artifacts(artifacts: DataFrame, path: str, runs: DataFrame) -> None:
    """Replace the artifact rows of ``runs`` by those in ``artifacts``; other runs stay.

    Only written partitions are overwritten, so a run that keeps no artifact gets
    one row without a path, which ``read_artifacts`` leaves out.
    """
    emptied = runs.select("run_id").distinct().join(
        artifacts.select("run_id").distinct(), "run_id", "left_anti"
    )
    (
        artifacts.join(runs.select("run_id").distinct(), "run_id", "left_semi")
        .unionByName(emptied, allowMissingColumns=True)
        .hint("rebalance", "run_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(schemas.ARTIFACTS)
        .parquet(path)
        .filter(F.col("artifact_path").isNotNull())
    )


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed structured log events; malformed lines are skipped."""
    return parse_event_log(spark.read.text(path))


def parse_event_log(lines: DataFrame) -> DataFrame:
    """As ``read_event_log`` for a table with the log lines in ``value``."""
    entry = F.from_json("value", schemas.LOG_EVENT, {"mode": "PERMISSIVE"})
    return (
        lines.filter(F.trim("value") != "")
        .select(entry.alias("e"))
        .filter(F.col("e._corrupt_record").isNull())
        .select("e.*")
        .drop("_corrupt_record")
    )


def state_sequence(params: Column) -> Column:
    """The integer ``state_sequence`` of a parameter text, null for any other type."""
    return F.from_json(params, "state_sequence bigint")["state_sequence"]


def exported_sequences(log: DataFrame) -> DataFrame:
    return (
        log.select("run_id", state_sequence(F.col("params")).alias("sequence"))
        .filter(F.col("sequence").isNotNull())
        .distinct()
    )


def not_exported(events: DataFrame, exported: DataFrame) -> DataFrame:
    return events.join(exported, ["run_id", "sequence"], "left_anti")


def as_log_events(events: DataFrame) -> DataFrame:
    """State events in the structured log form."""
    params = F.concat(
        F.lit('{"state_payload": '),
        F.col("payload_json"),
        F.lit(', "state_sequence": '),
        F.col("sequence").cast("string"),
        F.lit("}"),
    )
    return events.select(
        "run_id",
        "pose_id",
        F.lit("runtime.state").alias("step_id"),
        F.lit("INFO").alias("level"),
        "category",
        F.lit("OBSERVED").alias("status"),
        "code",
        F.concat(
            F.lit("Observed authoritative state transition "), F.col("code"), F.lit(".")
        ).alias("message"),
        params.alias("params"),
    )
