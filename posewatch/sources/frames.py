"""Trajectory frames: one row per frame with an array of xyz triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posewatch.schemas import FRAMES


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def read_frame_documents(spark: SparkSession, path: str) -> DataFrame:
    """Frames of JSON trajectory documents ``{box_nm, frames: [{time_ps, coordinates_nm}]}``."""
    schema = "box_nm double, frames array<struct<time_ps:double,coordinates_nm:array<array<double>>>>"
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .json(path)
        .select(
            F.input_file_name().alias("trajectory_id"),
            "box_nm",
            F.posexplode("frames").alias("n", "f"),
        )
        .select(
            "trajectory_id",
            F.col("n").cast("bigint").alias("frame_no"),
            F.col("f.time_ps").alias("time_ps"),
            "box_nm",
            F.col("f.coordinates_nm").alias("xyz"),
        )
    )


def atoms_long(frames: DataFrame) -> DataFrame:
    """(frame columns, atom, x, y, z); atoms are numbered from 1."""
    return frames.select(
        "trajectory_id", "frame_no", "time_ps", "box_nm", F.posexplode("xyz").alias("i", "c")
    ).select(
        "trajectory_id",
        "frame_no",
        "time_ps",
        "box_nm",
        (F.col("i") + 1).alias("atom"),
        F.get("c", F.lit(0)).alias("x"),
        F.get("c", F.lit(1)).alias("y"),
        F.get("c", F.lit(2)).alias("z"),
    )
