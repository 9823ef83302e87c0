"""Session settings and scratch folders shared by the jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the jobs rely on. Hot join keys are split by the adaptive
# skew join, also where that costs one more exchange. Generated methods above 8000
# bytes of code are never compiled by the JVM, so larger ones are not fused. Stream
# state lives on disk, as it has one row per replica or sample; a batch saves its changes.
# A partition's store of a stream that ended holds 4 MB until the next maintenance.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to the caller's session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Where the setting is absent, a local
    one is made only if driver and executors are one process, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the scratch folder and read it back.

    The written files replace the lineage, so a lost executor re-reads instead of
    recomputing every earlier step.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of each query run inside as soon as it ends.

    For jobs of many written tables, whose shuffle files would else stay on disk until the
    driver collects its garbage.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
