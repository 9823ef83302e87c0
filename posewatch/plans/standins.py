"""The given tables read as the domain tables of this library.

``events`` are RMSD samples, ``orders`` poses, ``lineitem`` replicas and tasks,
``documents`` and ``pages`` files, ``embeddings`` frames or series texts. The
expressions are plain SQL that Spark and the checking engine both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPREAD_ROWS = 20_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A table dealt by its key, so many rows a task that texts made of them stay small.

    A table of few bytes is one split of a scan however long the texts made of its rows are.
    """
    return rows.repartition(max(1, -(-rows.count() // SPREAD_ROWS)), key)


def exprs(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {name}" for name, e in columns.items()]


def select_sql(name: str, columns: dict[str, str], source: str) -> str:
    return f"{name} AS (SELECT {', '.join(exprs(columns))} FROM {source})"


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- samples from events -------------------------------------------------

SAMPLE = {
    "run_id": "concat('run_', user_id % 4)",
    "pose_id": "concat('pose_', user_id)",
    "replica_id": "event_type",
    "rmsd_nm": "value / 1000",
    "event_id": "event_id",
}
SAMPLES_SQL = select_sql("samples", {**SAMPLE, "time_ps": "epoch_us(ts) / 1e6"}, "events")

SAMPLE_POSE = {
    "run_id": "concat('run_', user_id % 4)",
    "pose_id": "concat('pose_', user_id)",
    "n_replicas_requested": "CAST(CASE WHEN user_id % 7 = 0 THEN 6 ELSE 5 END AS INT)",
    "pruned": "user_id % 11 = 0",
    "pruning_threshold_angstrom": "CASE WHEN user_id % 5 <> 0 THEN CAST(2.25 AS DOUBLE) END",
}
SAMPLE_POSES_SQL = select_sql(
    "sample_poses", SAMPLE_POSE, "(SELECT DISTINCT user_id FROM events)"
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    time_ps = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return with_time(table(spark, sf_dir, "events"), time_ps)


def with_time(events: DataFrame, time_ps) -> DataFrame:
    return events.select(*[F.expr(e).alias(n) for n, e in SAMPLE.items()], time_ps.alias("time_ps"))


def sample_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.selectExpr(*exprs(SAMPLE_POSE))


# Every pose has one replica more than the samples show.
SAMPLE_REPLICAS_SQL = """sample_replicas AS (SELECT DISTINCT run_id, pose_id, replica_id FROM samples
  UNION ALL SELECT run_id, pose_id, 'not started' FROM sample_poses)"""


def sample_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = samples(spark, sf_dir).select("run_id", "pose_id", "replica_id").distinct()
    waiting = sample_poses(spark, sf_dir).select("run_id", "pose_id", F.lit("not started").alias("replica_id"))
    return seen.unionByName(waiting)


# --- state tables from orders and lineitem -------------------------------


def run_of(key: str) -> str:
    return f"CASE WHEN {key} % 3 = 0 THEN concat('run_s', {key}) ELSE concat('run_', {key} % 1000) END"


POSE = {
    "run_id": run_of("o_orderkey"),
    "pose_id": "concat('pose_', o_orderkey)",
    "status": (
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'PRUNED' WHEN '2-HIGH' THEN 'INTERRUPTED' "
        "WHEN '5-LOW' THEN 'FAILED' WHEN '4-NOT SPECIFIED' THEN "
        "CASE WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'INCOMPLETE' END ELSE 'RUNNING' END"
    ),
    "n_replicas_requested": "CAST(4 + o_orderkey % 4 AS INT)",
    "pruning_enabled": "o_orderkey % 5 <> 0",
    "pruning_threshold_angstrom": (
        "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(3 + o_orderkey % 3 AS DOUBLE) END"
    ),
    "trigger_replica_id": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'replica_03' END",
    "trigger_simulation_time_ps": (
        "CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderkey AS DOUBLE) END"
    ),
    "trigger_observed_rmsd_angstrom": (
        "CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(5 AS DOUBLE) END"
    ),
    "observed_max_rmsd_angstrom": "CASE WHEN o_orderkey % 4 = 0 THEN CAST(2 AS DOUBLE) END",
    "md_score_angstrom": "CASE WHEN o_orderkey % 9 = 0 THEN CAST(1.5 AS DOUBLE) END",
}
POSES_SQL = select_sql("poses", POSE, "orders")

STATUS = (
    "CASE WHEN rf = ascii('A') AND ls = ascii('F') THEN 'COMPLETED' "
    "WHEN rf = ascii('A') AND ls = ascii('O') THEN 'RUNNING' "
    "WHEN rf = ascii('N') AND ls = ascii('F') THEN 'FAILED' "
    "WHEN rf = ascii('N') AND ls = ascii('O') THEN 'PENDING' "
    "WHEN rf = ascii('R') AND ls = ascii('F') THEN 'INTERRUPTED' ELSE 'COMPLETED' END"
)
PROCESS = (
    "CASE WHEN st <> 'RUNNING' THEN 'NONE' WHEN l_orderkey % 97 = 0 THEN 'NONE' "
    "WHEN disc < 0.05 THEN 'EXITED' ELSE 'RUNNING' END"
)
LINE_SQL = (
    f"line AS (SELECT *, {PROCESS} AS proc FROM (SELECT *, {STATUS} AS st FROM ("
    "SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_suppkey) AS sk, "
    "min(ascii(l_returnflag)) AS rf, min(ascii(l_linestatus)) AS ls, max(l_quantity) AS q, "
    "max(l_discount) AS disc, max(l_tax) AS tax FROM lineitem GROUP BY l_orderkey, l_linenumber)))"
)
REPLICA_NAME = "concat('replica_', lpad(CAST(l_linenumber AS STRING), 2, '0'))"
LINE_KEY = {
    "run_id": run_of("l_orderkey"),
    "pose_id": "concat('pose_', l_orderkey)",
    "replica_id": REPLICA_NAME,
}
REPLICA = {
    **LINE_KEY,
    "velocity_seed": "CAST(pk + 1 AS INT)",
    "resolved_ntomp": "CAST(l_linenumber % 3 AS INT)",
    "status": "st",
    "gpu_id": "CAST(sk % 8 AS INT)",
    "stage_reached": "CASE WHEN disc > 0.05 THEN 'production' ELSE 'nvt' END",
    "trajectory_time_completed_ps": "q * 100",
    "max_rmsd_nm": "CASE WHEN st <> 'PENDING' AND l_linenumber % 6 <> 0 THEN q / 100 END",
    "max_rmsd_angstrom": (
        "CASE WHEN st <> 'PENDING' AND l_linenumber % 6 <> 0 THEN q / 100 * 10 END"
    ),
    "triggered_pruning": "l_orderkey % 13 = 0",
    "exit_code": "CAST(CASE st WHEN 'FAILED' THEN 2 WHEN 'COMPLETED' THEN 0 END AS INT)",
}
REPLICAS_SQL = select_sql("replicas", REPLICA, "line")

TASK = {
    "task_id": f"concat('pose_', l_orderkey, ':', {REPLICA_NAME})",
    **LINE_KEY,
    "status": "st",
    "assigned_gpu_id": "CAST(sk % 8 AS INT)",
    "resolved_ntomp": "CAST(l_linenumber % 3 AS INT)",
    "claim_token": (
        "CASE WHEN st = 'RUNNING' THEN concat('tok_', l_orderkey, '_', l_linenumber) END"
    ),
    "stop_requested": "st = 'RUNNING' AND tax > 0.06",
    "last_error": "CASE WHEN tax > 0.06 AND l_linenumber % 2 = 0 THEN 'user stop requested' END",
    "process_pid": "CAST(CASE WHEN proc <> 'NONE' THEN 1000 + l_linenumber END AS INT)",
    "process_start_token": (
        "CASE WHEN proc <> 'NONE' AND l_orderkey % 101 <> 0 THEN 'started' END"
    ),
    "process_state": "proc",
    "process_returncode": (
        "CAST(CASE WHEN proc = 'EXITED' THEN CASE l_linenumber % 3 WHEN 0 THEN 0 "
        "WHEN 1 THEN 1 ELSE 143 END END AS INT)"
    ),
    "process_finished_at": "CASE WHEN proc = 'EXITED' THEN 'ended' END",
    "process_step_id": "CASE WHEN l_linenumber % 4 <> 0 THEN concat('step_', l_linenumber) END",
    "heartbeat_write_count": "CAST(q AS INT)",
    "probe_status": (
        "CASE WHEN l_orderkey % 89 = 0 THEN 'MATCHING_LIVE' WHEN l_orderkey % 83 = 0 THEN NULL "
        "WHEN l_linenumber % 2 = 0 THEN 'EXITED' ELSE 'PID_REUSED' END"
    ),
}
TASKS_SQL = select_sql("tasks", TASK, "line")

RUN = {
    "run_id": "run_id",
    "status": "'RUNNING'",
    "stop_requested": "length(run_id) % 2 = 0",
    "resume_count": "CAST(0 AS INT)",
}
RUNS_SQL = select_sql(
    "runs", RUN, f"(SELECT DISTINCT {run_of('o_orderkey')} AS run_id FROM orders)"
)
STATE_SQL = [LINE_SQL, POSES_SQL, REPLICAS_SQL, TASKS_SQL, RUNS_SQL]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("pk"),
        F.min("l_suppkey").alias("sk"),
        F.min(F.ascii("l_returnflag")).alias("rf"),
        F.min(F.ascii("l_linestatus")).alias("ls"),
        F.max("l_quantity").alias("q"),
        F.max("l_discount").alias("disc"),
        F.max("l_tax").alias("tax"),
    )
    return merged.selectExpr("*", f"{STATUS} AS st").selectExpr("*", f"{PROCESS} AS proc")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*exprs(POSE))


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr(*exprs(REPLICA))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr(*exprs(TASK))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").selectExpr(f"{run_of('o_orderkey')} AS run_id").distinct()
    return keys.selectExpr(*exprs(RUN))


# --- messages from events ------------------------------------------------

THIRD = "CAST((event_id - event_id % 3) / 3 AS BIGINT)"
MESSAGE = {
    "run_id": run_of(THIRD),
    "pose_id": f"concat('pose_', {THIRD})",
    "replica_id": "concat('replica_0', 1 + user_id % 3)",
    "task_id": f"concat('pose_', {THIRD}, ':replica_0', 1 + user_id % 3)",
    "claim_token": (
        f"CASE WHEN event_id % 10 = 0 THEN 'stale' ELSE concat('tok_', {THIRD}, '_', 1 + user_id % 3) END"
    ),
    "sequence": "event_id",
    "status": (
        "CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' "
        "WHEN 'click' THEN 'INTERRUPTED' WHEN 'view' THEN 'PRUNED' ELSE 'SKIPPED' END"
    ),
    "stage_reached": "event_type",
    "trajectory_time_completed_ps": "value",
    "max_rmsd_nm": "CASE WHEN event_id % 2 = 0 THEN value / 1000 END",
    "max_rmsd_angstrom": "CASE WHEN event_id % 2 = 0 THEN value / 100 END",
    "exit_code": "CAST(event_id % 5 AS INT)",
    "error": "CASE WHEN event_type = 'error' THEN 'broken' END",
    "rmsd_angstrom": "value / 10",
    "time_ps": "CAST(event_id AS DOUBLE)",
}
MESSAGES_SQL = select_sql("messages", MESSAGE, "events")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*exprs(MESSAGE))
