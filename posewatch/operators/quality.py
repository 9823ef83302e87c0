"""Keys, references, values and lifecycle of the state tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posewatch.schemas import EVENT_CATEGORIES, POSE_STATUSES, PROCESS_STATES, RUN_STATUSES, TASK_STATUSES


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def key_report(checks: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Duplicates of several tables in one table (check, key text, n)."""
    parts = [
        duplicates(df, key).select(
            F.lit(name).alias("check_name"), F.concat_ws("|", *key).alias("key"), "n"
        )
        for name, (df, key) in checks.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def orphans(child: DataFrame, parent: DataFrame, key: Sequence[str]) -> DataFrame:
    """Child rows without a parent row.

    The parent side is reduced to its keys first; the child side, which may have
    hot keys, stays on the left.
    """
    return child.join(parent.select(*key).distinct(), list(key), "left_anti")


def violations(df: DataFrame, table: str, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(table, key, reason) for each rule that holds."""
    hit = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return df.select(
        F.lit(table).alias("table_name"), key.alias("key"), F.explode(hit).alias("reason")
    )


def task_rules() -> dict[str, Column]:
    state, status = F.col("process_state"), F.col("status")
    pid, token = F.col("process_pid"), F.col("process_start_token")
    code, ended = F.col("process_returncode"), F.col("process_finished_at")
    return {
        "unknown status": ~status.isin(*TASK_STATUSES),
        "unknown process state": ~state.isin(*PROCESS_STATES),
        "exit evidence incomplete": (state == "EXITED")
        & (pid.isNull() | token.isNull() | code.isNull() | ended.isNull()),
        "running process has exit evidence": (state == "RUNNING")
        & (code.isNotNull() | ended.isNotNull()),
        "resolved_ntomp not positive": F.col("resolved_ntomp") < 1,
        "negative heartbeat count": F.col("heartbeat_write_count") < 0,
    }


def pose_rules() -> dict[str, Column]:
    return {
        "unknown status": ~F.col("status").isin(*POSE_STATUSES),
        "n_replicas_requested not positive": F.col("n_replicas_requested") < 1,
        "enabled without threshold": F.col("pruning_enabled")
        & F.col("pruning_threshold_angstrom").isNull(),
        "score without completion": (F.col("status") != "COMPLETED")
        & F.col("md_score_angstrom").isNotNull(),
    }


def run_rules() -> dict[str, Column]:
    return {"unknown status": ~F.col("status").isin(*RUN_STATUSES)}


def event_rules() -> dict[str, Column]:
    return {"unknown category": ~F.col("category").isin(*EVENT_CATEGORIES)}
