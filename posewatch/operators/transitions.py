"""State transitions: current tables in, next tables and event rows out.

Every function is a whole-table transition over any number of runs. Lists that
belong to an event (skipped tasks, member poses) are rows of an ``event_members``
table and not arrays in the payload, so a very large pose or run stays spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posewatch.functions.documents import document_lines, json_text
from posewatch.operators import prefix
from posewatch.operators.score import POSE_KEY, REPLICA_KEY
from posewatch.schemas import FINISH_STATUSES, PROCESS_STATES, RUN_SCOPE
from posewatch.session import materialise

Tables = dict[str, DataFrame]

NO_PROCESS: dict[str, Column | None] = {
    "process_pid": None,
    "process_start_token": None,
    "process_state": "NONE",
    "process_returncode": None,
    "process_finished_at": None,
    "process_step_id": None,
}
NO_CLAIM = {"claimed_by": None, "claim_token": None, "claimed_at": None}


def _set(df: DataFrame, when: Column, values: dict) -> DataFrame:
    """Assign columns where a condition holds; columns the table lacks are left out."""
    out = {}
    for name, value in values.items():
        if name not in df.columns:
            continue
        new = value if isinstance(value, Column) else F.lit(value)
        out[name] = F.when(when, new.cast(df.schema[name].dataType)).otherwise(F.col(name))
    return df.withColumns(out)


def _event(keys, category: str, code: Column | str, payload: Column) -> list[Column]:
    return [
        *keys,
        F.lit(category).alias("category"),
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        payload.alias("payload_json"),
    ]


def _payload(*fields) -> Column:
    """JSON object; the fields are given in the order of their names, as the contract sorts keys."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def append_events(events: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """Rows of the event table for the events of one step.

    The numbers of a run go on after its greatest stored one, without gaps: events of
    poses by pose, then those of the run as a whole. All have the step's time.
    """
    whole_run = F.col("pose_id") == RUN_SCOPE
    rows = prefix.scan(
        materialise(events.withColumn("__whole_run", whole_run), "step-events"),
        ["run_id"], ["__whole_run", "pose_id", "code", "payload_json"], "number", "sequence",
    )
    last = stored.groupBy("run_id").agg(F.max("sequence").alias("__last"))
    return rows.join(last, "run_id", "left").select(
        (F.col("sequence") + F.coalesce("__last", F.lit(0))).alias("sequence"),
        "run_id", "pose_id", now.alias("ts"), "category", "code", "payload_json",
    )


# --- pruning -------------------------------------------------------------


def accepted_triggers(poses: DataFrame, triggers: DataFrame) -> DataFrame:
    """Triggers with the state of their pose and the reason they are refused.

    ``triggers`` has one row per reporting replica (first crossing). The reason is
    null when the trigger counts.
    """
    reason = (
        F.when(F.col("p.status").isNull(), "pose does not exist")
        .when(~F.col("p.pruning_enabled"), "pruning is disabled")
        .when(
            F.col("p.pruning_threshold_angstrom").isNull()
            | (F.col("rmsd_angstrom") <= F.col("p.pruning_threshold_angstrom")),
            "trigger does not exceed the threshold",
        )
        .when(~F.col("p.status").isin("RUNNING", "PRUNED"), "pose is in another state")
    )
    state = poses.select(
        *POSE_KEY,
        F.struct(
            "status", "pruning_enabled", "pruning_threshold_angstrom", "trigger_replica_id",
            "trigger_simulation_time_ps", "trigger_observed_rmsd_angstrom",
        ).alias("p"),
    )
    return triggers.join(state, POSE_KEY, "left").withColumn("refusal", reason)


def pruning_verdicts(good: DataFrame) -> DataFrame:
    """Verdict per pose from its accepted triggers.

    The canonical trigger is the least (time, replica) over the stored one and all
    new ones.
    """
    stored = F.when(
        F.col("p.trigger_replica_id").isNotNull(),
        F.struct(
            F.col("p.trigger_simulation_time_ps").alias("time_ps"),
            F.col("p.trigger_replica_id").alias("replica_id"),
            F.col("p.trigger_observed_rmsd_angstrom").alias("rmsd_angstrom"),
        ),
    )
    return (
        good.groupBy(*POSE_KEY)
        .agg(
            F.min(F.struct("time_ps", "replica_id", "rmsd_angstrom")).alias("reported"),
            F.max("rmsd_angstrom").alias("largest"),
            F.bool_and(F.col("p.status") == "RUNNING").alias("first_transition"),
            F.min(stored).alias("stored"),
        )
        .withColumn("canonical", F.least("reported", "stored"))
        .drop("stored")
    )


def apply_pruning(
    poses: DataFrame, replicas: DataFrame, tasks: DataFrame, triggers: DataFrame, now: Column
) -> Tables:
    """Prune poses with a crossing, skip what is pending and stop what runs."""
    # All five result tables read the verdicts, so these few rows are written once.
    judged = materialise(accepted_triggers(poses, triggers), "triggers")
    good = judged.filter(F.col("refusal").isNull())
    verdicts = pruning_verdicts(good)

    marked = poses.join(verdicts, POSE_KEY, "left")
    hit = F.col("canonical").isNotNull()
    new_poses = _set(
        marked,
        hit,
        {
            "status": "PRUNED",
            "md_score_angstrom": None,
            "observed_max_rmsd_angstrom": F.greatest(
                F.coalesce("observed_max_rmsd_angstrom", F.lit(0.0)), F.col("largest")
            ),
            "trigger_replica_id": F.col("canonical.replica_id"),
            "trigger_simulation_time_ps": F.col("canonical.time_ps"),
            "trigger_observed_rmsd_angstrom": F.col("canonical.rmsd_angstrom"),
            "finished_at": F.coalesce("finished_at", now),
        },
    ).select(*poses.columns)

    started = verdicts.filter("first_transition").select(
        *POSE_KEY, F.col("reported.replica_id").alias("__first")
    )
    staged = tasks.join(started, POSE_KEY, "left")
    begins = F.col("__first").isNotNull()
    skipped = begins & (F.col("status") == "PENDING")
    stopped = begins & (F.col("status") == "RUNNING") & (F.col("replica_id") != F.col("__first"))
    staged = staged.withColumn(
        "__role",
        F.when(skipped, "skipped_task").when(stopped, "stop_requested_task"),
    )
    new_tasks = _set(
        _set(
            staged,
            F.col("__role") == "skipped_task",
            {"status": "SKIPPED", "last_error": "pose pruned"},
        ),
        F.col("__role") == "stop_requested_task",
        {"stop_requested": True, "last_error": "sibling triggered pruning"},
    ).select(*tasks.columns)

    flagged = good.select(*REPLICA_KEY).distinct().withColumn("__flag", F.lit(True))
    with_flag = replicas.join(started, POSE_KEY, "left").join(flagged, REPLICA_KEY, "left")
    new_replicas = _set(
        _set(
            with_flag,
            begins & (F.col("status") == "PENDING"),
            {"status": "SKIPPED", "finished_at": now},
        ),
        F.col("__flag").isNotNull(),
        {"triggered_pruning": True},
    ).select(*replicas.columns)

    def trigger(of: str, name: str) -> Column:
        return F.struct(
            F.col(f"{of}rmsd_angstrom").alias("observed_rmsd_angstrom"),
            F.col(f"{of}replica_id").alias("replica_id"),
            F.col(f"{of}time_ps").alias("simulation_time_ps"),
        ).alias(name)

    opening = F.col("first_transition") & (F.col("replica_id") == F.col("reported.replica_id"))
    events = good.join(verdicts, POSE_KEY).select(
        *_event(
            POSE_KEY,
            "PRUNING",
            F.when(opening, "POSE_PRUNED").otherwise("PRUNING_TRIGGER_OBSERVED"),
            _payload(
                trigger("canonical.", "canonical_trigger"),
                trigger("", "observed_trigger"),
                "pose_id",
            ),
        )
    )
    members = staged.filter(F.col("__role").isNotNull()).select(
        *POSE_KEY,
        F.lit("POSE_PRUNED").alias("code"),
        F.col("__role").alias("role"),
        F.col("task_id").alias("member"),
    )
    return {
        "poses": new_poses,
        "replicas": new_replicas,
        "tasks": new_tasks,
        "events": events,
        "event_members": members,
        "refused": judged.filter(F.col("refusal").isNotNull()).drop("p"),
    }


# --- completion and progress --------------------------------------------


def _owned(tasks: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages whose claim token is the one of a running task."""
    owners = tasks.filter((F.col("status") == "RUNNING") & F.col("claim_token").isNotNull()).select(
        "task_id", *REPLICA_KEY, "claim_token"
    )
    return messages.drop(*REPLICA_KEY).join(owners, ["task_id", "claim_token"])


def apply_completion(
    tasks: DataFrame, replicas: DataFrame, completions: DataFrame, now: Column
) -> Tables:
    """Finish tasks. Maxima are overwritten, also with null.

    A claim ends with its first valid completion; later ones and those of other
    owners are refused.
    """
    fields = ["stage_reached", "trajectory_time_completed_ps", "max_rmsd_nm", "max_rmsd_angstrom",
              "exit_code"]
    valid = completions.filter(F.col("status").isin(*FINISH_STATUSES))
    first = (
        _owned(tasks, valid)
        .select("task_id", *REPLICA_KEY, F.struct("sequence", "status", *fields, "error").alias("d"))
        .groupBy("task_id", *REPLICA_KEY)
        .agg(F.min_by("d", "d.sequence").alias("d"))
    )
    ended = F.col("d").isNotNull()
    new_tasks = _set(
        tasks.join(first.select("task_id", "d"), "task_id", "left"),
        ended,
        {
            "status": F.col("d.status"),
            "claimed_by": None,
            "claim_token": None,
            "heartbeat_at": now,
            "stop_requested": False,
            "last_error": F.col("d.error"),
            **NO_PROCESS,
        },
    ).select(*tasks.columns)
    new_replicas = _set(
        replicas.join(first.select(*REPLICA_KEY, "d"), REPLICA_KEY, "left"),
        ended,
        {
            "status": F.col("d.status"),
            **{name: F.col(f"d.{name}") for name in fields},
            "finished_at": now,
        },
    ).select(*replicas.columns)
    events = first.select(
        *_event(
            POSE_KEY,
            "STATE",
            F.concat(F.lit("TASK_"), F.col("d.status")),
            _payload(F.col("d.exit_code").alias("exit_code"), "task_id"),
        )
    )
    refused = completions.join(
        first.select("task_id", F.col("d.sequence").alias("sequence")),
        ["task_id", "sequence"],
        "left_anti",
    )
    return {"tasks": new_tasks, "replicas": new_replicas, "events": events, "refused": refused}


def progress_fold(messages: DataFrame) -> DataFrame:
    """Last stage and time, last known maxima and message count per task."""
    seq = F.col("sequence")

    def last_known(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), seq)).alias(name)

    return messages.groupBy("task_id", *REPLICA_KEY).agg(
        F.max_by("stage_reached", seq).alias("stage_reached"),
        F.max_by("trajectory_time_completed_ps", seq).alias("trajectory_time_completed_ps"),
        last_known("max_rmsd_nm"),
        last_known("max_rmsd_angstrom"),
        F.count("*").alias("n_heartbeats"),
    )


def apply_progress(tasks: DataFrame, replicas: DataFrame, messages: DataFrame, now: Column) -> Tables:
    """Stage and time are overwritten, maxima kept when the message has none."""
    owned = _owned(tasks, messages)
    fold = progress_fold(owned).select(
        "task_id", *REPLICA_KEY, F.struct(
            "stage_reached", "trajectory_time_completed_ps", "max_rmsd_nm", "max_rmsd_angstrom",
            "n_heartbeats").alias("d")
    )
    touched = F.col("d").isNotNull()
    new_tasks = _set(
        tasks.join(fold.select("task_id", "d"), "task_id", "left"),
        touched,
        {
            "heartbeat_at": now,
            "heartbeat_write_count": F.col("heartbeat_write_count") + F.col("d.n_heartbeats"),
        },
    ).select(*tasks.columns)
    new_replicas = _set(
        replicas.join(fold.select(*REPLICA_KEY, "d"), REPLICA_KEY, "left"),
        touched,
        {
            "stage_reached": F.col("d.stage_reached"),
            "trajectory_time_completed_ps": F.col("d.trajectory_time_completed_ps"),
            "max_rmsd_nm": F.coalesce("d.max_rmsd_nm", "max_rmsd_nm"),
            "max_rmsd_angstrom": F.coalesce("d.max_rmsd_angstrom", "max_rmsd_angstrom"),
        },
    ).select(*replicas.columns)
    events = owned.select(
        *_event(
            POSE_KEY,
            "STATE",
            "REPLICA_PROGRESS",
            _payload("stage_reached", "task_id", "trajectory_time_completed_ps"),
        )
    )
    return {"tasks": new_tasks, "replicas": new_replicas, "events": events}


# --- stop ----------------------------------------------------------------


def apply_stop(
    runs: DataFrame, poses: DataFrame, replicas: DataFrame, tasks: DataFrame,
    requests: DataFrame, now: Column,
) -> Tables:
    """Interrupt the requested runs; running tasks only get a stop flag."""
    wanted = requests.select("run_id").distinct().withColumn("__stop", F.lit(True))

    def marked(df: DataFrame) -> DataFrame:
        return df.join(wanted, "run_id", "left")

    asked = F.col("__stop").isNotNull()
    pending, running = F.col("status") == "PENDING", F.col("status") == "RUNNING"
    reason = "user stop requested"
    new_runs = _set(
        marked(runs), asked, {"stop_requested": True, "status": "INTERRUPTED", "updated_at": now}
    ).select(*runs.columns)
    staged = marked(tasks)
    new_tasks = staged.withColumns(
        {
            "stop_requested": F.when(asked & running, True).otherwise(F.col("stop_requested")),
            "last_error": F.when(asked & (pending | running), F.lit(reason)).otherwise(
                F.col("last_error")
            ),
            "status": F.when(asked & pending, "INTERRUPTED").otherwise(F.col("status")),
        }
    ).select(*tasks.columns)
    new_replicas = _set(
        marked(replicas), asked & pending, {"finished_at": now, "status": "INTERRUPTED"}
    ).select(*replicas.columns)
    new_poses = _set(
        marked(poses), asked & (pending | running), {"finished_at": now, "status": "INTERRUPTED"}
    ).select(*poses.columns)
    events = runs.join(wanted, "run_id", "left_semi").select(
        *_event(
            ["run_id", F.lit(RUN_SCOPE).alias("pose_id")], "STATE", "STOP_REQUESTED", F.lit("{}")
        )
    )
    members = staged.filter(asked & running).select(
        "run_id",
        F.lit(RUN_SCOPE).alias("pose_id"),
        F.lit("STOP_REQUESTED").alias("code"),
        F.lit("running_task").alias("role"),
        F.col("task_id").alias("member"),
    )
    return {
        "runs": new_runs, "poses": new_poses, "replicas": new_replicas, "tasks": new_tasks,
        "events": events, "event_members": members,
    }


# --- resume --------------------------------------------------------------


def resume_decisions(runs: DataFrame, poses: DataFrame, tasks: DataFrame) -> DataFrame:
    """What a resume makes of every running task.

    ``probe_status`` is the result of looking at the recorded process (MATCHING_LIVE,
    EXITED, PID_REUSED, UNVERIFIABLE). Outcomes that start with REFUSED block the
    whole run.
    """
    run_stop = runs.select("run_id", F.col("stop_requested").alias("run_stop"))
    pose_status = poses.select(*POSE_KEY, F.col("status").alias("pose_status"))
    state = F.col("process_state")
    pid, token = F.col("process_pid"), F.col("process_start_token")
    code, ended = F.col("process_returncode"), F.col("process_finished_at")
    exited = state == "EXITED"
    # Texts stored in the tables.
    evidence = (
        F.when(F.col("stop_requested"), F.coalesce(F.nullif("last_error", F.lit("")),
                                                   F.lit("persisted task stop intent")))
        .when(F.col("pose_status") == "PRUNED", "persisted pose PRUNED state")
        .when(F.col("run_stop"), "persisted run stop intent")
    )
    outcome = (
        F.when(~state.isin(*PROCESS_STATES), "REFUSED_UNKNOWN_STATE")
        .when(
            exited & (pid.isNull() | token.isNull() | code.isNull() | ended.isNull()),
            "REFUSED_INCOMPLETE_EXIT",
        )
        .when(exited & (code == 0), "DURABLE_EXITED_SUCCESS")
        .when(exited & evidence.isNotNull(), "DURABLE_EXITED_INTERRUPTED")
        .when(exited, "DURABLE_EXITED_FAILED")
        .when((state != "RUNNING") | pid.isNull() | token.isNull(), "REFUSED_NO_IDENTITY")
        .when(code.isNotNull() | ended.isNotNull(), "REFUSED_CONTRADICTORY")
        .when(F.col("probe_status") == "MATCHING_LIVE", "REFUSED_LIVE_PROCESS")
        .when(
            F.coalesce("probe_status", F.lit("UNVERIFIABLE")) == "UNVERIFIABLE",
            "REFUSED_UNVERIFIABLE",
        )
        .otherwise(F.col("probe_status"))
    )
    # Texts stored in the tables.
    step = F.coalesce(F.nullif("process_step_id", F.lit("")), F.lit("unknown command step"))
    reason = F.when(
        F.col("outcome") == "DURABLE_EXITED_INTERRUPTED",
        F.concat(step, F.lit(" exited with code "), code,
                 F.lit(" after cooperative cancellation: "), F.col("evidence")),
    ).when(
        F.col("outcome") == "DURABLE_EXITED_FAILED",
        F.concat(step, F.lit(" exited with code "), code,
                 F.lit(" without durable cooperative cancellation evidence")),
    )
    return (
        tasks.filter(F.col("status") == "RUNNING")
        .join(pose_status, POSE_KEY)
        .join(run_stop, "run_id")
        .withColumn("evidence", evidence)
        .withColumn("outcome", outcome)
        .withColumn("reason", reason)
        .select(
            "task_id", *REPLICA_KEY, "outcome", "evidence", "reason",
            "process_returncode", "process_step_id",
        )
    )


def reconcile_resume(
    runs: DataFrame, poses: DataFrame, replicas: DataFrame, tasks: DataFrame, now: Column,
    retry: bool = False,
) -> Tables:
    """Bring interrupted work back to pending.

    Runs with a refused task stay as they are and are listed in ``refused``.
    """
    # Read by every result table; one row per running task, written once.
    decisions = materialise(resume_decisions(runs, poses, tasks), "decisions")
    refused = decisions.filter(F.col("outcome").startswith("REFUSED"))
    blocked = refused.select("run_id").distinct().withColumn("__blocked", F.lit(True))
    pose_state = poses.select(*POSE_KEY, F.col("status").alias("pose_status"))
    verdict = decisions.select(
        *REPLICA_KEY, "outcome", "reason", F.col("process_returncode").alias("__code")
    )

    def with_verdict(df: DataFrame) -> DataFrame:
        return (
            df.join(pose_state, POSE_KEY, "left")
            .join(verdict, REPLICA_KEY, "left")
            .join(blocked, "run_id", "left")
        )

    free = F.col("__blocked").isNull()
    alive = F.coalesce(F.col("pose_status") != "PRUNED", F.lit(False))
    failed = free & (F.coalesce("outcome", F.lit("")) == "DURABLE_EXITED_FAILED")
    cooperative = free & (F.coalesce("outcome", F.lit("")) == "DURABLE_EXITED_INTERRUPTED")

    t = with_verdict(tasks)
    t = _set(t, cooperative & (F.col("status") == "RUNNING"), {"last_error": F.col("reason")})
    t = _set(
        t,
        failed & (F.col("status") == "RUNNING"),
        {**NO_CLAIM, "heartbeat_at": now, "stop_requested": False, "last_error": F.col("reason"),
         "status": "FAILED"},
    )
    t = _set(
        t,
        free & (F.col("status") == "RUNNING"),
        {**NO_CLAIM, "heartbeat_at": None, "stop_requested": False, **NO_PROCESS,
         "status": "INTERRUPTED"},
    )
    t = _set(
        t,
        free & alive & (F.col("status") == "INTERRUPTED"),
        {"last_error": None, "stop_requested": False, "status": "PENDING"},
    )
    new_tasks = t.select(*tasks.columns, "__blocked", "pose_status")

    r = with_verdict(replicas)
    r = _set(
        r,
        failed | cooperative,
        {
            "gpu_id": None,
            "exit_code": F.col("__code"),
            "finished_at": now,
            "status": F.when(failed, "FAILED").otherwise("INTERRUPTED"),
        },
    )
    r = _set(
        r,
        free & (F.col("status") == "RUNNING"),
        {"gpu_id": None, "finished_at": now, "status": "INTERRUPTED"},
    )
    r = _set(
        r,
        free & alive & (F.col("status") == "INTERRUPTED"),
        {"exit_code": None, "finished_at": None, "status": "PENDING"},
    )
    new_replicas = r.select(*replicas.columns, "__blocked", "pose_status")

    retry_events = None
    if retry:
        new_tasks, new_replicas, retry_events = _requeue(new_tasks, new_replicas, free & alive)
    new_tasks = new_tasks.select(*tasks.columns)
    new_replicas = new_replicas.select(*replicas.columns)

    waiting = (
        new_tasks.filter(F.col("status") == "PENDING").select(*POSE_KEY).distinct()
        .withColumn("__waiting", F.lit(True))
    )
    new_poses = _set(
        poses.join(waiting, POSE_KEY, "left").join(blocked, "run_id", "left"),
        free & F.col("__waiting").isNotNull()
        & F.col("status").isin("INTERRUPTED", "INCOMPLETE", "FAILED"),
        {"finished_at": None, "status": "RUNNING"},
    ).select(*poses.columns)
    new_runs = _set(
        runs.join(blocked, "run_id", "left"),
        free,
        {"status": "RUNNING", "stop_requested": False, "updated_at": now,
         "resume_count": F.col("resume_count") + 1},
    ).select(*runs.columns)

    durable = decisions.join(blocked, "run_id", "left_anti").filter(
        F.col("outcome").isin("DURABLE_EXITED_INTERRUPTED", "DURABLE_EXITED_FAILED")
    )
    exit_failed = F.col("outcome") == "DURABLE_EXITED_FAILED"
    command = ["process_step_id", F.col("process_returncode").alias("returncode"), "task_id"]
    events = durable.select(
        *_event(
            POSE_KEY,
            "STATE",
            F.when(exit_failed, "DURABLE_COMMAND_EXIT_FAILED")
            .otherwise("DURABLE_COMMAND_EXIT_INTERRUPTED"),
            F.when(exit_failed, _payload(command[0], "reason", *command[1:]))
            .otherwise(_payload(F.col("evidence").alias("cooperative_evidence"), *command)),
        )
    )
    stale = (
        decisions.filter(F.col("outcome") != "DURABLE_EXITED_FAILED")
        .groupBy("run_id")
        .agg(F.count("*").alias("n"))
    )
    resumed = runs.join(blocked, "run_id", "left_anti").join(stale, "run_id", "left").select(
        *_event(
            ["run_id", F.lit(RUN_SCOPE).alias("pose_id")],
            "STATE",
            "RUN_RESUMED",
            _payload(F.lit(retry).alias("retry_failed"),
                     F.coalesce("n", F.lit(0)).alias("stale_running_recovered")),
        )
    )
    events = events.unionByName(resumed)
    if retry_events is not None:
        events = events.unionByName(retry_events)
    # How each running task was recovered; the role is its outcome.
    members = decisions.join(blocked, "run_id", "left_anti").select(
        "run_id",
        F.lit(RUN_SCOPE).alias("pose_id"),
        F.lit("RUN_RESUMED").alias("code"),
        F.col("outcome").alias("role"),
        F.col("task_id").alias("member"),
    )
    return {
        "runs": new_runs, "poses": new_poses, "replicas": new_replicas, "tasks": new_tasks,
        "events": events, "event_members": members, "decisions": decisions, "refused": refused,
    }


def _requeue(tasks: DataFrame, replicas: DataFrame, allowed: Column):
    failed = allowed & (F.col("status") == "FAILED")
    codes = replicas.select(*REPLICA_KEY, F.col("exit_code").alias("__exit"))
    events = tasks.filter(failed).join(codes, REPLICA_KEY).select(
        *_event(
            POSE_KEY,
            "STATE",
            "FAILED_TASK_REQUEUED",
            _payload(
                F.col("last_error").alias("failure_reason"),
                "process_step_id",
                F.coalesce("process_returncode", "__exit").alias("returncode"),
                "task_id",
            ),
        )
    )
    new_tasks = _set(
        tasks, failed, {"last_error": None, "stop_requested": False, **NO_PROCESS, "status": "PENDING"}
    )
    new_replicas = _set(
        replicas, failed, {"exit_code": None, "finished_at": None, "status": "PENDING"}
    )
    return new_tasks, new_replicas, events


def retry_failed(poses: DataFrame, replicas: DataFrame, tasks: DataFrame) -> Tables:
    """Requeue the failed tasks of poses that are not pruned."""
    state = poses.select(*POSE_KEY, F.col("status").alias("pose_status"))
    allowed = F.coalesce(F.col("pose_status") != "PRUNED", F.lit(False))
    new_tasks, new_replicas, events = _requeue(
        tasks.join(state, POSE_KEY, "left"), replicas.join(state, POSE_KEY, "left"), allowed
    )
    return {
        "tasks": new_tasks.select(*tasks.columns),
        "replicas": new_replicas.select(*replicas.columns),
        "events": events,
    }


def resume_preconditions(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Digests that changed since the run was created; no row means resume may go on.

    A null current manifest digest is not compared, as it is optional.
    """
    # Texts stored in the tables.
    names = {
        "config_sha256": "resolved configuration checksum changed",
        "pose_manifest_sha256": "resolved pose manifest checksum changed",
        "input_manifest_sha256": "input manifest checksum changed",
    }
    now = current.select("run_id", *[F.col(n).alias(f"__{n}") for n in names])
    reasons = []
    for name, message in names.items():
        differs = ~F.col(name).eqNullSafe(F.col(f"__{name}"))
        if name == "pose_manifest_sha256":
            differs = differs & F.col(f"__{name}").isNotNull()
        reasons.append(F.when(differs, message))
    return runs.join(now, "run_id").select(
        "run_id", F.explode(F.array_compact(F.array(*reasons))).alias("reason")
    )


# --- finalisation --------------------------------------------------------


def pose_rollup(poses: DataFrame, replicas: DataFrame) -> DataFrame:
    """Final status, observed maximum and score of every pose.

    A pose without replicas becomes INCOMPLETE. The observed maximum is replaced
    when any replica has one, also by a smaller value.
    """
    status = F.col("status")
    folded = replicas.groupBy(*POSE_KEY).agg(
        F.bool_and(status == "COMPLETED").alias("all_completed"),
        F.bool_or(status == "FAILED").alias("any_failed"),
        F.bool_or(status == "INTERRUPTED").alias("any_interrupted"),
        F.max("max_rmsd_angstrom").alias("replica_max"),
    )
    final = (
        F.when(status == "PRUNED", "PRUNED")
        .when(F.col("all_completed"), "COMPLETED")
        .when(F.col("any_failed"), "FAILED")
        .when(F.col("any_interrupted"), "INTERRUPTED")
        .otherwise("INCOMPLETE")
    )
    observed = F.coalesce("replica_max", "observed_max_rmsd_angstrom")
    return poses.join(folded, POSE_KEY, "left").select(
        *POSE_KEY,
        final.alias("final_status"),
        observed.alias("final_observed_max_angstrom"),
        F.when(final == "COMPLETED", observed).alias("final_score_angstrom"),
    )


def run_rollup(pose_states: DataFrame) -> DataFrame:
    """Final status of every run from (run_id, final_status) rows.

    The status of a one-pose run is that pose's status.
    """
    s = F.col("final_status")
    folded = pose_states.groupBy("run_id").agg(
        F.count("*").alias("n_poses"),
        F.min(s).alias("only"),
        F.bool_or(s == "FAILED").alias("failed"),
        F.bool_or(s == "INTERRUPTED").alias("interrupted"),
        F.bool_or(s == "INCOMPLETE").alias("incomplete"),
        F.bool_and(s == "PRUNED").alias("all_pruned"),
        F.bool_and(s.isin("COMPLETED", "PRUNED")).alias("all_done"),
    )
    final = (
        F.when(F.col("n_poses") == 1, F.col("only"))
        .when(F.col("failed"), "FAILED")
        .when(F.col("interrupted"), "INTERRUPTED")
        .when(F.col("incomplete"), "INCOMPLETE")
        .when(F.col("all_pruned"), "PRUNED")
        .when(F.col("all_done"), "COMPLETED")
        .otherwise("INCOMPLETE")
    )
    return folded.select("run_id", "n_poses", final.alias("final_status"))


def finalise(runs: DataFrame, poses: DataFrame, replicas: DataFrame, now: Column) -> Tables:
    rolled = pose_rollup(poses, replicas)
    by_run = run_rollup(rolled)
    new_poses = (
        poses.join(rolled, POSE_KEY)
        .withColumns(
            {
                "status": F.col("final_status"),
                "observed_max_rmsd_angstrom": F.col("final_observed_max_angstrom"),
                "md_score_angstrom": F.col("final_score_angstrom"),
                "finished_at": now,
            }
        )
        .select(*poses.columns)
    )
    new_runs = _set(
        runs.join(by_run, "run_id", "left"),
        F.col("final_status").isNotNull(),
        {"status": F.col("final_status"), "updated_at": now},
    ).select(*runs.columns)
    pose_events = rolled.select(
        *_event(
            POSE_KEY, "STATE", "POSE_FINALIZED",
            _payload("pose_id", F.col("final_status").alias("status")),
        )
    )
    run_events = by_run.select(
        *_event(
            ["run_id", F.lit(RUN_SCOPE).alias("pose_id")], "STATE", "RUN_FINALIZED",
            _payload(F.col("final_status").alias("status")),
        )
    )
    members = rolled.select(
        "run_id",
        F.lit(RUN_SCOPE).alias("pose_id"),
        F.lit("RUN_FINALIZED").alias("code"),
        F.col("final_status").alias("role"),
        F.col("pose_id").alias("member"),
    )
    return {
        "runs": new_runs, "poses": new_poses,
        "events": pose_events.unionByName(run_events), "event_members": members,
    }


# --- schema upgrade and summaries ---------------------------------------


def upgrade_tasks(old: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Give an older task table its missing columns and mark owned processes.

    With ``current`` the rows of both tables are returned together.
    """
    # Defaults of the added columns.
    added = {
        "process_state": F.lit("NONE"),
        "process_returncode": F.lit(None).cast("int"),
        "process_finished_at": F.lit(None).cast("timestamp"),
        "process_step_id": F.lit(None).cast("string"),
        "heartbeat_write_count": F.lit(0),
    }
    missing = {name: value for name, value in added.items() if name not in old.columns}
    filled = old.withColumns(missing) if missing else old
    if missing:
        owned = (
            (F.col("status") == "RUNNING")
            & F.col("process_pid").isNotNull()
            & F.col("process_start_token").isNotNull()
            & (F.col("process_state") == "NONE")
        )
        filled = _set(filled, owned, {"process_state": "RUNNING"})
    return filled if current is None else current.unionByName(filled, allowMissingColumns=True)


def pose_summary(poses: DataFrame, replicas: DataFrame) -> DataFrame:
    """One export row per pose; the docking score is not known here and stays null."""
    from posewatch.schemas import POSE_SUMMARY_COLUMNS

    completed = replicas.groupBy(*POSE_KEY).agg(
        F.count_if(F.col("status") == "COMPLETED").alias("__done")
    )
    return (
        poses.join(completed, POSE_KEY, "left")
        .withColumn("n_replicas_completed", F.coalesce("__done", F.lit(0)))
        .withColumn("docking_score_kcal_mol", F.lit(None).cast("double"))
        .select(*POSE_SUMMARY_COLUMNS)
    )


def replica_summary(replicas: DataFrame) -> DataFrame:
    from posewatch.schemas import REPLICA_SUMMARY_COLUMNS

    return replicas.withColumn("triggered_pruning", F.col("triggered_pruning").cast("int")).select(
        *REPLICA_SUMMARY_COLUMNS
    )


def failed_evidence(replicas: DataFrame) -> DataFrame:
    """``pose:replica`` of every failed replica, one row each."""
    return replicas.filter(F.col("status") == "FAILED").select(
        "run_id", F.concat_ws(":", "pose_id", "replica_id").alias("evidence")
    )


# Fixed value: the line that closes the report of a run that was executed.
EXECUTED = "- Validation surface: local prepared-system execution"


def run_report(runs: DataFrame, poses: DataFrame, closing: Sequence[str] = (EXECUTED,)) -> DataFrame:
    """Lines of the run reports, ordered by (run_id, section, pose_id) at the sink."""
    counts = poses.groupBy("run_id").agg(F.count("*").alias("n"))
    head = [
        F.concat(F.lit("# Run report: "), F.col("run_id")),
        F.lit(""),
        F.concat(F.lit("- Status: "), F.col("status")),
        F.concat(F.lit("- Pose count: "), F.coalesce("n", F.lit(0))),
    ]
    sections = [*enumerate(head), *((len(head) + 1 + i, F.lit(line)) for i, line in enumerate(closing))]
    whole = runs.join(counts, "run_id", "left").select(
        "run_id", F.inline(F.array(*[F.struct(F.lit(i).alias("section"), x.alias("line")) for i, x in sections]))
    )
    body = poses.select(
        "run_id",
        F.lit(len(head)).alias("section"),
        "pose_id",
        F.concat(
            F.lit("- Pose `"), F.col("pose_id"), F.lit("`: status="), F.col("status"),
            F.lit(", replicas="), F.col("n_replicas_requested"),
            F.lit(", MD-score (angstrom)="),
            F.coalesce(F.col("md_score_angstrom").cast("string"), F.lit("null")),
        ).alias("line"),
    )
    return whole.withColumn("pose_id", F.lit("")).select(*body.columns).unionByName(body)


def run_manifest(runs: DataFrame, poses: DataFrame) -> DataFrame:
    """Lines of the manifest document of each run; see ``documents.document_lines``."""
    # Names of a run's files and the version of the document.
    fixed = {
        "schema_version": 2, "input_manifest": "input_manifest.json", "pose_manifest": "resolved_pose_manifest.yaml",
        "resolved_config": "resolved_config.yaml", "state": "state.sqlite3",
    }
    members = {name: json_text(F.lit(value)) for name, value in fixed.items()}
    members |= {name: json_text(F.col(name)) for name in ("run_id", "status", "started_at", "finished_at") if name in runs.columns}
    entry = F.to_json(
        F.struct("pose_id", "status", "n_replicas_requested", "md_score_angstrom"), {"ignoreNullFields": "false"}
    )
    item = F.col("pose_id").alias("item")
    return document_lines(
        runs, members,
        {
            "pose_ids": poses.select("run_id", item, json_text(F.col("pose_id")).alias("entry")),
            "poses": poses.select("run_id", item, entry.alias("entry")),
        },
    )


def event_code_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id", "code").agg(F.count("*").alias("n"))
