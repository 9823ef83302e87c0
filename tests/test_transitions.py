"""Small hand-made state tables through every transition."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from posewatch import schemas
from posewatch.operators import planning, quality, queues
from posewatch.operators import transitions as tr
from posewatch.sources import state

NOW = "2026-01-01 00:00:00"


def table(spark, name, *data):
    """Rows given as dicts; absent columns are null, flags false, counters 0."""
    schema = spark.createDataFrame([], schemas.STATE_TABLES[name]).schema
    base = {"run_id": "r", "pose_id": "p", "stop_requested": False, "triggered_pruning": False,
            "process_state": "NONE", "resume_count": 0, "heartbeat_write_count": 0,
            "pruning_enabled": False, "n_replicas_requested": 1, "resolved_ntomp": 1}
    return spark.createDataFrame(
        [tuple({**base, **d}.get(f.name) for f in schema.fields) for d in data], schema
    )


def replica(n, status, **kw):
    return {"replica_id": f"r{n:02d}", "status": status, **kw}


def task(n, status, **kw):
    return {"task_id": f"{kw.get('pose_id', 'p')}:r{n:02d}", "replica_id": f"r{n:02d}", "status": status, **kw}


def now():
    return F.lit(NOW).cast("timestamp")


def test_prune_skips_pending_and_stops_running(spark):
    poses = table(spark, "poses", {"status": "RUNNING", "pruning_enabled": True, "pruning_threshold_angstrom": 4.0})
    statuses = ["RUNNING", "RUNNING", "PENDING", "PENDING"]
    tasks = table(spark, "tasks", *[task(i, s) for i, s in enumerate(statuses, 1)])
    replicas = table(spark, "replicas", *[replica(i, s) for i, s in enumerate(statuses, 1)])
    trigger = spark.createDataFrame([("r", "p", "r01", 25.0, 4.5)], "run_id string, pose_id string, replica_id string, time_ps double, rmsd_angstrom double")
    out = tr.apply_pruning(poses, replicas, tasks, trigger, now())
    pose = out["poses"].first()
    assert (pose.status, pose.md_score_angstrom, pose.observed_max_rmsd_angstrom, pose.trigger_replica_id) == ("PRUNED", None, 4.5, "r01")
    assert rows(out["tasks"].select("status", "stop_requested"), "task_id") == [
        ("RUNNING", False), ("RUNNING", True), ("SKIPPED", False), ("SKIPPED", False)]
    assert rows(out["replicas"].select("status", "triggered_pruning"), "replica_id") == [
        ("RUNNING", True), ("RUNNING", False), ("SKIPPED", False), ("SKIPPED", False)]
    assert rows(out["events"].select("code")) == [("POSE_PRUNED",)]
    assert rows(out["event_members"].select("role", "member"), "member") == [
        ("stop_requested_task", "p:r02"), ("skipped_task", "p:r03"), ("skipped_task", "p:r04")]
    assert out["refused"].count() == 0


def test_two_triggers_give_one_pruned_event(spark):
    poses = table(spark, "poses", {"status": "RUNNING", "pruning_enabled": True, "pruning_threshold_angstrom": 4.0})
    tasks = table(spark, "tasks", task(1, "RUNNING"), task(2, "RUNNING"))
    replicas = table(spark, "replicas", replica(1, "RUNNING"), replica(2, "RUNNING"))
    trigger = spark.createDataFrame([("r", "p", "r01", 30.0, 5.0), ("r", "p", "r02", 20.0, 4.5)], "run_id string, pose_id string, replica_id string, time_ps double, rmsd_angstrom double")
    out = tr.apply_pruning(poses, replicas, tasks, trigger, now())
    pose = out["poses"].first()
    assert (pose.trigger_simulation_time_ps, pose.trigger_replica_id, pose.observed_max_rmsd_angstrom) == (20.0, "r02", 5.0)
    assert rows(out["events"].select("code"), "code") == [("POSE_PRUNED",), ("PRUNING_TRIGGER_OBSERVED",)]
    canonical = '{"observed_rmsd_angstrom":4.5,"replica_id":"r02","simulation_time_ps":20.0}'
    observed = '{"observed_rmsd_angstrom":5.0,"replica_id":"r01","simulation_time_ps":30.0}'
    assert out["events"].filter("code <> 'POSE_PRUNED'").first().payload_json == (
        f'{{"canonical_trigger":{canonical},"observed_trigger":{observed},"pose_id":"p"}}')


@pytest.mark.parametrize("pose, reason", [
    ({"status": "RUNNING"}, "pruning is disabled"),
    ({"status": "RUNNING", "pruning_enabled": True, "pruning_threshold_angstrom": 4.5}, "trigger does not exceed the threshold"),
    ({"status": "COMPLETED", "pruning_enabled": True, "pruning_threshold_angstrom": 4.0}, "pose is in another state"),
])
def test_refused_triggers(spark, pose, reason):
    trigger = spark.createDataFrame([("r", "p", "r01", 25.0, 4.5)], "run_id string, pose_id string, replica_id string, time_ps double, rmsd_angstrom double")
    out = tr.apply_pruning(table(spark, "poses", pose), table(spark, "replicas", replica(1, "RUNNING")),
                           table(spark, "tasks", task(1, "RUNNING")), trigger, now())
    assert out["refused"].first().refusal == reason
    assert out["poses"].first().status == pose["status"]
    assert out["events"].count() == 0


def exited(n, code, **kw):
    return task(n, "RUNNING", process_pid=10, process_start_token="t", process_state="EXITED", process_returncode=code,
                process_finished_at=None, process_step_id="step", **kw)


def resume(spark, tasks, pose_status="RUNNING", run_stop=False, retry=False, replica_status="RUNNING", ended=True, probe="EXITED"):
    runs = table(spark, "runs", {"status": "INTERRUPTED", "stop_requested": run_stop})
    poses = table(spark, "poses", {"status": pose_status})
    t = table(spark, "tasks", *tasks).withColumn("probe_status", F.lit(probe))
    if ended:
        t = t.withColumn("process_finished_at", F.when(F.col("process_state") == "EXITED", now()))
    replicas = table(spark, "replicas", *[replica(int(x["replica_id"][1:]), replica_status, exit_code=None) for x in tasks])
    return tr.reconcile_resume(runs, poses, replicas, t, now(), retry)


def test_durable_success_is_requeued(spark):
    out = resume(spark, [exited(1, 0)])
    assert out["decisions"].first().outcome == "DURABLE_EXITED_SUCCESS"
    row = out["tasks"].first()
    assert (row.status, row.process_state, row.last_error) == ("PENDING", "NONE", None)
    run = out["runs"].first()
    assert (run.status, run.resume_count, run.stop_requested) == ("RUNNING", 1, False)


def test_durable_failure_stays_failed_until_retried(spark):
    out = resume(spark, [exited(1, 1)])
    row = out["tasks"].first()
    assert row.status == "FAILED" and row.process_returncode == 1
    assert row.last_error == "step exited with code 1 without durable cooperative cancellation evidence"
    assert out["replicas"].first().exit_code == 1
    assert out["events"].filter("code = 'DURABLE_COMMAND_EXIT_FAILED'").first().payload_json == (
        '{"process_step_id":"step","reason":"step exited with code 1 without durable cooperative cancellation evidence",'
        '"returncode":1,"task_id":"p:r01"}')
    assert rows(out["event_members"].select("code", "role", "member")) == [("RUN_RESUMED", "DURABLE_EXITED_FAILED", "p:r01")]
    again = resume(spark, [exited(1, 1)], retry=True)
    assert again["tasks"].first().status == "PENDING"
    assert {r.code for r in again["events"].collect()} == {"DURABLE_COMMAND_EXIT_FAILED", "FAILED_TASK_REQUEUED", "RUN_RESUMED"}


def test_stop_evidence_makes_an_interruption(spark):
    out = resume(spark, [exited(1, 143, stop_requested=True, last_error="user stop requested")])
    decision = out["decisions"].first()
    assert (decision.outcome, decision.evidence) == ("DURABLE_EXITED_INTERRUPTED", "user stop requested")
    assert out["tasks"].first().status == "PENDING"
    pruned = resume(spark, [exited(1, 143)], pose_status="PRUNED")
    assert pruned["tasks"].first().status == "INTERRUPTED"
    assert pruned["decisions"].first().evidence == "persisted pose PRUNED state"


@pytest.mark.parametrize("change, outcome", [
    ({"process_state": "LOST"}, "REFUSED_UNKNOWN_STATE"),
    ({"process_start_token": None}, "REFUSED_INCOMPLETE_EXIT"),
    ({"process_state": "NONE"}, "REFUSED_NO_IDENTITY"),
    ({"process_state": "RUNNING"}, "REFUSED_CONTRADICTORY"),
])
def test_refused_tasks_block_their_run(spark, change, outcome):
    out = resume(spark, [{**exited(1, 1), **change}, task(2, "INTERRUPTED")])
    assert out["refused"].first().outcome == outcome
    assert rows(out["tasks"].select("status"), "task_id") == [("RUNNING",), ("INTERRUPTED",)]
    assert out["runs"].first().resume_count == 0


@pytest.mark.parametrize("probe, outcome", [
    ("MATCHING_LIVE", "REFUSED_LIVE_PROCESS"), ("UNVERIFIABLE", "REFUSED_UNVERIFIABLE"), (None, "REFUSED_UNVERIFIABLE"),
    ("PID_REUSED", "PID_REUSED"), ("EXITED", "EXITED")])
def test_probe_results(spark, probe, outcome):
    owned = task(1, "RUNNING", process_pid=10, process_start_token="t", process_state="RUNNING")
    assert resume(spark, [owned], probe=probe)["decisions"].first().outcome == outcome


def test_poses_with_pending_work_run_again(spark):
    out = resume(spark, [task(1, "INTERRUPTED")], pose_status="INTERRUPTED", replica_status="INTERRUPTED")
    assert out["poses"].first().status == "RUNNING"
    done = resume(spark, [task(1, "COMPLETED")], pose_status="FAILED", replica_status="COMPLETED")
    assert done["poses"].first().status == "FAILED"


def test_stop_request(spark):
    runs = table(spark, "runs", {"status": "RUNNING"}, {"run_id": "other", "status": "RUNNING"})
    poses = table(spark, "poses", {"status": "RUNNING"}, {"pose_id": "q", "status": "PRUNED"})
    tasks = table(spark, "tasks", task(1, "PENDING"), task(2, "RUNNING"), task(3, "COMPLETED"))
    replicas = table(spark, "replicas", replica(1, "PENDING"), replica(2, "RUNNING"))
    out = tr.apply_stop(runs, poses, replicas, tasks, runs.filter("run_id = 'r'"), now())
    assert rows(out["runs"].select("run_id", "status"), "run_id") == [("other", "RUNNING"), ("r", "INTERRUPTED")]
    assert rows(out["tasks"].select("status", "stop_requested"), "task_id") == [("INTERRUPTED", False), ("RUNNING", True), ("COMPLETED", False)]
    assert rows(out["poses"].select("status"), "pose_id") == [("INTERRUPTED",), ("PRUNED",)]
    assert rows(out["replicas"].select("status"), "replica_id") == [("INTERRUPTED",), ("RUNNING",)]
    assert rows(out["event_members"].select("member")) == [("p:r02",)]


def test_first_completion_of_a_claim_counts(spark):
    tasks = table(spark, "tasks", task(1, "RUNNING", claim_token="c"), task(2, "PENDING", claim_token="c"))
    replicas = table(spark, "replicas", replica(1, "RUNNING", max_rmsd_nm=0.3), replica(2, "PENDING"))
    columns = ("task_id string, claim_token string, sequence int, status string, stage_reached string, "
               "trajectory_time_completed_ps double, max_rmsd_nm double, max_rmsd_angstrom double, exit_code int, error string")
    messages = spark.createDataFrame([
        ("p:r01", "c", 1, "SKIPPED", "s", 1.0, None, None, 0, None),
        ("p:r01", "c", 2, "FAILED", "npt", 2.0, None, None, 5, "boom"),
        ("p:r01", "c", 3, "COMPLETED", "production", 3.0, 0.4, 4.0, 0, None),
        ("p:r01", "x", 0, "COMPLETED", "production", 3.0, 0.4, 4.0, 0, None),
        ("p:r02", "c", 4, "COMPLETED", "production", 3.0, 0.4, 4.0, 0, None)], columns)
    messages = messages.select(F.lit("r").alias("run_id"), F.lit("p").alias("pose_id"), F.lit("?").alias("replica_id"), "*")
    out = tr.apply_completion(tasks, replicas, messages, now())
    first = out["tasks"].orderBy("task_id").first()
    assert (first.status, first.claim_token, first.last_error) == ("FAILED", None, "boom")
    row = out["replicas"].orderBy("replica_id").first()
    assert (row.max_rmsd_nm, row.exit_code, row.stage_reached) == (None, 5, "npt")
    assert out["refused"].count() == 4


def test_progress_keeps_known_maxima(spark):
    tasks = table(spark, "tasks", task(1, "RUNNING", claim_token="c"))
    replicas = table(spark, "replicas", replica(1, "RUNNING", max_rmsd_nm=0.1, max_rmsd_angstrom=1.0))
    messages = spark.createDataFrame(
        [("r", "p", "r01", "p:r01", "c", 1, "nvt", 1.0, 0.2, None), ("r", "p", "r01", "p:r01", "c", 2, "npt", 2.0, None, None)],
        "run_id string, pose_id string, replica_id string, task_id string, claim_token string, sequence int, "
        "stage_reached string, trajectory_time_completed_ps double, max_rmsd_nm double, max_rmsd_angstrom double")
    out = tr.apply_progress(tasks, replicas, messages, now())
    row = out["replicas"].first()
    assert (row.stage_reached, row.trajectory_time_completed_ps, row.max_rmsd_nm, row.max_rmsd_angstrom) == ("npt", 2.0, 0.2, 1.0)
    assert out["tasks"].first().heartbeat_write_count == 2


def test_observed_maximum_is_replaced_at_the_end(spark):
    poses = table(spark, "poses", {"status": "RUNNING", "observed_max_rmsd_angstrom": 9.0}, {"pose_id": "q", "status": "RUNNING", "observed_max_rmsd_angstrom": 7.0},
                  {"pose_id": "z", "status": "PRUNED"})
    replicas = table(spark, "replicas", replica(1, "COMPLETED", max_rmsd_angstrom=2.0), replica(2, "COMPLETED", max_rmsd_angstrom=3.0),
                     replica(1, "COMPLETED", pose_id="z", max_rmsd_angstrom=1.0))
    got = {r.pose_id: (r.final_status, r.final_observed_max_angstrom, r.final_score_angstrom) for r in tr.pose_rollup(poses, replicas).collect()}
    assert got == {"p": ("COMPLETED", 3.0, 3.0), "q": ("INCOMPLETE", 7.0, None), "z": ("PRUNED", 1.0, None)}


@pytest.mark.parametrize("states, final", [
    (["PRUNED"], "PRUNED"), (["COMPLETED", "PRUNED"], "COMPLETED"), (["PRUNED", "PRUNED"], "PRUNED"),
    (["FAILED", "INTERRUPTED"], "FAILED"), (["INTERRUPTED", "INCOMPLETE"], "INTERRUPTED"), (["INCOMPLETE", "COMPLETED"], "INCOMPLETE"),
    (["RUNNING", "COMPLETED"], "INCOMPLETE")])
def test_run_rollup(spark, states, final):
    df = spark.createDataFrame([("r", s) for s in states], "run_id string, final_status string")
    assert tr.run_rollup(df).first().final_status == final


def test_two_poses_of_five(spark):
    """One pose is pruned, the other completes; the run completes."""
    specs = spark.createDataFrame([("r", "a", 1, [101, 102, 103, 104, 105], True, 4.0), ("r", "b", 2, [201, 202, 203, 204, 205], False, None)],
                                  "run_id string, pose_id string, pose_no bigint, seeds array<bigint>, pruning_enabled boolean, pruning_threshold_angstrom double"
                                  ).withColumn("gpu_ids", F.array(F.lit(0), F.lit(1)))
    plan = planning.expand_tasks(specs).withColumn("resolved_ntomp", F.lit(4))
    assert rows(plan.select("assigned_gpu_id"), "task_index") == [(i % 2,) for i in range(10)]
    tables = planning.plan_tables(table(spark, "runs", {"status": "RUNNING", "journal_mode": "WAL"}).withColumn("gpu_ids", F.array(F.lit(0), F.lit(1))), plan, specs.withColumn("resolved_ntomp", F.lit(4)), now())
    assert rows(tables["event_members"], "pose_id") == [("r", "STATE_CREATED", "a"), ("r", "STATE_CREATED", "b")]
    assert rows(tables["events"].groupBy("code").count(), "code") == [("POSE_REGISTERED", 2), ("STATE_CREATED", 1)]
    status = {"replica_01": "PRUNED", "replica_02": "INTERRUPTED"}
    final = tables["replicas"].withColumn("max_rmsd_angstrom", F.lit(2.0)).withColumn(
        "status", F.when(F.col("pose_id") == "b", "COMPLETED").when(F.col("replica_id") == "replica_01", status["replica_01"])
        .when(F.col("replica_id") == "replica_02", status["replica_02"]).otherwise("SKIPPED"))
    poses = tables["poses"].withColumn("status", F.when(F.col("pose_id") == "a", "PRUNED").otherwise("RUNNING")).withColumn("observed_max_rmsd_angstrom", F.lit(4.5))
    rolled = tr.pose_rollup(poses, final)
    assert rows(rolled.select("final_status"), "pose_id") == [("PRUNED",), ("COMPLETED",)]
    assert tr.run_rollup(rolled).first().final_status == "COMPLETED"


def test_each_run_starts_at_its_first_queue(spark):
    specs = spark.createDataFrame([("r", "a", 1, [1, 2, 3], [4, 7]), ("q", "b", 2, [4, 5, 6, 7], [9, 8, 5]), ("r", "c", 3, [8, 9], [4, 7])],
                                  "run_id string, pose_id string, pose_no bigint, seeds array<bigint>, gpu_ids array<int>")
    for window_rows in (None, 0):
        plan = planning.expand_tasks(specs, window_rows=window_rows)
        assert rows(plan.select("run_id", "task_index", "assigned_gpu_id"), "run_id", "task_index") == [
            *[("q", i, g) for i, g in enumerate([9, 8, 5, 9])], *[("r", i, g) for i, g in enumerate([4, 7, 4, 7, 4])]]
        totals = planning.plan_totals(plan, specs.select("run_id", "gpu_ids").distinct())
        assert rows(totals, "run_id") == [("q", 1, 4, 3), ("r", 2, 5, 2)]


def test_seeds(spark):
    one = spark.range(1)
    assert one.select(planning.base_seeds(F.lit(2026073001), F.lit(5))).first()[0] == [2026073001 + i for i in range(5)]
    seeds = spark.range(200_000).select(planning.generated_seed(F.col("id"), 48271, 5).alias("s"))
    assert seeds.distinct().count() == 200_000
    low, high = seeds.agg(F.min("s"), F.max("s")).first()
    assert 1 <= low and high <= schemas.SEED_MAX
    with pytest.raises(ValueError):
        planning.generated_seed(F.lit(1), schemas.SEED_MAX, 1)


def test_upgrade_of_an_old_task_table(spark):
    added = ["process_state", "process_returncode", "process_finished_at", "process_step_id", "heartbeat_write_count"]
    current = table(spark, "tasks", task(1, "RUNNING", process_pid=5, process_start_token="t"), task(2, "PENDING"))
    old = current.drop(*added)
    assert rows(tr.upgrade_tasks(old).select("process_state", "heartbeat_write_count"), "task_id") == [("RUNNING", 0), ("NONE", 0)]
    assert rows(tr.upgrade_tasks(current).select("process_state"), "task_id") == [("NONE",), ("NONE",)]
    assert tr.upgrade_tasks(old, current).count() == 4


def test_preconditions_name_what_changed(spark):
    runs = table(spark, "runs", {"config_sha256": "a", "pose_manifest_sha256": "b", "input_manifest_sha256": "c"})
    now_ = spark.createDataFrame([("r", "x", None, "c")], "run_id string, config_sha256 string, pose_manifest_sha256 string, input_manifest_sha256 string")
    assert rows(tr.resume_preconditions(runs, now_).select("reason")) == [("resolved configuration checksum changed",)]


def test_queues(spark):
    poses = table(spark, "poses", {"status": "RUNNING"}, {"pose_id": "q", "status": "PRUNED"})
    tasks = table(spark, "tasks", task(1, "PENDING", assigned_gpu_id=1), task(2, "PENDING", assigned_gpu_id=0), task(3, "PENDING", assigned_gpu_id=1),
                  task(4, "PENDING", assigned_gpu_id=0), task(5, "RUNNING", assigned_gpu_id=0), task(1, "PENDING", pose_id="q", assigned_gpu_id=0))
    pending = queues.pending_tasks(tasks, poses)
    depth = queues.queue_depth(pending)
    assert rows(depth.select("assigned_gpu_id", "pending_count"), "assigned_gpu_id") == [(0, 2), (1, 2)]
    assert queues.busiest_queue(depth).first().assigned_gpu_id == 0
    assert rows(queues.next_task(pending).select("task_id"), "assigned_gpu_id") == [("p:r02",), ("p:r01",)]


def test_quality_rules(spark):
    bad = table(spark, "tasks", task(1, "RUNNING", process_state="RUNNING", process_returncode=1), task(2, "DONE"))
    got = {r.reason for r in quality.violations(bad, "tasks", F.col("task_id"), quality.task_rules()).collect()}
    assert got == {"running process has exit evidence", "unknown status"}


def test_state_snapshots(spark, tmp_path):
    root = str(tmp_path)
    poses = table(spark, "poses", {"status": "RUNNING"}, {"pose_id": "q", "status": "PRUNED"})
    state.write_table(poses, root, "poses")
    state.write_table(state.read_table(spark, root, "poses").withColumn("status", F.lit("FAILED")), root, "poses")
    assert rows(state.ordered(state.read_table(spark, root, "poses"), "poses").select("pose_id", "status")) == [("p", "FAILED"), ("q", "FAILED")]
    with pytest.raises(ValueError):
        state.read_table(spark, root, "other")


def test_artifacts_of_other_runs_stay(spark, tmp_path):
    path = str(tmp_path / "artifacts")

    def artifacts(*data):
        return table(spark, "artifacts", *[{"run_id": r, "artifact_path": p} for r, p in data])

    def runs(*names):
        return spark.createDataFrame([(n,) for n in names], "run_id string")

    def stored():
        return rows(state.read_artifacts(spark, path).select("run_id", "artifact_path"), "run_id")

    state.replace_artifacts(artifacts(("a", "x"), ("b", "y"), ("c", "w")), path, runs("a", "b", "c"))
    state.replace_artifacts(artifacts(("b", "z")), path, runs("b", "c"))
    assert stored() == [("a", "x"), ("b", "z")]


def test_event_log_reads_well_formed_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"run_id": "r", "params": {"state_sequence": 1}}\nbroken\n{"run_id": "r", "params": {"state_sequence": "2"}}\n'
                    '{"run_id": "r", "params": {"x": {"state_sequence": 4}, "state_sequence": 3}}\n{"run_id": "r"}\n')
    log = state.read_event_log(spark, str(path))
    assert log.count() == 4
    assert rows(state.exported_sequences(log).select("sequence"), "sequence") == [(1,), (3,)]


def test_summaries(spark):
    poses = table(spark, "poses", {"status": "RUNNING", "pruning_enabled": True}, {"pose_id": "q", "status": "RUNNING"})
    replicas = table(spark, "replicas", replica(1, "COMPLETED"), replica(2, "FAILED", triggered_pruning=True))
    out = tr.pose_summary(poses, replicas)
    assert out.columns == schemas.POSE_SUMMARY_COLUMNS
    assert rows(out.select("n_replicas_completed", "docking_score_kcal_mol"), "pose_id") == [(1, None), (0, None)]
    assert tr.replica_summary(replicas).columns == schemas.REPLICA_SUMMARY_COLUMNS
    assert rows(tr.replica_summary(replicas).select("triggered_pruning"), "replica_id") == [(0,), (1,)]
    assert rows(tr.failed_evidence(replicas).select("evidence")) == [("p:r02",)]


def test_event_numbers_go_on_after_the_stored_ones(spark):
    schema = "run_id string, pose_id string, category string, code string, payload_json string"
    step = spark.createDataFrame(
        [("r", f"p{i}", "STATE", "TASK_FAILED", "{}") for i in range(300)] + [("s", "p", "STATE", "TASK_FAILED", "{}")] * 2, schema)
    none = tr.append_events(step.limit(0), spark.createDataFrame([], "run_id string, sequence bigint"), now())
    assert none.count() == 0
    stored = spark.createDataFrame([("r", 1), ("r", 7), ("other", 99)], "run_id string, sequence bigint")
    got = tr.append_events(step, stored, now())
    assert rows(got.filter("run_id = 'r'").select("sequence"), "sequence") == [(i,) for i in range(8, 308)]
    assert rows(got.filter("run_id = 's'").select("sequence"), "sequence") == [(1,), (2,)]
    whole = spark.createDataFrame([("r", p, "STATE", c, "{}") for p, c in [(schemas.RUN_SCOPE, "STATE_CREATED"), ("b", "POSE_REGISTERED"), ("a", "POSE_REGISTERED")]], step.schema)
    assert rows(tr.append_events(whole, stored, now()).select("pose_id"), "sequence") == [("a",), ("b",), (schemas.RUN_SCOPE,)]
    assert got.filter("ts is null").count() == 0
