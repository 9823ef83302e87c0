"""Table schemas and the value lists that are part of the data contract."""

from __future__ import annotations

# Columns, types and column order of the tables of the data contract.
RMSD_SAMPLES = (
    "run_id string, pose_id string, replica_id string, source string, "
    "line_no int, time_ps double, rmsd_nm double"
)

RUNS = (
    "run_id string, status string, config_sha256 string, pose_manifest_sha256 string, "
    "input_manifest_sha256 string, journal_mode string, stop_requested boolean, "
    "created_at timestamp, updated_at timestamp, resume_count int"
)

POSES = (
    "run_id string, pose_id string, status string, n_replicas_requested int, "
    "pruning_enabled boolean, pruning_threshold_angstrom double, "
    "trigger_replica_id string, trigger_simulation_time_ps double, "
    "trigger_observed_rmsd_angstrom double, observed_max_rmsd_angstrom double, "
    "md_score_angstrom double, started_at timestamp, finished_at timestamp"
)

REPLICAS = (
    "run_id string, pose_id string, replica_id string, velocity_seed int, "
    "resolved_ntomp int, status string, gpu_id int, stage_reached string, "
    "trajectory_time_completed_ps double, max_rmsd_nm double, max_rmsd_angstrom double, "
    "triggered_pruning boolean, exit_code int, started_at timestamp, finished_at timestamp"
)

TASKS = (
    "task_id string, run_id string, pose_id string, replica_id string, status string, "
    "assigned_gpu_id int, resolved_ntomp int, claimed_by string, claim_token string, "
    "claimed_at timestamp, heartbeat_at timestamp, stop_requested boolean, "
    "attempt_count int, last_error string, process_pid int, "
    "process_start_token string, process_state string, process_returncode int, "
    "process_finished_at timestamp, process_step_id string, heartbeat_write_count int"
)

EVENTS = (
    "sequence bigint, run_id string, pose_id string, ts timestamp, category string, "
    "code string, payload_json string"
)

ARTIFACTS = (
    "run_id string, artifact_path string, sha256 string, size_bytes bigint, "
    "created_at timestamp"
)

STATE_TABLES = {
    "runs": RUNS,
    "poses": POSES,
    "replicas": REPLICAS,
    "tasks": TASKS,
    "events": EVENTS,
    "artifacts": ARTIFACTS,
}

# Stable order of each state table at a sink (Spark tables have no row id).
STATE_ORDER = {
    "runs": ["run_id"],
    "poses": ["run_id", "pose_id"],
    "replicas": ["run_id", "pose_id", "replica_id"],
    "tasks": ["task_id"],
    "events": ["sequence"],
    "artifacts": ["run_id", "artifact_path"],
}

POSE_MANIFEST = (
    "pose_id string, prepared_system_dir string, start_structure string, topology string, "
    "index string, ligand_resname string, overrides struct<"
    "trajectory:struct<replicas:int,base_seed:bigint,seeds:array<bigint>>,"
    "pruning:struct<enabled:boolean,threshold_angstrom:double,grace_period_seconds:double>>"
)

LOG_EVENT = (
    "ts string, run_id string, pose_id string, step_id string, event_id string, "
    "level string, category string, status string, code string, message string, "
    "params string, input_refs array<string>, artifact_refs array<string>, "
    "metrics string, duration_ms double, exception_type string, "
    "exception_excerpt string, suggested_action string, _corrupt_record string"
)

INPUT_FILES = (
    "run_id string, pose_id string, source string, destination string, kind string, "
    "sha256 string"
)

FRAMES = (
    "trajectory_id string, frame_no bigint, time_ps double, box_nm double, "
    "xyz array<array<double>>"
)

# Status, event and unit vocabularies of the data contract.
TASK_STATUSES = [
    "PENDING", "RUNNING", "COMPLETED", "FAILED", "INTERRUPTED", "PRUNED", "SKIPPED",
]
TERMINAL_STATUSES = ["COMPLETED", "PRUNED", "SKIPPED"]
RETRYABLE_STATUSES = ["FAILED", "INTERRUPTED"]
FINISH_STATUSES = ["COMPLETED", "FAILED", "INTERRUPTED", "PRUNED"]
POSE_STATUSES = [
    "PENDING", "RUNNING", "COMPLETED", "FAILED", "INTERRUPTED", "PRUNED", "INCOMPLETE",
]
RUN_STATUSES = POSE_STATUSES + ["DRY_RUN"]
PROCESS_STATES = ["NONE", "RUNNING", "EXITED"]
RUN_SCOPE = "__RUN__"
EXTERNAL_DESTINATION = "<EXTERNAL_GROMACS_DATA>"
REQUIRED_INDEX_GROUPS = ["C-alpha", "LIG", "Protein_LIG", "Water_and_ions"]
STAGES = ["nvt", "npt", "production"]
SEED_MAX = 2147483647
EVENT_CATEGORIES = [
    "CONFIG", "INPUT", "IO", "SCHEMA", "ORCHESTRATION", "COMPUTE", "EXECUTION",
    "VALIDATION", "TEST", "BUILD", "OUTPUT", "ENV", "DEPENDENCY", "TIMEOUT", "MEMORY",
    "SECURITY", "RMSD", "PRUNING", "SCHEDULER", "STATE", "UNKNOWN",
]
POSE_SUMMARY_COLUMNS = [
    "run_id", "pose_id", "status", "n_replicas_requested", "n_replicas_completed",
    "md_score_angstrom", "observed_max_rmsd_angstrom", "pruning_enabled",
    "pruning_threshold_angstrom", "trigger_replica_id", "trigger_simulation_time_ps",
    "docking_score_kcal_mol", "started_at", "finished_at",
]
REPLICA_SUMMARY_COLUMNS = [
    "run_id", "pose_id", "replica_id", "status", "gpu_id", "velocity_seed",
    "resolved_ntomp", "stage_reached", "trajectory_time_completed_ps", "max_rmsd_nm",
    "max_rmsd_angstrom", "triggered_pruning", "exit_code", "started_at", "finished_at",
]
