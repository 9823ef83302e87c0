"""Plans, transitions, roll-ups and reports over orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from posewatch.functions.documents import ORDER
from posewatch.functions.settings import utc_text
from posewatch.operators import planning, quality, queues
from posewatch.operators import transitions as tr
from posewatch.plans import standins as s
from posewatch.plans.registry import query
from posewatch.schemas import EVENTS, EXTERNAL_DESTINATION, POSE_SUMMARY_COLUMNS
from posewatch.session import materialise, scratch_dir
from posewatch.sources import exports
from posewatch.sources.manifest import parse_pose_manifest
from posewatch.sources.state import (
    as_log_events,
    exported_sequences,
    not_exported,
    parse_event_log,
    read_artifacts,
    read_table,
    state_sequence,
    write_table,
)
from posewatch.sources.state import replace_artifacts as write_artifacts


def now():
    return F.lit("2026-01-01T00:00:00Z")


KEY = ["run_id", "pose_id", "replica_id"]


def state(spark, sf):
    return (s.runs(spark, sf), s.poses(spark, sf), s.replicas(spark, sf), s.tasks(spark, sf))


# --- planning ------------------------------------------------------------

PLAN_POSE = {
    "run_id": s.POSE["run_id"],
    "pose_id": s.POSE["pose_id"],
    "pose_no": "o_orderkey",
    "replicas": "CAST(1 + o_orderkey % 4 AS INT)",
    "base_seed": "o_orderkey * 7 + 1",
    "n_gpus": f"CAST(2 + length({s.POSE['run_id']}) % 3 AS INT)",
}
PLAN_SQL = [
    s.select_sql("plan", PLAN_POSE, "orders"),
    """numbered AS (SELECT run_id, pose_id, concat('replica_', lpad(CAST(i + 1 AS VARCHAR), 2, '0')) AS replica_id,
         base_seed + i AS velocity_seed, CAST(first + i AS BIGINT) AS task_index,
         2 * ((first + i) % n_gpus) + 1 AS gpu, n_gpus
       FROM (SELECT *, unnest(range(replicas)) AS i FROM
         (SELECT run_id, pose_id, pose_no, base_seed, replicas, n_gpus,
           coalesce(sum(replicas) OVER (PARTITION BY run_id ORDER BY pose_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
          FROM plan)))""",
]


def plan_poses(spark, sf):
    """Poses in order, each with the queues of its run: 1, 3, 5, ..."""
    poses = s.table(spark, sf, "orders").selectExpr(*s.exprs(PLAN_POSE))
    return poses.select("*", F.expr("transform(sequence(1, n_gpus), i -> 2 * i - 1)").alias("gpu_ids"))


def plan_runs(spark, sf):
    return plan_poses(spark, sf).select("run_id", "gpu_ids", F.lit("WAL").alias("journal_mode")).distinct()


def seeded_tasks(spark, sf):
    seeded = plan_poses(spark, sf).withColumn(
        "seeds", planning.base_seeds(F.col("base_seed"), F.col("replicas"))
    )
    return planning.expand_tasks(seeded)


@query(
    "plan_expansion",
    s.with_ctes(
        PLAN_SQL,
        """SELECT run_id, pose_id, replica_id, concat(pose_id, ':', replica_id) AS task_id,
             velocity_seed, task_index, gpu AS assigned_gpu_id FROM numbered""",
    ),
)
def plan_expansion(spark, sf):
    return seeded_tasks(spark, sf).select(
        *KEY, "task_id", "velocity_seed", "task_index", "assigned_gpu_id"
    )


@query(
    "plan_totals",
    s.with_ctes(
        PLAN_SQL,
        """SELECT run_id, count(DISTINCT pose_id) AS poses, count(*) AS replicas,
             any_value(n_gpus) AS workers FROM numbered GROUP BY run_id""",
    ),
)
def plan_totals(spark, sf):
    return planning.plan_totals(seeded_tasks(spark, sf), plan_runs(spark, sf))


@query(
    "generated_seeds",
    s.with_ctes(
        PLAN_SQL,
        """SELECT pose_id, replica_id,
             ((task_index % 2147483647) * 48271 % 2147483647 + 12345) % 2147483647 + 1 AS velocity_seed
           FROM numbered""",
    ),
)
def generated_seeds(spark, sf):
    tasks = planning.expand_with_generated_seeds(plan_poses(spark, sf), 48271, 12345)
    return tasks.select("pose_id", "replica_id", "velocity_seed")


@query(
    "execution_plan",
    s.with_ctes(
        PLAN_SQL,
        """SELECT run_id, task_index, concat('{"eligible_for_work_stealing":true,"initial_gpu_id":',
             gpu, ',"pose_id":"', pose_id, '","replica_id":"', replica_id,
             '","resolved_ntomp":4,"task_id":"', pose_id, ':', replica_id, '","velocity_seed":',
             velocity_seed, '}') AS task_json FROM numbered""",
    ),
)
def execution_plan(spark, sf):
    return planning.plan_documents(seeded_tasks(spark, sf).withColumn("resolved_ntomp", F.lit(4)))


@query(
    "execution_plan_lines",
    s.with_ctes(
        PLAN_SQL,
        """SELECT run_id, count(DISTINCT pose_id) AS n_poses, count(*) AS n_tasks, max(gpu) AS last_gpu,
             2 AS schema_version, true AS in_order FROM numbered GROUP BY run_id""",
    ),
)
def execution_plan_lines(spark, sf):
    """The plan document of each run, put together from its lines and parsed again."""
    poses = plan_poses(spark, sf).select(
        "run_id", "pose_id", "pose_no", "gpu_ids",
        planning.base_seeds(F.col("base_seed"), F.col("replicas")).alias("seeds"),
        F.lit(False).alias("pruning_enabled"), F.lit(None).cast("double").alias("pruning_threshold_angstrom"),
    )
    tasks = materialise(planning.expand_tasks(poses).withColumn("resolved_ntomp", F.lit(4)), "plan")
    named = planning.pose_documents(
        poses.withColumn("n_replicas_requested", F.size("seeds")),
        planning.checksum_maps(spark.createDataFrame([], "run_id string, pose_id string, destination string, sha256 string")),
    )
    lines = planning.plan_lines(plan_runs(spark, sf), tasks, named, ["nvt", "npt", "production"])
    # The runs of this stand-in have few poses, so a document fits a row.
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "line"))), lambda x: x["line"]), "\n")
    plan = F.from_json("text", "schema_version int, run_id string, pose_ids array<string>, poses array<struct<pose_id:string>>, "
                       "tasks array<struct<task_id:string,initial_gpu_id:int>>")
    parsed = lines.groupBy("run_id").agg(text.alias("text")).select(plan.alias("p"))
    return parsed.select(
        "p.run_id", F.size("p.poses").cast("long").alias("n_poses"), F.size("p.tasks").cast("long").alias("n_tasks"),
        F.array_max(F.transform("p.tasks", lambda t: t["initial_gpu_id"])).alias("last_gpu"), "p.schema_version",
        (F.col("p.pose_ids") == F.array_sort(F.col("p.poses.pose_id"))).alias("in_order"),
    )


@query(
    "plan_state_tables",
    s.with_ctes(
        PLAN_SQL,
        """SELECT 'poses' AS table_name, run_id, count(DISTINCT pose_id) AS n FROM numbered GROUP BY ALL
           UNION ALL SELECT 'replicas', run_id, count(*) FROM numbered GROUP BY ALL
           UNION ALL SELECT 'tasks', run_id, count(*) FROM numbered GROUP BY ALL
           UNION ALL SELECT 'events', run_id, count(DISTINCT pose_id) + 1 FROM numbered GROUP BY ALL
           UNION ALL SELECT 'event_members', run_id, count(DISTINCT pose_id) FROM numbered GROUP BY ALL""",
    ),
)
def plan_state_tables(spark, sf):
    poses = plan_poses(spark, sf).select(
        "run_id", "pose_id", "pose_no", "gpu_ids",
        planning.base_seeds(F.col("base_seed"), F.col("replicas")).alias("seeds"),
        F.lit(False).alias("pruning_enabled"),
        F.lit(None).cast("double").alias("pruning_threshold_angstrom"),
        F.lit(4).alias("resolved_ntomp"),
    )
    # Five tables read the expansion; it is made once.
    tasks = materialise(planning.expand_tasks(poses), "plan")
    tables = planning.plan_tables(plan_runs(spark, sf), tasks, poses, now())
    counts = [
        t.groupBy("run_id").agg(F.count("*").alias("n")).withColumn("table_name", F.lit(name))
        for name, t in tables.items()
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


ENTRY = {
    "run_id": "c_mktsegment",
    "pose_id": "CASE WHEN c_custkey % 100 = 7 THEN 'shared' WHEN c_custkey % 101 = 5 THEN concat(' ', c_name) ELSE c_name END",
    "ligand_resname": "CASE WHEN c_custkey % 50 = 3 THEN 'bad name' ELSE 'LIG' END",
    "has_replicas": "c_custkey % 2 = 0",
    "o_replicas": "CAST(c_nationkey % 6 AS INT)",
    "has_base_seed": "c_custkey % 5 = 0",
    "o_base_seed": "CASE WHEN c_custkey % 10 = 0 THEN 2147483640 + CAST(c_nationkey AS BIGINT) END",
    "has_enabled": "c_custkey % 3 = 0",
    "o_enabled": "c_custkey % 6 = 0",
    "has_threshold_angstrom": "c_custkey % 7 = 0",
    "o_threshold_angstrom": "CASE WHEN c_custkey % 14 = 0 THEN c_acctbal END",
    "has_grace_period_seconds": "false",
    "o_grace_period_seconds": "CAST(NULL AS DOUBLE)",
    "has_seeds": "c_custkey % 4 = 1",
    "seed_count": "CASE WHEN c_custkey % 8 = 1 THEN 1 + c_nationkey % 4 END",
}
DEFAULTS = {
    "replicas": 5, "base_seed": 11, "seeds": None, "enabled": True,
    "threshold_angstrom": 4.0, "grace_period_seconds": 30.0,
}
# The given seeds of a pose are 1, 2, … with a repeated last one for some poses.
OVERLAY_SQL = [
    s.select_sql("entry", {**ENTRY, "c_custkey": "c_custkey"}, "customer"),
    """resolved AS (SELECT run_id, pose_id, ligand_resname,
         CASE WHEN has_seeds AND seed_count IS NOT NULL AND NOT has_replicas THEN seed_count
              WHEN has_replicas THEN o_replicas ELSE 5 END AS replicas,
         CASE WHEN has_seeds AND seed_count IS NOT NULL THEN NULL
              WHEN has_base_seed THEN o_base_seed ELSE 11 END AS base_seed,
         CASE WHEN has_seeds THEN seed_count END AS seed_count, c_custkey,
         CASE WHEN has_enabled THEN o_enabled ELSE true END AS pruning_enabled,
         CASE WHEN has_threshold_angstrom THEN o_threshold_angstrom ELSE 4.0 END AS threshold
       FROM entry)""",
]


def overlaid(spark, sf):
    entries = s.table(spark, sf, "customer").selectExpr("c_custkey", *s.exprs(ENTRY))
    seeds = F.when(
        F.col("seed_count").isNotNull(),
        F.transform(
            F.sequence(F.lit(1), F.col("seed_count").cast("int")),
            lambda i: F.when((F.col("c_custkey") % 16 == 9) & (i > 1), F.lit(2)).otherwise(i).cast("bigint"),
        ),
    )
    return planning.overlay_manifest(entries.withColumn("o_seeds", seeds), DEFAULTS)


@query(
    "manifest_overlay",
    s.with_ctes(
        OVERLAY_SQL,
        """SELECT c_custkey, run_id, pose_id, replicas, base_seed, seed_count AS n_seeds,
             pruning_enabled, CAST(threshold AS DOUBLE) AS pruning_threshold_angstrom FROM resolved""",
    ),
)
def manifest_overlay(spark, sf):
    return overlaid(spark, sf).select(
        "c_custkey", "run_id", "pose_id", "replicas", "base_seed",
        F.size("seeds").alias("n_seeds"), "pruning_enabled", "pruning_threshold_angstrom",
    )


@query(
    "manifest_violations",
    s.with_ctes(
        OVERLAY_SQL,
        """SELECT run_id, pose_id, 'pose_id invalid' AS reason FROM resolved WHERE pose_id LIKE ' %'
           UNION ALL SELECT run_id, pose_id, 'ligand_resname invalid' FROM resolved WHERE ligand_resname LIKE '% %'
           UNION ALL SELECT run_id, pose_id, CASE WHEN replicas < 1 THEN 'replicas must be positive'
               WHEN base_seed > 2147483647 THEN 'base_seed must be a positive 32-bit integer'
               WHEN base_seed + replicas - 1 > 2147483647 THEN 'base_seed range exceeds the 32-bit seed limit'
               WHEN seed_count <> replicas THEN 'seeds length must equal replicas'
               WHEN c_custkey % 16 = 9 AND seed_count > 2 THEN 'explicit seeds must be unique' END
             FROM resolved
             WHERE replicas < 1 OR base_seed > 2147483647 OR base_seed + replicas - 1 > 2147483647
               OR seed_count <> replicas OR (c_custkey % 16 = 9 AND seed_count > 2)
           UNION ALL SELECT run_id, pose_id, 'threshold required when pruning is enabled' FROM resolved
             WHERE pruning_enabled AND threshold IS NULL
           UNION ALL SELECT run_id, pose_id, 'threshold must be null when pruning is disabled' FROM resolved
             WHERE NOT pruning_enabled AND threshold IS NOT NULL
           UNION ALL SELECT run_id, pose_id, 'threshold must be positive' FROM resolved WHERE threshold <= 0
           UNION ALL SELECT run_id, pose_id, 'pose_id values must be unique' FROM resolved
             GROUP BY run_id, pose_id HAVING count(*) > 1""",
    ),
)
def manifest_violations(spark, sf):
    return planning.manifest_violations(overlaid(spark, sf))


@query(
    "manifest_payload",
    s.with_ctes(
        OVERLAY_SQL,
        """SELECT c_custkey, concat('{"pose_id":"', pose_id, '","ligand_resname":"', ligand_resname,
             '","replicas":', replicas, ',"n_seeds":', coalesce(CAST(seed_count AS VARCHAR), 'null'), '}')
             AS payload FROM resolved""",
    ),
)
def manifest_payload(spark, sf):
    """Build the nested payload, then read the nested fields back out of it."""
    rows = overlaid(spark, sf)
    for name in ("prepared_system_dir", "start_structure", "topology", "index"):
        rows = rows.withColumn(name, F.concat(F.lit(name + "/"), F.col("c_custkey")))
    payload = rows.select("c_custkey", planning.manifest_payload().alias("p"))
    seeds = F.from_json(
        F.get_json_object("p", "$.overrides.trajectory.seeds"), "array<bigint>"
    )
    return payload.select(
        "c_custkey",
        F.concat(
            F.lit('{"pose_id":"'), F.get_json_object("p", "$.pose_id"),
            F.lit('","ligand_resname":"'), F.get_json_object("p", "$.ligand_resname"),
            F.lit('","replicas":'), F.get_json_object("p", "$.overrides.trajectory.replicas"),
            F.lit(',"n_seeds":'), F.coalesce(F.size(seeds).cast("string"), F.lit("null")), F.lit("}"),
        ).alias("payload"),
    )


MANIFEST_LINE = (
    "concat('{\"pose_id\": \"', c_name, '\", \"ligand_resname\": \"LIG\"', "
    "CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ', \"overrides\": {\"pruning\": {\"threshold_angstrom\": null}}' "
    "WHEN 2 THEN concat(', \"overrides\": {\"trajectory\": {\"seeds\": [1, ', c_custkey + 2, ']}}') "
    "ELSE ', \"overrides\": {\"trajectory\": {\"replicas\": 3, \"color\": 1}}, \"note\": 1' END, '}')"
)


@query(
    "manifest_scan",
    """SELECT c_custkey, c_name AS pose_id, c_custkey % 4 = 1 AS has_threshold_angstrom, c_custkey % 4 = 2 AS has_seeds,
         CASE WHEN c_custkey % 4 = 3 THEN 3 END AS replicas, CASE WHEN c_custkey % 4 = 2 THEN c_custkey + 3 END AS seed_sum,
         CASE WHEN c_custkey % 4 = 3 THEN 'note,overrides.trajectory.color' ELSE '' END AS unknown FROM customer""",
)
def manifest_scan(spark, sf):
    """A manifest entry per customer, with present nulls and unknown keys."""
    lines = s.table(spark, sf, "customer").selectExpr("c_custkey", f"{MANIFEST_LINE} AS value")
    return parse_pose_manifest(lines).select(
        "c_custkey", "pose_id", "has_threshold_angstrom", "has_seeds",
        F.col("overrides.trajectory.replicas").alias("replicas"),
        F.aggregate("overrides.trajectory.seeds", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("seed_sum"),
        F.array_join(F.array_sort("unknown_fields"), ",").alias("unknown"),
    )


# --- roll-ups ------------------------------------------------------------

ROLLUP_SQL = [
    *s.STATE_SQL,
    """folded AS (SELECT run_id, pose_id, count(*) AS n, count(*) FILTER (status = 'COMPLETED') AS done,
         count(*) FILTER (status = 'FAILED') AS failed,
         count(*) FILTER (status = 'INTERRUPTED') AS interrupted, max(max_rmsd_angstrom) AS m
       FROM replicas GROUP BY run_id, pose_id)""",
    """final AS (SELECT p.run_id, p.pose_id,
         CASE WHEN p.status = 'PRUNED' THEN 'PRUNED' WHEN n = done THEN 'COMPLETED'
           WHEN failed > 0 THEN 'FAILED' WHEN interrupted > 0 THEN 'INTERRUPTED' ELSE 'INCOMPLETE' END AS final_status,
         coalesce(m, p.observed_max_rmsd_angstrom) AS observed
       FROM poses p LEFT JOIN folded f ON p.run_id = f.run_id AND p.pose_id = f.pose_id)""",
    """final_runs AS (SELECT run_id, count(*) AS n_poses,
         CASE WHEN count(*) = 1 THEN min(final_status)
           WHEN count(*) FILTER (final_status = 'FAILED') > 0 THEN 'FAILED'
           WHEN count(*) FILTER (final_status = 'INTERRUPTED') > 0 THEN 'INTERRUPTED'
           WHEN count(*) FILTER (final_status = 'INCOMPLETE') > 0 THEN 'INCOMPLETE'
           WHEN count(*) FILTER (final_status <> 'PRUNED') = 0 THEN 'PRUNED'
           ELSE 'COMPLETED' END AS final_status FROM final GROUP BY run_id)""",
]


@query(
    "pose_rollup",
    s.with_ctes(
        ROLLUP_SQL,
        """SELECT run_id, pose_id, final_status, observed AS final_observed_max_angstrom,
             CASE WHEN final_status = 'COMPLETED' THEN observed END AS final_score_angstrom FROM final""",
    ),
)
def pose_rollup(spark, sf):
    return tr.pose_rollup(s.poses(spark, sf), s.replicas(spark, sf))


@query("run_rollup", s.with_ctes(ROLLUP_SQL, "SELECT run_id, n_poses, final_status FROM final_runs"))
def run_rollup(spark, sf):
    return tr.run_rollup(pose_rollup(spark, sf))


@query(
    "finalise_runs",
    s.with_ctes(
        ROLLUP_SQL,
        """SELECT r.run_id, f.final_status AS status, r.stop_requested, r.resume_count
           FROM runs r JOIN final_runs f ON r.run_id = f.run_id""",
    ),
)
def finalise_runs(spark, sf):
    runs, poses, replicas, _ = state(spark, sf)
    return tr.finalise(runs, poses, replicas, now())["runs"]


@query(
    "finalise_poses",
    s.with_ctes(
        ROLLUP_SQL,
        """SELECT p.run_id, p.pose_id, f.final_status AS status, f.observed AS observed_max_rmsd_angstrom,
             CASE WHEN f.final_status = 'COMPLETED' THEN f.observed END AS md_score_angstrom,
             p.trigger_replica_id
           FROM poses p JOIN final f ON p.run_id = f.run_id AND p.pose_id = f.pose_id""",
    ),
)
def finalise_poses(spark, sf):
    runs, poses, replicas, _ = state(spark, sf)
    return (
        tr.finalise(runs, poses.withColumn("finished_at", F.lit(None).cast("string")), replicas, now())["poses"]
        .select("run_id", "pose_id", "status", "observed_max_rmsd_angstrom", "md_score_angstrom",
                "trigger_replica_id")
    )


@query(
    "event_code_counts",
    s.with_ctes(
        ROLLUP_SQL,
        """SELECT run_id, 'POSE_FINALIZED' AS code, count(*) AS n FROM final GROUP BY run_id
           UNION ALL SELECT run_id, 'RUN_FINALIZED', 1 FROM final_runs""",
    ),
)
def event_code_counts(spark, sf):
    runs, poses, replicas, _ = state(spark, sf)
    tables = tr.finalise(runs, poses.withColumn("finished_at", F.lit(None).cast("string")), replicas, now())
    return tr.event_code_counts(tables["events"])


# --- pruning -------------------------------------------------------------

PRUNE_SQL = [
    *s.STATE_SQL,
    s.MESSAGES_SQL,
    """trig AS (SELECT run_id, pose_id, replica_id, min(time_ps) AS time_ps,
         arg_min(rmsd_angstrom, time_ps) AS rmsd_angstrom
       FROM messages WHERE rmsd_angstrom > 2 GROUP BY run_id, pose_id, replica_id)""",
    """judged AS (SELECT t.*, p.status, p.pruning_enabled, p.pruning_threshold_angstrom AS lim,
         CASE WHEN p.pose_id IS NULL THEN 'pose does not exist'
           WHEN NOT p.pruning_enabled THEN 'pruning is disabled'
           WHEN t.rmsd_angstrom <= p.pruning_threshold_angstrom THEN 'trigger does not exceed the threshold'
           WHEN p.status NOT IN ('RUNNING', 'PRUNED') THEN 'pose is in another state' END AS refusal
       FROM trig t LEFT JOIN poses p ON t.run_id = p.run_id AND t.pose_id = p.pose_id)""",
    """good AS (SELECT * FROM judged WHERE refusal IS NULL)""",
    """verdict AS (SELECT run_id, pose_id, max(rmsd_angstrom) AS largest, min(time_ps) AS t,
         arg_min(replica_id, {'a': time_ps, 'b': replica_id}) AS r,
         arg_min(rmsd_angstrom, {'a': time_ps, 'b': replica_id}) AS v FROM good GROUP BY run_id, pose_id)""",
    """pruned AS (SELECT p.run_id, p.pose_id, v.pose_id IS NOT NULL AS hit, p.status AS old_status,
         v.pose_id IS NOT NULL AND p.status = 'RUNNING' AS opens, v.r AS reporter,
         CASE WHEN v.pose_id IS NOT NULL THEN 'PRUNED' ELSE p.status END AS status,
         CASE WHEN v.pose_id IS NULL THEN p.md_score_angstrom END AS md_score_angstrom,
         CASE WHEN v.pose_id IS NULL THEN p.observed_max_rmsd_angstrom
           ELSE greatest(coalesce(p.observed_max_rmsd_angstrom, 0), v.largest) END AS observed_max_rmsd_angstrom,
         v.pose_id IS NOT NULL AND (p.trigger_replica_id IS NULL OR v.t < p.trigger_simulation_time_ps
           OR (v.t = p.trigger_simulation_time_ps AND v.r < p.trigger_replica_id)) AS newer,
         v.r, v.t, v.v, p.trigger_replica_id, p.trigger_simulation_time_ps, p.trigger_observed_rmsd_angstrom
       FROM poses p LEFT JOIN verdict v ON p.run_id = v.run_id AND p.pose_id = v.pose_id)""",
]


def pruned_tables(spark, sf):
    _, poses, replicas, tasks = state(spark, sf)
    triggers = (
        s.messages(spark, sf)
        .filter("rmsd_angstrom > 2")
        .groupBy(*KEY)
        .agg(F.min(F.struct("time_ps", "rmsd_angstrom")).alias("t"))
        .select(*KEY, "t.*")
    )
    return tr.apply_pruning(poses, replicas, tasks, triggers, now())


@query(
    "apply_pruning",
    s.with_ctes(
        PRUNE_SQL,
        """SELECT run_id, pose_id, status, md_score_angstrom, observed_max_rmsd_angstrom,
             CASE WHEN newer THEN r ELSE trigger_replica_id END AS trigger_replica_id,
             CASE WHEN newer THEN t ELSE trigger_simulation_time_ps END AS trigger_simulation_time_ps,
             CASE WHEN newer THEN v ELSE trigger_observed_rmsd_angstrom END AS trigger_observed_rmsd_angstrom
           FROM pruned""",
    ),
)
def apply_pruning(spark, sf):
    return pruned_tables(spark, sf)["poses"].select(
        "run_id", "pose_id", "status", "md_score_angstrom", "observed_max_rmsd_angstrom",
        "trigger_replica_id", "trigger_simulation_time_ps", "trigger_observed_rmsd_angstrom",
    )


@query(
    "apply_pruning_tasks",
    s.with_ctes(
        PRUNE_SQL,
        """SELECT t.task_id,
             CASE WHEN opens AND t.status = 'PENDING' THEN 'SKIPPED' ELSE t.status END AS status,
             CASE WHEN opens AND t.status = 'RUNNING' AND t.replica_id <> p.reporter THEN true
               ELSE t.stop_requested END AS stop_requested,
             CASE WHEN opens AND t.status = 'PENDING' THEN 'pose pruned'
               WHEN opens AND t.status = 'RUNNING' AND t.replica_id <> p.reporter THEN 'sibling triggered pruning'
               ELSE t.last_error END AS last_error
           FROM tasks t LEFT JOIN pruned p ON t.run_id = p.run_id AND t.pose_id = p.pose_id""",
    ),
)
def apply_pruning_tasks(spark, sf):
    return pruned_tables(spark, sf)["tasks"].select(
        "task_id", "status", "stop_requested", "last_error"
    )


@query(
    "apply_pruning_replicas",
    s.with_ctes(
        PRUNE_SQL,
        """SELECT x.run_id, x.pose_id, x.replica_id,
             CASE WHEN opens AND x.status = 'PENDING' THEN 'SKIPPED' ELSE x.status END AS status,
             x.triggered_pruning OR g.pose_id IS NOT NULL AS triggered_pruning
           FROM replicas x LEFT JOIN pruned p ON x.run_id = p.run_id AND x.pose_id = p.pose_id
           LEFT JOIN good g ON x.run_id = g.run_id AND x.pose_id = g.pose_id AND x.replica_id = g.replica_id""",
    ),
)
def apply_pruning_replicas(spark, sf):
    return pruned_tables(spark, sf)["replicas"].select(*KEY, "status", "triggered_pruning")


@query(
    "pruning_events",
    s.with_ctes(
        PRUNE_SQL,
        """SELECT g.run_id, g.pose_id, CASE WHEN opens AND g.replica_id = reporter THEN 'POSE_PRUNED'
             ELSE 'PRUNING_TRIGGER_OBSERVED' END AS code, g.replica_id AS observed_replica,
             g.time_ps AS observed_time, g.rmsd_angstrom AS observed_rmsd,
             CASE WHEN newer THEN r ELSE trigger_replica_id END AS canonical_replica,
             CASE WHEN newer THEN t ELSE trigger_simulation_time_ps END AS canonical_time,
             CASE WHEN newer THEN v ELSE trigger_observed_rmsd_angstrom END AS canonical_rmsd,
             'canonical_trigger,observed_trigger,pose_id' AS payload_keys,
             'observed_rmsd_angstrom,replica_id,simulation_time_ps' AS trigger_keys
           FROM good g JOIN pruned p ON g.run_id = p.run_id AND g.pose_id = p.pose_id""",
    ),
)
def pruning_events(spark, sf):
    def field(path: str):
        return F.get_json_object("payload_json", f"$.{path}")

    def fields(prefix: str) -> list:
        trigger = f"{prefix}_trigger"
        return [
            field(f"{trigger}.replica_id").alias(f"{prefix}_replica"),
            field(f"{trigger}.simulation_time_ps").cast("double").alias(f"{prefix}_time"),
            field(f"{trigger}.observed_rmsd_angstrom").cast("double").alias(f"{prefix}_rmsd"),
        ]

    return pruned_tables(spark, sf)["events"].select(
        "run_id", "pose_id", "code", *fields("observed"), *fields("canonical"),
        F.concat_ws(",", F.json_object_keys("payload_json")).alias("payload_keys"),
        F.concat_ws(",", F.json_object_keys(field("observed_trigger"))).alias("trigger_keys"),
    )


@query(
    "pruning_refusals",
    s.with_ctes(
        PRUNE_SQL,
        "SELECT run_id, pose_id, replica_id, refusal FROM judged WHERE refusal IS NOT NULL",
    ),
)
def pruning_refusals(spark, sf):
    return pruned_tables(spark, sf)["refused"].select(*KEY, "refusal")


# --- completion and progress --------------------------------------------

OWNED_SQL = [
    *s.STATE_SQL,
    s.MESSAGES_SQL,
    """owned AS (SELECT m.* FROM messages m JOIN tasks t ON m.task_id = t.task_id
         AND m.claim_token = t.claim_token WHERE t.status = 'RUNNING')""",
    """done AS (SELECT * FROM owned WHERE status <> 'SKIPPED'
         QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY sequence) = 1)""",
    """fold AS (SELECT task_id, run_id, pose_id, replica_id, arg_max(stage_reached, sequence) AS stage,
         arg_max(trajectory_time_completed_ps, sequence) AS t, count(*) AS n,
         arg_max(max_rmsd_nm, sequence) FILTER (max_rmsd_nm IS NOT NULL) AS nm,
         arg_max(max_rmsd_angstrom, sequence) FILTER (max_rmsd_angstrom IS NOT NULL) AS a
       FROM owned GROUP BY task_id, run_id, pose_id, replica_id)""",
]


def completed_tables(spark, sf):
    _, _, replicas, tasks = state(spark, sf)
    return tr.apply_completion(tasks, replicas, s.messages(spark, sf), now())


@query(
    "apply_completion",
    s.with_ctes(
        OWNED_SQL,
        """SELECT t.task_id, coalesce(d.status, t.status) AS status,
             CASE WHEN d.task_id IS NULL THEN t.claim_token END AS claim_token,
             CASE WHEN d.task_id IS NULL THEN t.last_error ELSE d.error END AS last_error,
             CASE WHEN d.task_id IS NULL THEN t.process_state ELSE 'NONE' END AS process_state,
             d.task_id IS NULL AND t.stop_requested AS stop_requested
           FROM tasks t LEFT JOIN done d ON t.task_id = d.task_id""",
    ),
)
def apply_completion(spark, sf):
    return completed_tables(spark, sf)["tasks"].select(
        "task_id", "status", "claim_token", "last_error", "process_state", "stop_requested"
    )


@query(
    "apply_completion_replicas",
    s.with_ctes(
        OWNED_SQL,
        """SELECT x.run_id, x.pose_id, x.replica_id, coalesce(d.status, x.status) AS status,
             CASE WHEN d.task_id IS NULL THEN x.max_rmsd_nm ELSE d.max_rmsd_nm END AS max_rmsd_nm,
             CASE WHEN d.task_id IS NULL THEN x.exit_code ELSE d.exit_code END AS exit_code,
             coalesce(d.stage_reached, x.stage_reached) AS stage_reached
           FROM replicas x LEFT JOIN done d ON x.run_id = d.run_id AND x.pose_id = d.pose_id
             AND x.replica_id = d.replica_id""",
    ),
)
def apply_completion_replicas(spark, sf):
    return completed_tables(spark, sf)["replicas"].select(
        *KEY, "status", "max_rmsd_nm", "exit_code", "stage_reached"
    )


@query(
    "completion_events",
    s.with_ctes(
        OWNED_SQL,
        "SELECT run_id, pose_id, concat('TASK_', status) AS code, exit_code FROM done",
    ),
)
def completion_events(spark, sf):
    return completed_tables(spark, sf)["events"].select(
        "run_id", "pose_id", "code",
        F.get_json_object("payload_json", "$.exit_code").cast("int").alias("exit_code"),
    )


def progressed_tables(spark, sf):
    _, _, replicas, tasks = state(spark, sf)
    return tr.apply_progress(tasks, replicas, s.messages(spark, sf), now())


@query(
    "apply_progress",
    s.with_ctes(
        OWNED_SQL,
        """SELECT x.run_id, x.pose_id, x.replica_id, coalesce(f.stage, x.stage_reached) AS stage_reached,
             coalesce(f.t, x.trajectory_time_completed_ps) AS trajectory_time_completed_ps,
             coalesce(f.nm, x.max_rmsd_nm) AS max_rmsd_nm, coalesce(f.a, x.max_rmsd_angstrom) AS max_rmsd_angstrom
           FROM replicas x LEFT JOIN fold f ON x.run_id = f.run_id AND x.pose_id = f.pose_id
             AND x.replica_id = f.replica_id""",
    ),
)
def apply_progress(spark, sf):
    return progressed_tables(spark, sf)["replicas"].select(
        *KEY, "stage_reached", "trajectory_time_completed_ps", "max_rmsd_nm", "max_rmsd_angstrom"
    )


@query(
    "heartbeat_counts",
    s.with_ctes(
        OWNED_SQL,
        """SELECT t.task_id, t.heartbeat_write_count + coalesce(f.n, 0) AS heartbeat_write_count
           FROM tasks t LEFT JOIN fold f ON t.task_id = f.task_id""",
    ),
)
def heartbeat_counts(spark, sf):
    return progressed_tables(spark, sf)["tasks"].select("task_id", "heartbeat_write_count")


# --- stop, resume, retry -------------------------------------------------

STOPPED = "length(run_id) % 2 = 1"


def stopped_tables(spark, sf):
    runs, poses, replicas, tasks = state(spark, sf)
    return tr.apply_stop(runs, poses, replicas, tasks, runs.filter(STOPPED).select("run_id"), now())


@query(
    "apply_stop",
    s.with_ctes(
        s.STATE_SQL,
        f"""SELECT task_id, CASE WHEN {STOPPED} AND status = 'PENDING' THEN 'INTERRUPTED' ELSE status END AS status,
              CASE WHEN {STOPPED} AND status = 'RUNNING' THEN true ELSE stop_requested END AS stop_requested,
              CASE WHEN {STOPPED} AND status IN ('PENDING', 'RUNNING') THEN 'user stop requested'
                ELSE last_error END AS last_error FROM tasks""",
    ),
)
def apply_stop(spark, sf):
    return stopped_tables(spark, sf)["tasks"].select(
        "task_id", "status", "stop_requested", "last_error"
    )


@query(
    "apply_stop_poses",
    s.with_ctes(
        s.STATE_SQL,
        f"""SELECT run_id, pose_id, CASE WHEN {STOPPED} AND status IN ('PENDING', 'RUNNING')
              THEN 'INTERRUPTED' ELSE status END AS status FROM poses""",
    ),
)
def apply_stop_poses(spark, sf):
    return stopped_tables(spark, sf)["poses"].select("run_id", "pose_id", "status")


@query(
    "stop_event_members",
    s.with_ctes(
        s.STATE_SQL,
        f"""SELECT run_id, 'STOP_REQUESTED' AS code, 'running_task' AS role, task_id AS member
            FROM tasks WHERE {STOPPED} AND status = 'RUNNING'""",
    ),
)
def stop_event_members(spark, sf):
    return stopped_tables(spark, sf)["event_members"].drop("pose_id")


RESUME_SQL = [
    *s.STATE_SQL,
    """seen AS (SELECT t.*, p.status AS pose_status, r.stop_requested AS run_stop,
         CASE WHEN t.stop_requested THEN coalesce(t.last_error, 'persisted task stop intent')
           WHEN p.status = 'PRUNED' THEN 'persisted pose PRUNED state'
           WHEN r.stop_requested THEN 'persisted run stop intent' END AS evidence
       FROM tasks t JOIN poses p ON t.run_id = p.run_id AND t.pose_id = p.pose_id
       JOIN runs r ON t.run_id = r.run_id WHERE t.status = 'RUNNING')""",
    """decided AS (SELECT *, CASE
         WHEN process_state = 'EXITED' AND (process_pid IS NULL OR process_start_token IS NULL
           OR process_returncode IS NULL OR process_finished_at IS NULL) THEN 'REFUSED_INCOMPLETE_EXIT'
         WHEN process_state = 'EXITED' AND process_returncode = 0 THEN 'DURABLE_EXITED_SUCCESS'
         WHEN process_state = 'EXITED' AND evidence IS NOT NULL THEN 'DURABLE_EXITED_INTERRUPTED'
         WHEN process_state = 'EXITED' THEN 'DURABLE_EXITED_FAILED'
         WHEN process_state = 'NONE' OR process_pid IS NULL OR process_start_token IS NULL THEN 'REFUSED_NO_IDENTITY'
         WHEN probe_status = 'MATCHING_LIVE' THEN 'REFUSED_LIVE_PROCESS'
         WHEN probe_status IS NULL THEN 'REFUSED_UNVERIFIABLE'
         ELSE probe_status END AS outcome FROM seen)""",
    """reasoned AS (SELECT *, CASE WHEN outcome = 'DURABLE_EXITED_INTERRUPTED' THEN
             concat(coalesce(process_step_id, 'unknown command step'), ' exited with code ', process_returncode,
               ' after cooperative cancellation: ', evidence)
           WHEN outcome = 'DURABLE_EXITED_FAILED' THEN
             concat(coalesce(process_step_id, 'unknown command step'), ' exited with code ', process_returncode,
               ' without durable cooperative cancellation evidence') END AS reason FROM decided)""",
    """blocked AS (SELECT DISTINCT run_id FROM decided WHERE outcome LIKE 'REFUSED%')""",
    """next_tasks AS (SELECT t.task_id, t.run_id, t.pose_id,
         CASE WHEN b.run_id IS NOT NULL THEN t.status
           WHEN coalesce(d.outcome, '') = 'DURABLE_EXITED_FAILED' THEN 'FAILED'
           WHEN t.status IN ('RUNNING', 'INTERRUPTED') THEN
             CASE WHEN p.status <> 'PRUNED' THEN 'PENDING' ELSE 'INTERRUPTED' END
           ELSE t.status END AS status,
         CASE WHEN b.run_id IS NOT NULL THEN t.last_error
           WHEN d.outcome = 'DURABLE_EXITED_FAILED' THEN d.reason
           WHEN t.status IN ('RUNNING', 'INTERRUPTED') AND p.status <> 'PRUNED' THEN NULL
           WHEN d.outcome = 'DURABLE_EXITED_INTERRUPTED' THEN d.reason
           ELSE t.last_error END AS last_error,
         CASE WHEN b.run_id IS NOT NULL THEN t.process_state
           WHEN t.status = 'RUNNING' AND coalesce(d.outcome, '') <> 'DURABLE_EXITED_FAILED' THEN 'NONE'
           ELSE t.process_state END AS process_state
       FROM tasks t LEFT JOIN poses p ON t.run_id = p.run_id AND t.pose_id = p.pose_id
       LEFT JOIN blocked b ON t.run_id = b.run_id LEFT JOIN reasoned d ON t.task_id = d.task_id)""",
]


@query(
    "resume_decisions",
    s.with_ctes(RESUME_SQL, "SELECT task_id, outcome, evidence, reason FROM reasoned"),
)
def resume_decisions(spark, sf):
    runs, poses, _, tasks = state(spark, sf)
    return tr.resume_decisions(runs, poses, tasks).select("task_id", "outcome", "evidence", "reason")


def resumed_tables(spark, sf):
    return tr.reconcile_resume(*state(spark, sf), now())


@query(
    "resume_reconcile",
    s.with_ctes(RESUME_SQL, "SELECT task_id, status, last_error, process_state FROM next_tasks"),
)
def resume_reconcile(spark, sf):
    return resumed_tables(spark, sf)["tasks"].select(
        "task_id", "status", "last_error", "process_state"
    )


@query(
    "resume_replicas",
    s.with_ctes(
        RESUME_SQL,
        """SELECT x.run_id, x.pose_id, x.replica_id, CASE WHEN b.run_id IS NOT NULL THEN x.status
             WHEN coalesce(d.outcome, '') = 'DURABLE_EXITED_FAILED' THEN 'FAILED'
             WHEN x.status IN ('RUNNING', 'INTERRUPTED') THEN
               CASE WHEN p.status <> 'PRUNED' THEN 'PENDING' ELSE 'INTERRUPTED' END
             ELSE x.status END AS status,
             CASE WHEN b.run_id IS NOT NULL THEN x.exit_code
               WHEN d.outcome = 'DURABLE_EXITED_FAILED' THEN d.process_returncode
               WHEN x.status IN ('RUNNING', 'INTERRUPTED') AND p.status <> 'PRUNED' THEN NULL
               WHEN d.outcome = 'DURABLE_EXITED_INTERRUPTED' THEN d.process_returncode
               ELSE x.exit_code END AS exit_code
           FROM replicas x LEFT JOIN poses p ON x.run_id = p.run_id AND x.pose_id = p.pose_id
           LEFT JOIN blocked b ON x.run_id = b.run_id
           LEFT JOIN reasoned d ON x.run_id = d.run_id AND x.pose_id = d.pose_id AND x.replica_id = d.replica_id""",
    ),
)
def resume_replicas(spark, sf):
    return resumed_tables(spark, sf)["replicas"].select(*KEY, "status", "exit_code")


@query(
    "resume_poses",
    s.with_ctes(
        RESUME_SQL,
        """SELECT p.run_id, p.pose_id, CASE WHEN b.run_id IS NULL
               AND p.status IN ('INTERRUPTED', 'INCOMPLETE', 'FAILED') AND EXISTS (
                 SELECT 1 FROM next_tasks n WHERE n.run_id = p.run_id AND n.pose_id = p.pose_id
                   AND n.status = 'PENDING') THEN 'RUNNING' ELSE p.status END AS status
           FROM poses p LEFT JOIN blocked b ON p.run_id = b.run_id""",
    ),
)
def resume_poses(spark, sf):
    return resumed_tables(spark, sf)["poses"].select("run_id", "pose_id", "status")


@query(
    "resume_runs",
    s.with_ctes(
        RESUME_SQL,
        """SELECT r.run_id, CASE WHEN b.run_id IS NULL THEN false ELSE r.stop_requested END AS stop_requested,
             CASE WHEN b.run_id IS NULL THEN 1 ELSE 0 END AS resume_count
           FROM runs r LEFT JOIN blocked b ON r.run_id = b.run_id""",
    ),
)
def resume_runs(spark, sf):
    return resumed_tables(spark, sf)["runs"].select("run_id", "stop_requested", "resume_count")


@query(
    "resume_event_codes",
    s.with_ctes(
        RESUME_SQL,
        """SELECT run_id, CASE outcome WHEN 'DURABLE_EXITED_FAILED' THEN 'DURABLE_COMMAND_EXIT_FAILED'
               ELSE 'DURABLE_COMMAND_EXIT_INTERRUPTED' END AS code, count(*) AS n
             FROM decided WHERE outcome IN ('DURABLE_EXITED_FAILED', 'DURABLE_EXITED_INTERRUPTED')
               AND run_id NOT IN (SELECT run_id FROM blocked) GROUP BY ALL
           UNION ALL SELECT run_id, 'RUN_RESUMED', 1 FROM runs WHERE run_id NOT IN (SELECT run_id FROM blocked)""",
    ),
)
def resume_event_codes(spark, sf):
    return tr.event_code_counts(resumed_tables(spark, sf)["events"])


RETRY_OK = "status = 'FAILED' AND pose_status <> 'PRUNED'"
RETRY_SQL = [
    *s.STATE_SQL,
    """tp AS (SELECT t.*, p.status AS pose_status FROM tasks t LEFT JOIN poses p
         ON t.run_id = p.run_id AND t.pose_id = p.pose_id)""",
]


@query(
    "retry_failed",
    s.with_ctes(
        RETRY_SQL,
        f"""SELECT task_id, CASE WHEN {RETRY_OK} THEN 'PENDING' ELSE status END AS status,
              CASE WHEN {RETRY_OK} THEN NULL ELSE last_error END AS last_error FROM tp""",
    ),
)
def retry_failed(spark, sf):
    _, poses, replicas, tasks = state(spark, sf)
    return tr.retry_failed(poses, replicas, tasks)["tasks"].select("task_id", "status", "last_error")


@query(
    "retry_events",
    s.with_ctes(
        RETRY_SQL,
        f"""SELECT tp.run_id, tp.pose_id, 'FAILED_TASK_REQUEUED' AS code,
              coalesce(tp.process_returncode, x.exit_code) AS returncode, tp.task_id
            FROM tp JOIN replicas x ON tp.run_id = x.run_id AND tp.pose_id = x.pose_id
              AND tp.replica_id = x.replica_id WHERE tp.{RETRY_OK}""",
    ),
)
def retry_events(spark, sf):
    _, poses, replicas, tasks = state(spark, sf)
    return tr.retry_failed(poses, replicas, tasks)["events"].select(
        "run_id", "pose_id", "code",
        F.get_json_object("payload_json", "$.returncode").cast("int").alias("returncode"),
        F.get_json_object("payload_json", "$.task_id").alias("task_id"),
    )


@query(
    "resume_preconditions",
    s.with_ctes(
        s.STATE_SQL,
        """SELECT run_id, 'resolved configuration checksum changed' AS reason FROM runs WHERE length(run_id) = 6
           UNION ALL SELECT run_id, 'input manifest checksum changed' FROM runs WHERE run_id LIKE '%7'""",
    ),
)
def resume_preconditions(spark, sf):
    base = s.runs(spark, sf)
    digest = F.sha2(F.col("run_id").cast("binary"), 256)
    runs = base.select(
        "run_id", digest.alias("config_sha256"), digest.alias("pose_manifest_sha256"),
        digest.alias("input_manifest_sha256"),
    )
    current = base.select(
        "run_id",
        F.when(F.length("run_id") == 6, "other").otherwise(digest).alias("config_sha256"),
        F.lit(None).cast("string").alias("pose_manifest_sha256"),
        F.when(F.col("run_id").endswith("7"), "other").otherwise(digest).alias("input_manifest_sha256"),
    )
    return tr.resume_preconditions(runs, current)


@query(
    "task_upgrade",
    s.with_ctes(
        s.STATE_SQL,
        """SELECT task_id, CASE WHEN status = 'RUNNING' AND process_pid IS NOT NULL
             AND process_start_token IS NOT NULL THEN 'RUNNING' ELSE 'NONE' END AS process_state,
             0 AS heartbeat_write_count FROM tasks""",
    ),
)
def task_upgrade(spark, sf):
    old = s.tasks(spark, sf).drop(
        "process_state", "process_returncode", "process_finished_at", "process_step_id",
        "heartbeat_write_count",
    )
    return tr.upgrade_tasks(old).select("task_id", "process_state", "heartbeat_write_count")


# --- queues --------------------------------------------------------------

PENDING_SQL = [
    *s.STATE_SQL,
    """waiting AS (SELECT t.*, p.pruning_threshold_angstrom, x.velocity_seed FROM tasks t
         JOIN replicas x ON t.run_id = x.run_id AND t.pose_id = x.pose_id AND t.replica_id = x.replica_id
         JOIN poses p ON t.run_id = p.run_id AND t.pose_id = p.pose_id
         WHERE t.status = 'PENDING' AND p.status = 'RUNNING')""",
    "depth AS (SELECT run_id, assigned_gpu_id, count(*) AS pending_count FROM waiting GROUP BY ALL)",
]


def waiting(spark, sf):
    return queues.pending_tasks(s.tasks(spark, sf), s.poses(spark, sf))


@query(
    "task_context",
    s.with_ctes(
        PENDING_SQL,
        "SELECT task_id, assigned_gpu_id, velocity_seed, pruning_threshold_angstrom FROM waiting",
    ),
)
def task_context(spark, sf):
    _, poses, replicas, tasks = state(spark, sf)
    return queues.task_context(tasks, replicas, poses).select(
        "task_id", "assigned_gpu_id", "velocity_seed", "pruning_threshold_angstrom"
    )


@query(
    "running_tasks",
    s.with_ctes(
        s.STATE_SQL,
        """SELECT task_id, p.status AS pose_status, t.process_state FROM tasks t JOIN poses p
           ON t.run_id = p.run_id AND t.pose_id = p.pose_id WHERE t.status = 'RUNNING'""",
    ),
)
def running_tasks(spark, sf):
    return queues.running_tasks(s.tasks(spark, sf), s.poses(spark, sf)).select(
        "task_id", "pose_status", "process_state"
    )


@query("queue_depth", s.with_ctes(PENDING_SQL, "SELECT * FROM depth"))
def queue_depth(spark, sf):
    return queues.queue_depth(waiting(spark, sf))


@query(
    "busiest_queue",
    s.with_ctes(
        PENDING_SQL,
        """SELECT run_id, assigned_gpu_id, pending_count FROM depth QUALIFY row_number() OVER (
             PARTITION BY run_id ORDER BY pending_count DESC, assigned_gpu_id) = 1""",
    ),
)
def busiest_queue(spark, sf):
    return queues.busiest_queue(queue_depth(spark, sf))


@query(
    "next_task",
    s.with_ctes(
        PENDING_SQL,
        "SELECT run_id, assigned_gpu_id, min(task_id) AS task_id FROM waiting GROUP BY ALL",
    ),
)
def next_task(spark, sf):
    return queues.next_task(waiting(spark, sf))


# --- exports -------------------------------------------------------------

STARTED_SQL = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS started_at"


@query(
    "pose_summary",
    s.with_ctes(
        [*s.STATE_SQL,
         """done AS (SELECT run_id, pose_id, count(*) AS n FROM replicas WHERE status = 'COMPLETED' GROUP BY ALL)""",
         f"started AS (SELECT concat('pose_', o_orderkey) AS pose_id, {STARTED_SQL} FROM orders)"],
        """SELECT p.run_id, p.pose_id, status, n_replicas_requested, coalesce(n, 0) AS n_replicas_completed,
             md_score_angstrom, observed_max_rmsd_angstrom, pruning_enabled, pruning_threshold_angstrom,
             trigger_replica_id, trigger_simulation_time_ps, CAST(NULL AS DOUBLE) AS docking_score_kcal_mol,
             started_at, CAST(NULL AS VARCHAR) AS finished_at
           FROM poses p LEFT JOIN done d ON p.run_id = d.run_id AND p.pose_id = d.pose_id
           JOIN started s ON s.pose_id = p.pose_id""",
    ),
)
def pose_summary(spark, sf):
    orders = s.table(spark, sf, "orders")
    poses = orders.select(
        *[F.expr(e).alias(n) for n, e in s.POSE.items()],
        utc_text(F.col("o_orderdate").cast("timestamp")).alias("started_at"),
        F.lit(None).cast("string").alias("finished_at"),
    )
    return tr.pose_summary(poses, s.replicas(spark, sf))


@query(
    "replica_summary",
    s.with_ctes(
        s.STATE_SQL,
        """SELECT run_id, pose_id, replica_id, status, gpu_id, velocity_seed, resolved_ntomp, stage_reached,
             trajectory_time_completed_ps, max_rmsd_nm, max_rmsd_angstrom,
             CAST(triggered_pruning AS INT) AS triggered_pruning, exit_code,
             CAST(NULL AS VARCHAR) AS started_at, CAST(NULL AS VARCHAR) AS finished_at FROM replicas""",
    ),
)
def replica_summary(spark, sf):
    none = F.lit(None).cast("string")
    return tr.replica_summary(
        s.replicas(spark, sf).withColumns({"started_at": none, "finished_at": none})
    )


@query(
    "failed_evidence",
    s.with_ctes(
        s.STATE_SQL,
        "SELECT run_id, concat(pose_id, ':', replica_id) AS evidence FROM replicas WHERE status = 'FAILED'",
    ),
)
def failed_evidence(spark, sf):
    return tr.failed_evidence(s.replicas(spark, sf))


@query(
    "run_report",
    s.with_ctes(
        s.STATE_SQL,
        """SELECT run_id, 0 AS section, '' AS pose_id, concat('# Run report: ', run_id) AS line FROM runs
           UNION ALL SELECT run_id, 1, '', '' FROM runs
           UNION ALL SELECT run_id, 2, '', concat('- Status: ', status) FROM runs
           UNION ALL SELECT run_id, 3, '', concat('- Pose count: ', count(*)) FROM poses GROUP BY run_id
           UNION ALL SELECT run_id, 4, pose_id, concat('- Pose `', pose_id, '`: status=', status, ', replicas=',
             n_replicas_requested, ', MD-score (angstrom)=',
             coalesce(CAST(md_score_angstrom AS VARCHAR), 'null')) FROM poses
           UNION ALL SELECT run_id, 5, '', '- Validation surface: local prepared-system execution' FROM runs""",
    ),
)
def run_report(spark, sf):
    return tr.run_report(s.runs(spark, sf), s.poses(spark, sf))


@query(
    "export_read_back",
    s.with_ctes(
        s.STATE_SQL,
        """SELECT right(run_id, 1) AS run_id, count(*) AS n_poses, count(DISTINCT pose_id) AS n_names,
             count(md_score_angstrom) AS n_scores, max(md_score_angstrom) AS max_score, 4 AS n_files,
             6 + count(*) - 1 AS n_report_lines, true AS manifest_whole
           FROM poses GROUP BY ALL""",
    ),
)
def export_read_back(spark, sf):
    """Summaries, report and manifest of ten large runs, published and read back."""
    whole = F.right("run_id", F.lit(1))
    poses = s.poses(spark, sf).withColumns(
        {"run_id": whole, "started_at": F.lit(None).cast("string"), "finished_at": F.lit(None).cast("string")}
    )
    replicas = s.replicas(spark, sf).withColumn("run_id", whole)
    runs = s.runs(spark, sf).groupBy(whole.alias("run_id")).agg(F.min("status").alias("status"))
    export = exports.Export(spark, scratch_dir(spark, "exports"))
    export.csv(tr.pose_summary(poses, replicas), "pose_summary.csv", POSE_SUMMARY_COLUMNS, ["pose_id"])
    maxima = replicas.select("run_id", "pose_id", "replica_id", "max_rmsd_nm")
    export.csv(maxima, "replica_maxima.csv", maxima.columns, ["pose_id", "replica_id"])
    export.lines(tr.run_report(runs, poses), "run_report.md", ["section", "pose_id"])
    export.lines(tr.run_manifest(runs, poses), "run_manifest.json", ORDER)
    export.publish()
    folder = exports.current(export.root)
    back = exports.read_csv(spark, folder, "pose_summary.csv", "run_id string, pose_id string, status string, "
                            "n_replicas_requested int, n_replicas_completed long, md_score_angstrom double")
    found = back.groupBy("run_id").agg(
        F.count("*").alias("n_poses"), F.count_distinct("pose_id").alias("n_names"),
        F.count("md_score_angstrom").alias("n_scores"), F.max("md_score_angstrom").alias("max_score"),
    )
    listed = exports.read_lines(spark, folder, exports.CHECKSUMS).groupBy("run_id").agg(F.count("*").alias("n_files"))
    report = exports.read_lines(spark, folder, "run_report.md").groupBy("run_id").agg(F.count("*").alias("n_report_lines"))
    manifest = spark.read.text(f"{folder}/table-*/part-*/*/run_manifest.json", wholetext=True).select(
        F.from_json("value", "run_id string, poses array<struct<pose_id:string>>").alias("m")
    ).select("m.run_id", F.size("m.poses").cast("long").alias("n_listed"))
    return (
        found.join(listed, "run_id").join(report, "run_id").join(manifest, "run_id")
        .withColumn("manifest_whole", F.col("n_listed") == F.col("n_poses")).drop("n_listed")
    )


EXPORTED = "event_id % 3 = 1"
PARAMS = (
    "CASE WHEN event_id % 9 = 1 THEN concat('{\"state_sequence\": \"', event_id, '\"}') "
    "ELSE concat('{\"state_payload\": ', props, ', \"state_sequence\": ', event_id, '}') END"
)


@query(
    "event_append",
    s.with_ctes(
        [*PRUNE_SQL, RETRY_SQL[-1]],
        f"""SELECT run_id, count(*) AS n_lines, count(*) AS n_sequences, 1 AS first_sequence,
              count(*) AS last_sequence, sum(second) AS n_second
            FROM (SELECT run_id, 0 AS second FROM good UNION ALL
              SELECT tp.run_id, 1 FROM tp JOIN replicas x ON tp.run_id = x.run_id AND tp.pose_id = x.pose_id
                AND tp.replica_id = x.replica_id WHERE tp.{RETRY_OK}) GROUP BY run_id""",
    ),
)
def event_append(spark, sf):
    """Events of two steps, from the transition to the exported log."""
    _, poses, replicas, tasks = state(spark, sf)
    none = spark.createDataFrame([], EVENTS)
    at = now().cast("timestamp")
    first = materialise(tr.append_events(pruned_tables(spark, sf)["events"], none, at), "events")
    second = materialise(tr.append_events(tr.retry_failed(poses, replicas, tasks)["events"], first, at), "events")
    log = as_log_events(first)
    fresh = not_exported(first.unionByName(second), exported_sequences(log))
    log = log.unionByName(as_log_events(fresh))
    sequence = state_sequence(F.col("params"))
    return log.groupBy("run_id").agg(
        F.count("*").alias("n_lines"),
        F.count_distinct(sequence).alias("n_sequences"),
        F.min(sequence).alias("first_sequence"),
        F.max(sequence).alias("last_sequence"),
        F.count_if(F.col("code") == "FAILED_TASK_REQUEUED").alias("n_second"),
    )


@query(
    "events_not_exported",
    f"""SELECT user_id % 4 AS run_id, event_id AS sequence, event_type AS code FROM events
        WHERE NOT ({EXPORTED} AND event_id % 9 <> 1)""",
)
def events_not_exported(spark, sf):
    """A log line counts as exported only when its sequence is a JSON integer."""
    events = s.table(spark, sf, "events")
    rows = events.select(
        (F.col("user_id") % 4).alias("run_id"), F.col("event_id").alias("sequence"),
        F.col("event_type").alias("code"),
    )
    log = events.filter(EXPORTED).selectExpr("user_id % 4 AS run_id", f"{PARAMS} AS params")
    return not_exported(rows, exported_sequences(log))


LOG_LINE = (
    "CASE event_id % 8 WHEN 3 THEN concat('broken ', event_id) WHEN 5 THEN '' "
    "ELSE concat('{\"run_id\": \"r', user_id % 4, '\", \"code\": \"', event_type, "
    "'\", \"params\": {\"state_sequence\": ', event_id, "
    "CASE WHEN event_id % 8 = 7 THEN '.5' ELSE '' END, '}, \"duration_ms\": ', event_id % 7, '}') END"
)


@query(
    "event_log_scan",
    """SELECT concat('r', user_id % 4) AS run_id, event_type AS code,
         CASE WHEN event_id % 8 <> 7 THEN event_id END AS sequence, CAST(event_id % 7 AS DOUBLE) AS duration_ms
       FROM events WHERE event_id % 8 NOT IN (3, 5)""",
)
def event_log_scan(spark, sf):
    """Log lines made from every event, some broken or blank, read as structured events."""
    lines = s.table(spark, sf, "events").selectExpr(f"{LOG_LINE} AS value")
    return parse_event_log(lines).select(
        "run_id", "code", state_sequence(F.col("params")).alias("sequence"), "duration_ms"
    )


@query(
    "state_snapshot",
    s.with_ctes(
        [s.SAMPLES_SQL, s.SAMPLE_POSES_SQL],
        "SELECT run_id, pose_id, n_replicas_requested, pruning_threshold_angstrom FROM sample_poses",
    ),
)
def state_snapshot(spark, sf):
    """A pose table written as a snapshot, replaced, and read through its pointer."""
    root = scratch_dir(spark, "state")
    first = s.sample_poses(spark, sf)
    write_table(first.withColumn("n_replicas_requested", F.lit(0)), root, "poses")
    write_table(first, root, "poses")
    return read_table(spark, root, "poses").select(
        "run_id", "pose_id", "n_replicas_requested", "pruning_threshold_angstrom"
    )


@query(
    "replace_artifacts",
    """SELECT source AS run_id, concat(source, '/', doc_id) AS artifact_path,
         CASE WHEN source = 'src2' THEN 0 ELSE n_chars END AS size_bytes
       FROM documents WHERE source <> 'src1' AND (source <> 'src2' OR doc_id % 3 = 0)""",
)
def replace_artifacts(spark, sf):
    """All runs registered, then one emptied and one replaced; the others stay."""
    path = scratch_dir(spark, "artifacts")
    rows = s.table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), "doc_id").alias("artifact_path"),
        F.lit(None).cast("string").alias("sha256"),
        F.col("n_chars").alias("size_bytes"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.col("source").alias("run_id"),
        "doc_id",
    )
    write_artifacts(rows.drop("doc_id"), path, rows)
    fresh = rows.filter("run_id = 'src2' AND doc_id % 3 = 0").drop("doc_id")
    write_artifacts(
        fresh.withColumn("size_bytes", F.lit(0).cast("bigint")), path,
        rows.filter("run_id IN ('src1', 'src2')"),
    )
    return read_artifacts(spark, path).select("run_id", "artifact_path", "size_bytes")


@query(
    "input_checksum_maps",
    """SELECT source AS run_id, doc_id // 4 AS pose_id, concat('d/', doc_id) AS destination, sha256(text) AS sha256
       FROM documents WHERE doc_id % 9 <> 4""",
)
def input_checksum_maps(spark, sf):
    """Checksum map of every pose, spread out again for the comparison."""
    rows = s.table(spark, sf, "documents").select(
        F.col("source").alias("run_id"),
        F.expr("doc_id div 4").alias("pose_id"),
        F.when(F.col("doc_id") % 9 == 4, EXTERNAL_DESTINATION)
        .otherwise(F.concat(F.lit("d/"), "doc_id")).alias("destination"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
    )
    maps = planning.checksum_maps(rows)
    return maps.select(
        "run_id", "pose_id", F.explode("input_checksums").alias("destination", "sha256")
    )


@query(
    "event_payloads",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         concat('{"k":', json_extract_string(props, '$.k'), ',"user":', user_id, '}') AS payload_json
       FROM events""",
)
def event_payloads(spark, sf):
    """Read a value out of the payload text and build a sorted-key payload from it."""
    events = s.table(spark, sf, "events").withColumn("p", F.from_json("props", "k bigint"))
    return events.select(
        "event_id", F.col("p.k").alias("k"),
        F.to_json(F.struct(F.col("p.k").alias("k"), F.col("user_id").alias("user"))).alias("payload_json"),
    )


# --- data quality --------------------------------------------------------


@query(
    "duplicate_keys",
    s.with_ctes(
        s.STATE_SQL,
        """SELECT 'line key' AS check_name, concat(l_orderkey, '|', l_linenumber) AS key, count(*) AS n
             FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
           UNION ALL SELECT 'task key', task_id, count(*) FROM tasks GROUP BY task_id HAVING count(*) > 1
           UNION ALL SELECT 'run seed', concat(run_id, '|', velocity_seed), count(*) FROM replicas
             GROUP BY run_id, velocity_seed HAVING count(*) > 1""",
    ),
)
def duplicate_keys(spark, sf):
    return quality.key_report(
        {
            "line key": (s.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]),
            "task key": (s.tasks(spark, sf), ["task_id"]),
            "run seed": (s.replicas(spark, sf), ["run_id", "velocity_seed"]),
        }
    )


@query(
    "orphans",
    """SELECT event_id, CAST(user_id AS BIGINT) AS user_id FROM events
       WHERE user_id NOT IN (SELECT c_nationkey FROM customer)""",
)
def orphans(spark, sf):
    """Events whose user is no nation key: a child side with hot keys against few parents."""
    parents = s.table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("user_id"))
    return quality.orphans(
        s.table(spark, sf, "events").select("event_id", "user_id"), parents, ["user_id"]
    )


@query(
    "state_orphans",
    s.with_ctes(
        s.STATE_SQL,
        """SELECT 'pose without replica' AS check_name, pose_id AS key FROM poses p WHERE NOT EXISTS (
             SELECT 1 FROM replicas x WHERE x.run_id = p.run_id AND x.pose_id = p.pose_id)
           UNION ALL SELECT 'replica without pose', x.pose_id FROM replicas x WHERE NOT EXISTS (
             SELECT 1 FROM poses p WHERE x.run_id = p.run_id AND x.pose_id = p.pose_id)""",
    ),
)
def state_orphans(spark, sf):
    _, poses, replicas, _ = state(spark, sf)
    key = ["run_id", "pose_id"]
    return (
        quality.orphans(poses, replicas, key)
        .select(F.lit("pose without replica").alias("check_name"), F.col("pose_id").alias("key"))
        .unionByName(
            quality.orphans(replicas, poses, key).select(
                F.lit("replica without pose").alias("check_name"), F.col("pose_id").alias("key")
            )
        )
    )


@query(
    "lifecycle_violations",
    s.with_ctes(
        s.STATE_SQL,
        """SELECT 'tasks' AS table_name, task_id AS key, 'exit evidence incomplete' AS reason FROM tasks
             WHERE process_state = 'EXITED' AND (process_pid IS NULL OR process_start_token IS NULL
               OR process_returncode IS NULL OR process_finished_at IS NULL)
           UNION ALL SELECT 'tasks', task_id, 'resolved_ntomp not positive' FROM tasks WHERE resolved_ntomp < 1
           UNION ALL SELECT 'poses', pose_id, 'score without completion' FROM poses
             WHERE status <> 'COMPLETED' AND md_score_angstrom IS NOT NULL""",
    ),
)
def lifecycle_violations(spark, sf):
    runs, poses, _, tasks = state(spark, sf)
    found = quality.violations(tasks, "tasks", F.col("task_id"), quality.task_rules())
    found = found.unionByName(quality.violations(poses, "poses", F.col("pose_id"), quality.pose_rules()))
    return found.unionByName(quality.violations(runs, "runs", F.col("run_id"), quality.run_rules()))
