"""Index groups, topology includes, stage settings and the preflight report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from posewatch.functions.settings import close, estimated_disk_bytes, whole_steps
from posewatch.functions.staging import staged
from posewatch.functions.text import parse_float, parse_int
from posewatch.schemas import REQUIRED_INDEX_GROUPS, STAGES
from posewatch.session import materialise, scratch_dir

# --- index groups --------------------------------------------------------


def group_sizes(index: DataFrame) -> DataFrame:
    """Atoms and headers per (file, group)."""
    return index.groupBy("file", "group").agg(
        F.countDistinct("group_ord").alias("n_groups"), F.count("atom").alias("n_atoms")
    )


def index_violations(
    index: DataFrame, required: Sequence[str] = tuple(REQUIRED_INDEX_GROUPS),
    whole: str = "Protein_LIG", parts: Sequence[str] = ("C-alpha", "LIG"),
) -> DataFrame:
    """(file, group, reason): groups missing, repeated, empty, with repeated or foreign atoms."""
    def finding(cond: Column, group: str, reason: Column) -> Column:
        return F.when(cond, F.struct(F.lit(group).alias("group"), reason.alias("reason")))

    # Headers and atoms per group are counted per header first, then per file: two
    # mergeable aggregates, no join.
    per_header = index.groupBy("file", "group", "group_ord").agg(F.count("atom").alias("n"))
    here = [F.col("group") == g for g in required]
    sizes = per_header.groupBy("file").agg(
        *[F.count_if(h).alias(f"groups_{i}") for i, h in enumerate(here)],
        *[F.sum(F.when(h, F.col("n"))).alias(f"atoms_{i}") for i, h in enumerate(here)],
    )
    presence = F.array(
        *[
            F.coalesce(
                finding(
                    F.col(f"groups_{i}") != 1,
                    g,
                    F.concat(F.lit("exists "), F.col(f"groups_{i}").cast("string"), F.lit(" times")),
                ),
                finding(F.col(f"atoms_{i}") == 0, g, F.lit("empty")),
            )
            for i, g in enumerate(required)
        ]
    )
    # Membership of every atom in every required group, one row per atom.
    members = index.filter(F.col("group").isin(*required) & F.col("atom").isNotNull()).groupBy(
        "file", "atom"
    ).agg(*[F.count_if(h).alias(f"in_{i}") for i, h in enumerate(here)])
    inside = F.col(f"in_{list(required).index(whole)}")
    content = F.array(
        *[finding(F.col(f"in_{i}") > 1, g, F.lit("repeated atoms")) for i, g in enumerate(required)],
        *[
            finding(
                (F.col(f"in_{i}") > 0) & (inside == 0), g, F.lit(f"not a subset of {whole}")
            )
            for i, g in enumerate(required)
            if g in parts
        ],
    )

    def spread(df: DataFrame, found: Column) -> DataFrame:
        return df.select("file", F.explode(F.array_compact(found)).alias("f")).select("file", "f.*")

    return spread(sizes, presence).unionByName(spread(members, content).distinct())


def remap_atoms(generated: DataFrame, positions: DataFrame) -> DataFrame:
    """Atoms of generated groups renumbered by their place in the extracted complex.

    ``positions`` has (file, atom, position). An atom without a place keeps a null
    position and a reason.
    """
    kept = [c for c in generated.columns if c not in ("position", "reason")]
    return generated.select(*kept).join(positions, ["file", "atom"], "left").select(
        *kept,
        "position",
        F.when(F.col("position").isNull(), "atom outside the complex").alias("reason"),
    )


def sequence_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places where two ordered groups (file, pos, atom) differ; none means equal.

    Both sides are folded by place, so no list of atoms is built.
    """
    tagged = a.select("file", "pos", F.col("atom").alias("a"), F.lit(None).cast("bigint").alias("b")).unionByName(
        b.select("file", "pos", F.lit(None).cast("bigint").alias("a"), F.col("atom").alias("b"))
    )
    return (
        tagged.groupBy("file", "pos")
        .agg(F.max("a").alias("left_atom"), F.max("b").alias("right_atom"))
        .filter(~F.col("left_atom").eqNullSafe(F.col("right_atom")))
    )


# --- includes ------------------------------------------------------------


def joined_path(folder: Column, name: Column) -> Column:
    """Folder and relative name as one path without ``.`` and ``..`` parts."""
    parts = F.split(F.when(name.startswith("/"), name).otherwise(F.concat_ws("/", folder, name)), "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        empty,
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(p.isin("", "."), acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def parent_folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def resolve_includes(
    edges: DataFrame, catalogue: DataFrame, root: str, external: Sequence[str] = ()
) -> DataFrame:
    """First existing candidate of every include.

    ``edges`` has (path, include), ``catalogue`` has (path) of existing files. The
    folder of the including file comes first, then the prepared root, then the
    external folders. A file inside the root is local, one inside an external
    folder external; others do not count.
    """
    folders = [parent_folder(F.col("path")), F.lit(root), *map(F.lit, external)]
    candidates = edges.select(
        "path",
        "include",
        F.posexplode(
            F.array(*[joined_path(folder, F.col("include")) for folder in folders])
        ).alias("priority", "target"),
    )
    local = F.col("target").startswith(root.rstrip("/") + "/")
    outside = F.lit(False)
    for folder in external:
        outside = outside | F.col("target").startswith(folder.rstrip("/") + "/")
    found = (
        candidates.filter(local | outside)
        .join(catalogue.select(F.col("path").alias("target")).distinct(), "target")
        .groupBy("path", "include")
        .agg(F.min(F.struct("priority", "target", local.alias("is_local"))).alias("hit"))
    )
    return edges.join(found, ["path", "include"], "left").select(
        "path",
        "include",
        F.col("hit.target").alias("target"),
        F.col("hit.is_local").alias("is_local"),
        F.when(F.col("hit").isNull(), "unresolved include").alias("reason"),
    )


def include_closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(system, path, depth) of all files reachable from the roots, each once.

    ``roots`` has (system, path), ``edges`` (path, target). The closure is taken once
    for each distinct start file and joined to the systems at the end, however many
    start there. One level is one join; visited files are dropped, so include cycles
    end. Each level is written to the scratch folder, which keeps the plan short and
    survives lost executors. The number of levels is the depth of the include graph.
    """
    spark = roots.sparkSession
    base = scratch_dir(spark, "closure")
    columns = ["start", "path"]
    starts = roots.select(F.col("path").alias("start"), "path").distinct()

    def write(rows: DataFrame, depth: int) -> DataFrame:
        path = f"{base}/depth={depth}"
        rows.select(*columns).write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.select(*columns).schema).parquet(path)

    def visited() -> DataFrame:
        schema = starts.schema.add("depth", IntegerType())
        return spark.read.schema(schema).option("basePath", base).parquet(base)

    step = materialise(edges.select("path", "target").distinct(), "edges")
    level = write(starts, 0)
    depth = 0
    while not level.isEmpty():
        depth += 1
        reached = (
            level.join(step, "path")
            .select("start", F.col("target").alias("path"))
            .distinct()
            .join(visited().select(*columns), columns, "left_anti")
        )
        level = write(reached, depth)
    wanted = roots.select("system", F.col("path").alias("start"))
    # A system with several start files has each file once, at its least depth.
    return wanted.join(visited(), "start").groupBy("system", "path").agg(F.min("depth").alias("depth"))


# --- stage settings ------------------------------------------------------

# Settings each stage overrides.
OVERRIDDEN = {
    "nvt": ["gen-vel", "gen-seed"],
    "npt": ["gen-vel"],
    "production": ["gen-vel", "nsteps", "nstxout-compressed"],
}


def resolved_settings(settings: DataFrame, replicas: DataFrame) -> DataFrame:
    """Settings of every replica and stage, overrides in place of the source values.

    ``settings`` has (system, stage, key, value), ``replicas`` has (system,
    replica_id, velocity_seed, production_steps, interval_steps). The overridden
    keys are fixed, so source rows are filtered out instead of ranked.
    """
    stage, key = F.col("stage"), F.col("key")
    covered = F.lit(False)
    for name, keys in OVERRIDDEN.items():
        covered = covered | ((stage == name) & key.isin(*keys))
    kept = settings.filter(~covered).join(replicas.select("system", "replica_id"), "system").select(
        "system", "replica_id", "stage", "key", "value"
    )
    values = F.array(
        *[
            F.struct(F.lit(s).alias("stage"), F.lit(k).alias("key"), v.cast("string").alias("value"))
            for s, k, v in [
                ("nvt", "gen-vel", F.lit("yes")),
                ("nvt", "gen-seed", F.col("velocity_seed")),
                ("npt", "gen-vel", F.lit("no")),
                ("production", "gen-vel", F.lit("no")),
                ("production", "nsteps", F.col("production_steps")),
                ("production", "nstxout-compressed", F.col("interval_steps")),
            ]
        ]
    )
    forced = replicas.select("system", "replica_id", F.explode(values).alias("s")).select(
        "system", "replica_id", "s.*"
    )
    return kept.unionByName(forced)


def settings_violations(settings: DataFrame, systems: DataFrame) -> DataFrame:
    """(system, stage, reason) for settings that break the stage rules.

    ``systems`` has (system, output_interval_ps, production_time_ns).
    """
    number, whole_number, word = F.col("__number"), F.col("__whole"), F.col("__word")

    def at(stage: str, key: str, value: Column) -> Column:
        return F.when((F.col("stage") == stage) & (F.col("key") == key), value)

    # Values are parsed before the aggregate, so that it keeps plain numbers and flags.
    read = staged(
        settings,
        ["system", "stage", "key"],
        __number=parse_float(F.col("value")),
        __whole=parse_int(F.col("value")),
        __word=F.lower("value"),
    )
    picks = []
    for stage in STAGES:
        wanted = "yes" if stage == "nvt" else "no"
        picks += [
            F.max(at(stage, "dt", number)).alias(f"dt_{stage}"),
            F.max(at(stage, "nsteps", whole_number)).alias(f"nsteps_{stage}"),
            F.bool_or(at(stage, "integrator", word == "md")).alias(f"md_{stage}"),
            F.bool_or(at(stage, "gen-vel", word == wanted)).alias(f"velocities_{stage}"),
        ]
    picks.append(F.max(at("production", "nstxout-compressed", whole_number)).alias("output_steps"))
    parsed = systems.join(read.groupBy("system").agg(*picks), "system", "left")

    faults = []

    def fault(stage: str, condition: Column, reason: str) -> None:
        faults.append(
            F.when(condition, F.struct(F.lit(stage).alias("stage"), F.lit(reason).alias("reason")))
        )

    for stage in STAGES:
        dt, nsteps = F.col(f"dt_{stage}"), F.col(f"nsteps_{stage}")
        fault(stage, dt.isNull(), "dt must be a numeric value")
        fault(stage, nsteps.isNull(), "nsteps must be an integer value")
        fault(stage, (dt <= 0) | (nsteps <= 0), "dt and nsteps must be positive")
        fault(stage, ~F.coalesce(f"md_{stage}", F.lit(False)), "integrator must be md")
        wanted = "yes" if stage == "nvt" else "no"
        fault(stage, ~F.coalesce(f"velocities_{stage}", F.lit(False)), f"gen-vel must be {wanted}")
    dt = F.col("dt_production")
    usable = dt > 0
    interval = F.col("output_interval_ps")
    source = F.col("output_steps")
    fault("production", usable & ~whole_steps(F.try_divide(interval, dt)),
          "output interval must be a multiple of dt")
    fault("production", usable & ~whole_steps(F.try_divide(F.col("production_time_ns") * 1000.0, dt)),
          "production time must be a whole step count")
    fault("production", source.isNull(), "nstxout-compressed must be an integer value")
    fault("production", usable & ~close(source * dt, interval, rel_tol=0.0),
          "compressed-output interval does not match")
    ruled = (
        parsed.select("system", F.explode(F.array_compact(F.array(*faults))).alias("f"))
        .select("system", "f.stage", "f.reason")
    )
    repeated = (
        settings.groupBy("system", "stage", "key").count().filter("count > 1")
        .select("system", "stage", F.concat(F.lit("duplicate key "), F.col("key")).alias("reason"))
    )
    return ruled.unionByName(repeated)


# --- preflight -----------------------------------------------------------


def missing_paths(required: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Required paths (system, root, path) that are outside their root or not there."""
    full = joined_path(F.col("root"), F.col("path"))
    placed = required.withColumn("full", full).withColumn(
        "escaped", ~F.col("full").startswith(F.concat(F.col("root"), F.lit("/")))
    )
    outside = placed.filter("escaped").select("system", "path", F.lit("outside the root").alias("reason"))
    absent = (
        placed.filter(~F.col("escaped"))
        .join(catalogue.select(F.col("path").alias("full")).distinct(), "full", "left_anti")
        .select("system", "path", F.lit("missing").alias("reason"))
    )
    return outside.unionByName(absent)


def preflight_checks(poses: DataFrame, faults: DataFrame) -> DataFrame:
    """One row per pose and rule.

    ``poses`` has (system, replicas, seeds, base_seed, pruning_enabled,
    pruning_threshold_angstrom, atoms, production_time_ns, output_interval_ps).
    ``faults`` has (system, area, reason) with area files, topology, index or
    settings. When files are missing the checks that read them are left out.
    """
    areas = ["files", "topology", "index", "settings"]
    counted = faults.groupBy("system").agg(
        *[F.count_if(F.col("area") == a).alias(f"n_{a}") for a in areas],
        *[F.min(F.when(F.col("area") == a, F.col("reason"))).alias(f"m_{a}") for a in areas],
    )
    seed_mode = (
        F.when(F.col("seeds").isNotNull(), "explicit")
        .when(F.col("base_seed").isNotNull(), "base_seed")
        .otherwise("resolve_and_persist_at_run_creation")
    )
    disk = estimated_disk_bytes(
        F.col("atoms"), F.col("production_time_ns"), F.col("output_interval_ps"), F.col("replicas")
    )

    def check(code, severity, status, detail) -> Column:
        def lit(v):
            return v if isinstance(v, Column) else F.lit(v)

        return F.struct(
            lit(code).alias("code"), lit(severity).alias("severity"), lit(status).alias("status"),
            lit(detail).alias("detail"),
        )

    def outcome(area: str, ok: str, bad: str) -> Column:
        n = F.coalesce(f"n_{area}", F.lit(0))
        passed = n == 0
        detail = F.when(passed, "").otherwise(
            F.concat(n.cast("string"), F.lit(" faults, first: "), F.col(f"m_{area}"))
        )
        return check(
            F.when(passed, ok).otherwise(bad), F.when(passed, "INFO").otherwise("ERROR"),
            F.when(passed, "PASS").otherwise("FAIL"), detail,
        )

    present = F.coalesce("n_files", F.lit(0)) == 0
    estimate = F.when(
        F.col("atoms").isNull(), check("DISK_ESTIMATE_ERROR", "ERROR", "FAIL", "no atom count")
    ).otherwise(
        check("DISK_ESTIMATE_OK", "INFO", "PASS",
              F.concat(F.lit("estimated_bytes="), disk.cast("bigint").cast("string")))
    )
    checks = F.array(
        check("SEED_CONFIGURATION_VALID", "INFO", "PASS",
              F.concat(F.lit("mode="), seed_mode, F.lit(" count="), F.col("replicas"))),
        check(F.when(F.col("pruning_enabled"), "PRUNING_ENABLED").otherwise("PRUNING_DISABLED"),
              "INFO", "PASS",
              F.concat(F.lit("threshold="),
                       F.coalesce(F.col("pruning_threshold_angstrom").cast("string"), F.lit("null")))),
        outcome("files", "INPUT_FILES_OK", "INPUT_FILES_MISSING"),
        F.when(present, outcome("topology", "TOPOLOGY_INCLUDES_OK", "TOPOLOGY_INCLUDE_ERROR")),
        F.when(present, outcome("index", "INDEX_GROUPS_OK", "INDEX_GROUP_ERROR")),
        F.when(present, outcome("settings", "MDP_SEMANTICS_OK", "MDP_SEMANTICS_ERROR")),
        F.when(present, estimate),
    )
    return (
        poses.join(counted, "system", "left")
        .select("system", F.explode(F.array_compact(checks)).alias("c"))
        .select("system", "c.*")
    )


def preflight_summary(checks: DataFrame) -> DataFrame:
    """Exit code per pose: 3 for a failed input check, else 4 for the environment, else 0."""
    failed = F.col("status") == "FAIL"
    # Codes of environment checks.
    environment = F.col("code").rlike("^(GROMACS|GPU)_")
    folded = checks.groupBy("system").agg(
        F.bool_or(failed & ~environment).alias("input_failed"),
        F.bool_or(failed & environment).alias("environment_failed"),
        F.count_if(failed).alias("n_failed"),
    )
    code = F.when(F.col("input_failed"), 3).when(F.col("environment_failed"), 4).otherwise(0)
    return folded.select(
        "system",
        "n_failed",
        code.alias("exit_code"),
        F.when(code == 0, "PASS").otherwise("FAIL").alias("overall_status"),
    )
