"""Index groups, includes, settings, preflight and integrity over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from posewatch.functions import identity
from posewatch.operators import integrity, prefix, prepared
from posewatch.plans import standins as s
from posewatch.plans.registry import query
from posewatch.sources import files as file_source
from posewatch.sources import prepared as prepared_source

# --- index groups from lineitem ------------------------------------------

GROUP = (
    "CASE l_linenumber WHEN 1 THEN 'C-alpha' WHEN 2 THEN 'LIG' WHEN 3 THEN 'Protein_LIG' "
    "WHEN 4 THEN 'Protein_LIG' WHEN 5 THEN 'Water_and_ions' ELSE 'Other' END"
)
INDEX = {
    "file": "l_orderkey",
    "group": GROUP,
    "group_ord": "CASE WHEN l_linenumber = 4 THEN 3 ELSE l_linenumber END",
    "pos": "l_linenumber",
    "atom": "CASE WHEN l_quantity > 45 THEN NULL ELSE l_partkey % 7 + 1 END",
}
INDEX_DUCK = {('"group"' if k == "group" else k): v for k, v in INDEX.items()}
INDEX_SQL = [
    s.select_sql("idx", INDEX_DUCK, "lineitem"),
    """sizes AS (SELECT file, "group", count(DISTINCT group_ord) AS n_groups, count(atom) AS n_atoms
         FROM idx GROUP BY ALL)""",
    """req AS (SELECT unnest(['C-alpha', 'LIG', 'Protein_LIG', 'Water_and_ions']) AS g)""",
]


def index_atoms(spark, sf):
    return s.table(spark, sf, "lineitem").select(*[F.expr(e).alias(n) for n, e in INDEX.items()])


@query(
    "index_validation",
    s.with_ctes(
        INDEX_SQL,
        """SELECT f.file, g AS "group", CASE WHEN coalesce(n_groups, 0) <> 1
               THEN concat('exists ', coalesce(n_groups, 0), ' times') ELSE 'empty' END AS reason
             FROM (SELECT DISTINCT file FROM idx) f CROSS JOIN req
             LEFT JOIN sizes z ON z.file = f.file AND z."group" = g
             WHERE coalesce(n_groups, 0) <> 1 OR n_atoms = 0
           UNION ALL SELECT DISTINCT file, "group", 'repeated atoms' FROM
             (SELECT file, "group", atom FROM idx WHERE "group" <> 'Other' AND atom IS NOT NULL
              GROUP BY ALL HAVING count(*) > 1)
           UNION ALL SELECT DISTINCT file, "group", 'not a subset of Protein_LIG' FROM idx i
             WHERE "group" IN ('C-alpha', 'LIG') AND atom IS NOT NULL AND NOT EXISTS (
               SELECT 1 FROM idx c WHERE c.file = i.file AND c.atom = i.atom AND c."group" = 'Protein_LIG')""",
    ),
)
def index_validation(spark, sf):
    return prepared.index_violations(index_atoms(spark, sf))


@query("group_sizes", s.with_ctes(INDEX_SQL, "SELECT * FROM sizes"))
def group_sizes(spark, sf):
    return prepared.group_sizes(index_atoms(spark, sf))


# Index texts: one per embedding, four named groups of 16 values each as atom numbers.
# Some texts start with atoms, hold a word that is no number, or have no header.
GROUP_NAMES = ["C-alpha", "LIG", "Protein_LIG", "Water_and_ions"]


def index_texts(spark, sf):
    number = lambda v: F.abs(F.round(v.cast("double") * 1000)).cast("bigint").cast("string")
    k = F.col("vec_id") % 6
    blocks = []
    for i, name in enumerate(GROUP_NAMES):
        atoms = F.transform(F.slice("embedding", 16 * i + 1, 16), number)
        header = F.when(k == 3, "").otherwise(f"; group {i}\n [ {name} ] \n")
        rows = F.concat(
            F.array_join(F.slice(atoms, 1, 10), " "), F.lit("\r\n\n  "), F.array_join(F.slice(atoms, 11, 6), "\t")
        )
        blocks += [header, rows, F.lit("\n")]
    head = F.when(k == 1, "7 8\n").when(k == 2, "[  ]\n 5 x1\n").otherwise("\n")
    return s.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("path"), F.concat(head, *blocks).alias("text")
    )


@query(
    "index_scan",
    """WITH p AS (SELECT vec_id, vec_id % 6 AS k, CAST((i - i % 16) / 16 AS INT) AS g,
           CAST(abs(round(CAST(v AS DOUBLE) * 1000)) AS BIGINT) AS atom
         FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)),
       r AS (
         SELECT vec_id, CASE WHEN k = 3 THEN 0 WHEN k = 1 THEN g + 2 WHEN k = 2 THEN g + 2 ELSE g + 1 END AS n0,
           k, g, atom, CASE WHEN k = 3 THEN 'atoms_before_header' WHEN atom < 1 THEN 'not_positive' END AS reason FROM p
         UNION ALL SELECT vec_id, 0, vec_id % 6, NULL, unnest([7, 8]), 'atoms_before_header' FROM embeddings WHERE vec_id % 6 = 1
         UNION ALL SELECT vec_id, 1, vec_id % 6, NULL, 5, NULL FROM embeddings WHERE vec_id % 6 = 2
         UNION ALL SELECT vec_id, 1, vec_id % 6, NULL, NULL, 'non_integer' FROM embeddings WHERE vec_id % 6 = 2
         UNION ALL SELECT vec_id, 1, vec_id % 6, NULL, NULL, 'empty_group_name' FROM embeddings WHERE vec_id % 6 = 2
         UNION ALL SELECT vec_id, 0, vec_id % 6, NULL, NULL, 'no_groups' FROM embeddings WHERE vec_id % 6 = 3)
       SELECT vec_id AS path, CASE WHEN g IS NULL OR k = 3 THEN CASE WHEN k = 2 THEN '' END
           ELSE ['C-alpha', 'LIG', 'Protein_LIG', 'Water_and_ions'][g + 1] END AS "group",
         count(atom) AS n_atoms, count(reason) AS n_faults, CAST(sum(atom) AS BIGINT) AS atom_sum
       FROM r GROUP BY ALL""",
)
def index_scan(spark, sf):
    scan = prepared_source.scan_index(index_texts(spark, sf))
    return scan.groupBy("path", "group").agg(
        F.count("atom").alias("n_atoms"), F.count("reason").alias("n_faults"), F.sum("atom").alias("atom_sum")
    )


COMPLEX_SQL = """cmplx AS (SELECT file, atom, row_number() OVER (PARTITION BY file ORDER BY atom) AS position
  FROM (SELECT DISTINCT l_suppkey AS file, l_partkey AS atom FROM lineitem WHERE l_linenumber <> 7))"""


@query(
    "index_remap",
    s.with_ctes(
        [COMPLEX_SQL],
        """SELECT l_suppkey AS file, l_orderkey AS pos, l_linenumber AS line, l_partkey AS atom, position,
             CASE WHEN position IS NULL THEN 'atom outside the complex' END AS reason
           FROM lineitem LEFT JOIN cmplx c ON c.file = l_suppkey AND c.atom = l_partkey
           WHERE l_returnflag = 'A'""",
    ),
)
def index_remap(spark, sf):
    """Atoms of one return flag renumbered by their place among all parts of the supplier."""
    lines = s.table(spark, sf, "lineitem")
    members = lines.filter("l_linenumber <> 7").select(
        F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("atom")
    ).distinct()
    positions = prefix.scan(members, ["file"], ["atom"], "number", "position")
    generated = lines.filter("l_returnflag = 'A'").select(
        F.col("l_suppkey").alias("file"),
        F.col("l_orderkey").alias("pos"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("atom"),
    )
    return prepared.remap_atoms(generated, positions)


@query(
    "group_sequence_check",
    """WITH g AS (SELECT l_orderkey AS file, l_linenumber AS pos, min(l_partkey) AS a,
          CASE WHEN max(l_suppkey) % 5 = 0 THEN NULL ELSE max(l_partkey) END AS b FROM lineitem GROUP BY ALL)
       SELECT file, pos, a AS left_atom, b AS right_atom FROM g WHERE a IS DISTINCT FROM b""",
)
def group_sequence_check(spark, sf):
    lines = s.table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("pos")
    )
    left = lines.agg(F.min("l_partkey").alias("atom"))
    right = lines.agg(F.max("l_partkey").alias("atom"), F.max("l_suppkey").alias("k")).filter(
        "k % 5 <> 0"
    )
    return prepared.sequence_differences(left, right)


# --- includes over parts -------------------------------------------------

# Part p is a file; it includes the part p/2, so part 0 includes itself. Every fifth part lives outside the
# prepared root, every thirteenth does not exist.
FILE_PATH = (
    "CASE WHEN {k} % 5 = 0 THEN concat('/ext', {k} % 2, '/f', {k}, '.itp') "
    "ELSE concat('/prep/d', {k} % 3, '/f', {k}, '.itp') END"
)
HALF = "CAST((p_partkey - p_partkey % 2) / 2 AS BIGINT)"
INCLUDE_NAME = (
    f"CASE WHEN {HALF} % 5 = 0 THEN concat('f', {HALF}, '.itp') "
    f"WHEN {HALF} % 2 = 0 THEN concat('d', {HALF} % 3, '/f', {HALF}, '.itp') "
    f"ELSE concat('../d', {HALF} % 3, '/./f', {HALF}, '.itp') END"
)
EDGES_SQL = [
    f"""files AS (SELECT {FILE_PATH.format(k='p_partkey')} AS path FROM part WHERE p_partkey % 13 <> 1)""",
    f"""raw AS (SELECT p_partkey, {HALF} AS h, {FILE_PATH.format(k='p_partkey')} AS path,
          {INCLUDE_NAME} AS include FROM part)""",
    # The candidate folders hold a file of that name only in these cases.
    """edges AS (SELECT path, include, CASE
          WHEN h % 13 = 1 THEN NULL
          WHEN h % 5 = 0 THEN concat('/ext', h % 2, '/f', h, '.itp')
          WHEN h % 2 = 0 THEN concat('/prep/d', h % 3, '/f', h, '.itp')
          WHEN p_partkey % 5 <> 0 THEN concat('/prep/d', h % 3, '/f', h, '.itp')
          ELSE NULL END AS target, h FROM raw)""",
]


def include_texts(spark, sf):
    body = F.concat(
        F.lit("; topology\n#include \""), F.expr(INCLUDE_NAME), F.lit("\"\n; #include \"none.itp\"\n[ end ]\n")
    )
    return s.spread(s.table(spark, sf, "part"), "p_partkey").select(
        F.expr(FILE_PATH.format(k="p_partkey")).alias("path"), body.alias("text")
    )


def include_edges(spark, sf):
    catalogue = s.table(spark, sf, "part").filter("p_partkey % 13 <> 1").select(
        F.expr(FILE_PATH.format(k="p_partkey")).alias("path")
    )
    edges = prepared_source.scan_includes(include_texts(spark, sf))
    return prepared.resolve_includes(edges, catalogue, "/prep", ["/ext0", "/ext1"])


@query(
    "include_resolution",
    s.with_ctes(
        EDGES_SQL,
        """SELECT path, include, target, target LIKE '/prep/%' AS is_local,
             CASE WHEN target IS NULL THEN 'unresolved include' END AS reason FROM edges""",
    ),
)
def include_resolution(spark, sf):
    return include_edges(spark, sf)


@query(
    "include_closure",
    "WITH RECURSIVE " + ",\n".join(EDGES_SQL) + """,
      reach AS (SELECT path AS system, path, 0 AS depth FROM (SELECT DISTINCT path FROM edges)
        UNION ALL SELECT r.system, e.target, r.depth + 1 FROM reach r JOIN edges e ON r.path = e.path
          WHERE e.target IS NOT NULL AND r.depth < 60)
      SELECT system, path, min(depth) AS depth FROM reach GROUP BY system, path""",
)
def include_closure(spark, sf):
    edges = include_edges(spark, sf).filter("target IS NOT NULL")
    roots = include_texts(spark, sf).select(F.col("path").alias("system"), "path")
    return prepared.include_closure(roots, edges)


# --- settings over parts -------------------------------------------------

SETTINGS_TEXT = """CASE {stage} WHEN 'nvt' THEN concat('; {stage}\nIntegrator = ', CASE WHEN p_partkey % 17 = 0 THEN 'sd' ELSE 'MD' END,
'\ndt = 0.002 ; ps\nnsteps=', p_size * 1000, '\ngen_vel = yes\n')
WHEN 'npt' THEN concat('integrator = md\ndt = ', CASE WHEN p_partkey % 19 = 0 THEN '1d' ELSE '0.002' END,
'\nnsteps = 50000\ngen-vel = ', CASE WHEN p_partkey % 23 = 0 THEN 'yes' ELSE 'no' END, '\n')
ELSE concat('integrator = md\ndt = ', CASE WHEN p_partkey % 29 = 0 THEN '0.003' ELSE '0.002' END,
'\nnsteps = 2500000\ngen_vel = no\nnstxout-compressed = ', CASE WHEN p_partkey % 31 = 0 THEN '4000' ELSE '5000' END,
CASE WHEN p_partkey % 37 = 0 THEN '\nDT = 0.002\n' ELSE '\n' END) END"""


def settings(spark, sf):
    """(system, stage, key, value) parsed from one text per part and stage."""
    stages = s.spread(s.table(spark, sf, "part"), "p_partkey").select(
        "*", F.explode(F.array(*map(F.lit, ["nvt", "npt", "production"]))).alias("stage")
    )
    texts = stages.selectExpr(
        "p_partkey AS system",
        "stage",
        SETTINGS_TEXT.replace("CASE {stage}", "CASE stage").replace("; {stage}", "; text") + " AS text",
    )
    # The rows stay dealt by system, so sums by system shuffle nothing.
    return prepared_source.scan_settings(texts).filter("reason IS NULL").select("system", "stage", "key", "value")


def systems(spark, sf):
    return s.table(spark, sf, "part").selectExpr(
        "p_partkey AS system",
        "CAST(10 AS DOUBLE) AS output_interval_ps",
        "CASE WHEN p_partkey % 41 = 0 THEN CAST(0.0000005 AS DOUBLE) ELSE CAST(5 AS DOUBLE) END AS production_time_ns",
    )


SETTING_FAULTS_SQL = """faults AS (
  SELECT p_partkey AS system, 'nvt' AS stage, 'integrator must be md' AS reason FROM part WHERE p_partkey % 17 = 0
  UNION ALL SELECT p_partkey, 'npt', 'dt must be a numeric value' FROM part WHERE p_partkey % 19 = 0
  UNION ALL SELECT p_partkey, 'npt', 'gen-vel must be no' FROM part WHERE p_partkey % 23 = 0
  UNION ALL SELECT p_partkey, 'production', 'output interval must be a multiple of dt' FROM part
    WHERE p_partkey % 29 = 0
  UNION ALL SELECT p_partkey, 'production', 'production time must be a whole step count' FROM part
    WHERE p_partkey % 29 = 0 OR p_partkey % 41 = 0
  UNION ALL SELECT p_partkey, 'production', 'compressed-output interval does not match' FROM part
    WHERE (p_partkey % 29 = 0) <> (p_partkey % 31 = 0) OR (p_partkey % 29 = 0 AND p_partkey % 31 = 0)
  UNION ALL SELECT p_partkey, 'production', 'duplicate key dt' FROM part WHERE p_partkey % 37 = 0)"""


@query(
    "settings_scan",
    """SELECT 3 * count(*) AS n_texts, count(*) * 13 + count(*) FILTER (p_partkey % 37 = 0) AS n_settings,
         sum(p_size * 1000) AS nvt_steps FROM part""",
)
def settings_scan(spark, sf):
    rows = settings(spark, sf)
    per_text = rows.groupBy("system", "stage").agg(
        F.count("*").alias("n"),
        F.max(F.when((F.col("stage") == "nvt") & (F.col("key") == "nsteps"), F.col("value"))).alias("v"),
    )
    return per_text.agg(
        F.count("*").alias("n_texts"), F.sum("n").alias("n_settings"),
        F.sum(F.col("v").cast("bigint")).alias("nvt_steps"),
    )


@query("settings_validation", s.with_ctes([SETTING_FAULTS_SQL], "SELECT * FROM faults"))
def settings_validation(spark, sf):
    return prepared.settings_violations(settings(spark, sf), systems(spark, sf))


@query(
    "settings_override",
    """WITH r AS (SELECT p_partkey AS system, unnest(range(2)) AS i, p_partkey, p_size FROM part)
       SELECT system, concat('replica_0', i + 1) AS replica_id, stage, key, value FROM r, LATERAL (VALUES
         ('nvt', 'gen-vel', 'yes'), ('nvt', 'gen-seed', CAST(p_partkey * 10 + i AS VARCHAR)),
         ('nvt', 'integrator', CASE WHEN p_partkey % 17 = 0 THEN 'sd' ELSE 'MD' END), ('nvt', 'dt', '0.002'),
         ('nvt', 'nsteps', CAST(p_size * 1000 AS VARCHAR)),
         ('npt', 'gen-vel', 'no'), ('npt', 'integrator', 'md'),
         ('npt', 'dt', CASE WHEN p_partkey % 19 = 0 THEN '1d' ELSE '0.002' END), ('npt', 'nsteps', '50000'),
         ('production', 'gen-vel', 'no'), ('production', 'nsteps', '2500000'),
         ('production', 'nstxout-compressed', '5000'), ('production', 'integrator', 'md'),
         ('production', 'dt', CASE WHEN p_partkey % 29 = 0 THEN '0.003' ELSE '0.002' END)) v(stage, key, value)
       UNION ALL SELECT system, concat('replica_0', i + 1), 'production', 'dt', '0.002' FROM r WHERE p_partkey % 37 = 0""",
)
def settings_override(spark, sf):
    replicas = s.table(spark, sf, "part").select(
        F.col("p_partkey").alias("system"), F.posexplode(F.sequence(F.lit(0), F.lit(1))).alias("i", "x")
    ).select(
        "system",
        identity.replica_id(F.col("i") + 1).alias("replica_id"),
        (F.col("system") * 10 + F.col("i")).alias("velocity_seed"),
        F.lit(2500000).alias("production_steps"),
        F.lit(5000).alias("interval_steps"),
    )
    return prepared.resolved_settings(settings(spark, sf), replicas)


# --- preflight over customers --------------------------------------------

PREFLIGHT = {
    "system": "c_custkey",
    "replicas": "CAST(c_nationkey % 5 + 1 AS INT)",
    "seeds": "CAST(NULL AS ARRAY<BIGINT>)",
    "base_seed": "CASE WHEN c_custkey % 2 = 0 THEN c_custkey END",
    "pruning_enabled": "c_custkey % 3 = 0",
    "pruning_threshold_angstrom": "CASE WHEN c_custkey % 3 = 0 THEN CAST(4.5 AS DOUBLE) END",
    "atoms": "CASE WHEN c_custkey % 47 <> 0 THEN c_custkey * 10 END",
    "production_time_ns": "CAST(5 AS DOUBLE)",
    "output_interval_ps": "CAST(7 AS DOUBLE)",
}
FAULT_SQL = [
    """raised AS (SELECT c_custkey AS system, 'files' AS area, 'missing' AS reason FROM customer WHERE c_custkey % 11 = 0
       UNION ALL SELECT c_custkey, 'topology', 'unresolved include' FROM customer WHERE c_custkey % 13 = 0
       UNION ALL SELECT c_custkey, 'index', 'empty' FROM customer WHERE c_custkey % 17 = 0
       UNION ALL SELECT c_custkey, 'index', 'repeated atoms' FROM customer WHERE c_custkey % 34 = 0
       UNION ALL SELECT c_custkey, 'settings', 'dt must be a numeric value' FROM customer WHERE c_custkey % 19 = 0)""",
    """areas AS (SELECT * FROM (VALUES ('files', 'INPUT_FILES_OK', 'INPUT_FILES_MISSING'),
         ('topology', 'TOPOLOGY_INCLUDES_OK', 'TOPOLOGY_INCLUDE_ERROR'), ('index', 'INDEX_GROUPS_OK', 'INDEX_GROUP_ERROR'),
         ('settings', 'MDP_SEMANTICS_OK', 'MDP_SEMANTICS_ERROR')) v(area, good, bad))""",
    """counted AS (SELECT c.c_custkey AS system, a.area, a.good, a.bad, count(r.reason) AS n, min(r.reason) AS m
         FROM customer c CROSS JOIN areas a LEFT JOIN raised r ON r.system = c.c_custkey AND r.area = a.area
         GROUP BY ALL)""",
    """checks AS (
         SELECT c_custkey AS system, 'SEED_CONFIGURATION_VALID' AS code, 'INFO' AS severity, 'PASS' AS status,
           concat('mode=', CASE WHEN c_custkey % 2 = 0 THEN 'base_seed' ELSE 'resolve_and_persist_at_run_creation' END,
             ' count=', c_nationkey % 5 + 1) AS detail FROM customer
         UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'PRUNING_ENABLED' ELSE 'PRUNING_DISABLED' END,
           'INFO', 'PASS', CASE WHEN c_custkey % 3 = 0 THEN 'threshold=4.5' ELSE 'threshold=null' END FROM customer
         UNION ALL SELECT system, CASE WHEN n = 0 THEN good ELSE bad END, CASE WHEN n = 0 THEN 'INFO' ELSE 'ERROR' END,
           CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN n = 0 THEN '' ELSE concat(n, ' faults, first: ', m) END
           FROM counted WHERE area = 'files' OR system % 11 <> 0
         UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 47 = 0 THEN 'DISK_ESTIMATE_ERROR' ELSE 'DISK_ESTIMATE_OK' END,
           CASE WHEN c_custkey % 47 = 0 THEN 'ERROR' ELSE 'INFO' END, CASE WHEN c_custkey % 47 = 0 THEN 'FAIL' ELSE 'PASS' END,
           CASE WHEN c_custkey % 47 = 0 THEN 'no atom count' ELSE concat('estimated_bytes=',
             (c_custkey * 10 * (715 + 1) * 16 + c_custkey * 10 * 256 + 20971520) * (c_nationkey % 5 + 1)) END
           FROM customer WHERE c_custkey % 11 <> 0)""",
]


def preflight(spark, sf):
    customers = s.table(spark, sf, "customer")
    poses = customers.selectExpr(*s.exprs(PREFLIGHT))
    k = F.col("c_custkey")
    raised = F.array(
        *[
            F.when(k % n == 0, F.struct(F.lit(area).alias("area"), F.lit(reason).alias("reason")))
            for n, area, reason in [
                (11, "files", "missing"), (13, "topology", "unresolved include"), (17, "index", "empty"),
                (34, "index", "repeated atoms"), (19, "settings", "dt must be a numeric value"),
            ]
        ]
    )
    faults = customers.select(k.alias("system"), F.explode(F.array_compact(raised)).alias("f")).select(
        "system", "f.*"
    )
    return prepared.preflight_checks(poses, faults)


@query("preflight_report", s.with_ctes(FAULT_SQL, "SELECT * FROM checks"))
def preflight_report(spark, sf):
    return preflight(spark, sf)


@query(
    "preflight_summary",
    s.with_ctes(
        FAULT_SQL,
        """SELECT system, count(*) FILTER (status = 'FAIL') AS n_failed,
             CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 3 ELSE 0 END AS exit_code,
             CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS overall_status
           FROM checks GROUP BY system""",
    ),
)
def preflight_summary(spark, sf):
    return prepared.preflight_summary(preflight(spark, sf))


@query(
    "missing_paths",
    f"""WITH r AS (SELECT p_partkey AS system, {FILE_PATH.format(k='p_partkey')} AS path FROM part)
        SELECT system, concat('..', path) AS path, 'outside the root' AS reason FROM r WHERE system % 5 = 0
        UNION ALL SELECT system, substr(path, 7), 'missing' FROM r WHERE system % 5 <> 0 AND system % 13 = 1""",
)
def missing_paths(spark, sf):
    path = F.expr(FILE_PATH.format(k="p_partkey"))
    part = s.table(spark, sf, "part").select(F.col("p_partkey").alias("system"), path.alias("full"))
    required = part.select(
        "system",
        F.lit("/prep").alias("root"),
        F.when(F.col("full").startswith("/prep/"), F.expr("substr(full, 7)"))
        .otherwise(F.concat(F.lit(".."), F.col("full"))).alias("path"),
    )
    there = part.filter("system % 13 <> 1").select(F.col("full").alias("path"))
    return prepared.missing_paths(required, there)


@query(
    "structure_counts",
    """SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE CAST(p_size * 100 AS BIGINT) END AS n_atoms FROM part""",
)
def structure_counts(spark, sf):
    body = F.concat(
        F.col("p_name"), F.lit("\n  "),
        F.when(F.col("p_size") > 40, "many").otherwise((F.col("p_size") * 100).cast("string")),
        F.lit(" \nrest\n"),
    )
    return s.table(spark, sf, "part").select(
        "p_partkey", prepared_source.structure_atom_count(body).alias("n_atoms")
    )


# --- digests over documents ----------------------------------------------

CHANGED = "CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END"
PATH = "concat(source, '/', doc_id, '.txt')"


def inventory(spark, sf):
    """Documents as files; every ninth is absent and every seventh changed."""
    docs = s.table(spark, sf, "documents").filter("doc_id % 9 <> 0")
    body = F.expr(CHANGED)
    return docs.select(
        F.col("source").alias("run_id"),
        F.expr(PATH).alias("path"),
        F.octet_length(body).cast("bigint").alias("size_bytes"),
        F.sha2(body.cast("binary"), 256).alias("sha256"),
    )


@query(
    "digest_diff",
    f"""WITH e AS (SELECT source AS pose_id, doc_id AS identifier, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 1),
          a AS (SELECT source AS pose_id, doc_id AS identifier, sha256({CHANGED}) AS h FROM documents WHERE doc_id % 9 <> 0)
        SELECT coalesce(e.pose_id, a.pose_id) AS pose_id, coalesce(e.identifier, a.identifier) AS identifier,
          CASE WHEN a.h IS NULL THEN 'missing' WHEN e.h IS NULL THEN 'unexpected' ELSE 'changed' END AS change,
          e.h AS expected, a.h AS actual
        FROM e FULL JOIN a ON e.pose_id = a.pose_id AND e.identifier = a.identifier
        WHERE e.h IS DISTINCT FROM a.h""",
)
def digest_diff(spark, sf):
    docs = s.table(spark, sf, "documents").withColumnsRenamed({"source": "pose_id", "doc_id": "identifier"})
    doc = docs.withColumn("doc_id", F.col("identifier"))
    expected = doc.filter("doc_id % 5 <> 1").select(
        "pose_id", "identifier", F.sha2(F.col("text").cast("binary"), 256).alias("sha256")
    )
    actual = doc.filter("doc_id % 9 <> 0").select(
        "pose_id", "identifier", F.sha2(F.expr(CHANGED).cast("binary"), 256).alias("sha256")
    )
    return integrity.digest_diff(expected, actual, ["pose_id", "identifier"])


@query(
    "identifier_sets",
    """SELECT coalesce(a.u, b.u) AS user_id, CASE WHEN b.u IS NULL THEN 'left_only' ELSE 'right_only' END AS side
       FROM (SELECT DISTINCT user_id AS u FROM events WHERE event_type = 'error') a
       FULL JOIN (SELECT DISTINCT c_custkey AS u FROM customer) b ON a.u = b.u
       WHERE a.u IS NULL OR b.u IS NULL""",
)
def identifier_sets(spark, sf):
    users = s.table(spark, sf, "events").filter("event_type = 'error'").select("user_id")
    customers = s.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return integrity.set_difference(users, customers, "user_id")


DEST = (
    "CASE WHEN doc_id % 50 = 3 THEN '<EXTERNAL_GROMACS_DATA>' WHEN doc_id % 41 = 4 THEN concat('../', doc_id) "
    f"WHEN doc_id % 100 = 6 THEN 'twice' ELSE {PATH} END"
)
KIND = "CASE WHEN doc_id % 50 = 3 AND doc_id % 4 = 1 THEN 'other' WHEN doc_id % 50 = 3 THEN 'external_topology_dependency' ELSE 'frozen_local_input' END"


@query(
    "input_manifest_check",
    f"""WITH m AS (SELECT doc_id, source AS run_id, {DEST} AS destination, {KIND} AS kind,
            CASE WHEN doc_id % 60 = 9 THEN upper(sha256(text)) ELSE sha256(text) END AS sha256 FROM documents),
          inv AS (SELECT source AS run_id, {PATH} AS path, sha256({CHANGED}) AS h FROM documents WHERE doc_id % 9 <> 0)
        SELECT m.doc_id, CASE WHEN NOT regexp_full_match(m.sha256, '[0-9a-f]{{64}}') THEN 'invalid SHA-256'
            WHEN destination = '<EXTERNAL_GROMACS_DATA>' AND kind <> 'external_topology_dependency' THEN 'invalid external kind'
            WHEN destination = '<EXTERNAL_GROMACS_DATA>' THEN NULL
            WHEN count(*) OVER (PARTITION BY m.run_id, destination) > 1 THEN 'duplicate destination'
            WHEN destination LIKE '../%' THEN 'unsafe destination' WHEN inv.h IS NULL THEN 'missing'
            WHEN inv.h <> m.sha256 THEN 'changed' END AS reason
        FROM m LEFT JOIN inv ON inv.run_id = m.run_id AND inv.path = m.destination""",
)
def input_manifest_check(spark, sf):
    digest = F.sha2(F.col("text").cast("binary"), 256)
    manifest = s.table(spark, sf, "documents").select(
        "doc_id",
        F.col("source").alias("run_id"),
        F.lit("pose").alias("pose_id"),
        F.col("source"),
        F.expr(DEST).alias("destination"),
        F.expr(KIND).alias("kind"),
        F.when(F.col("doc_id") % 60 == 9, F.upper(digest)).otherwise(digest).alias("sha256"),
    )
    return integrity.verify_input_manifest(manifest, inventory(spark, sf)).select("doc_id", "reason")


@query(
    "artifact_check",
    f"""SELECT doc_id, CASE WHEN doc_id % 41 = 4 THEN 'unsafe path' WHEN doc_id % 9 = 0 THEN 'missing'
          WHEN doc_id % 7 = 0 THEN 'size changed' WHEN doc_id % 11 = 0 THEN 'checksum changed' END AS reason
        FROM documents""",
)
def artifact_check(spark, sf):
    digest = F.sha2(F.col("text").cast("binary"), 256)
    artifacts = s.table(spark, sf, "documents").select(
        "doc_id",
        F.col("source").alias("run_id"),
        F.when(F.col("doc_id") % 41 == 4, F.concat(F.lit("/"), F.col("doc_id")))
        .otherwise(F.expr(PATH)).alias("artifact_path"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.when(F.col("doc_id") % 11 == 0, F.reverse(digest)).otherwise(digest).alias("sha256"),
    )
    return integrity.verify_artifacts(artifacts, inventory(spark, sf)).select("doc_id", "reason")


CHECK_LINE = (
    "CASE WHEN doc_id % 30 = 1 THEN '' WHEN doc_id % 30 = 2 THEN 'broken' "
    "WHEN doc_id % 30 = 3 THEN concat('abc  ', source) "
    "WHEN doc_id % 30 = 4 THEN concat({sha}, '  a/../b') "
    f"ELSE concat({{sha}}, '  ', {PATH}) END"
)


@query(
    "checksum_verify",
    f"""WITH l AS (SELECT doc_id, source, {CHECK_LINE.format(sha='sha256(text)')} AS line FROM documents)
        SELECT CASE WHEN doc_id % 30 = 2 THEN NULL WHEN doc_id % 30 = 3 THEN source WHEN doc_id % 30 = 4 THEN 'a/../b'
            ELSE {PATH} END AS path,
          CASE WHEN doc_id % 30 = 2 THEN 'malformed_line' WHEN doc_id % 30 = 3 THEN 'invalid_digest'
            WHEN doc_id % 30 = 4 THEN 'unsafe_path' WHEN doc_id % 9 = 0 THEN 'missing' ELSE 'mismatch' END AS failure
        FROM l WHERE line <> '' AND (doc_id % 30 IN (2, 3, 4) OR doc_id % 9 = 0 OR doc_id % 7 = 0)""",
)
def checksum_verify(spark, sf):
    lines = s.table(spark, sf, "documents").select(
        F.expr(CHECK_LINE.format(sha="sha2(CAST(text AS BINARY), 256)")).alias("line")
    )
    return integrity.verify_checksums(
        file_source.checksum_lines(lines), inventory(spark, sf)
    ).select("path", "failure")


@query(
    "artifact_manifest",
    f"""SELECT {PATH} AS path, octet_length(encode(text)) AS size_bytes,
          concat(sha256(text), '  ', {PATH}) AS line FROM documents""",
)
def artifact_manifest(spark, sf):
    files = s.table(spark, sf, "documents").select(
        F.expr(PATH).alias("path"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
    )
    own = files.select(
        F.concat("path", F.lit("_artifacts.json")).alias("path"), "size_bytes", "sha256"
    )
    return file_source.artifact_manifest(files.unionByName(own)).select(
        "path", "size_bytes", file_source.checksum_line(F.col("sha256"), F.col("path")).alias("line")
    )


@query(
    "provenance_check",
    """WITH last AS (SELECT label AS dest, max(vec_id) AS v FROM embeddings WHERE label <> 3 GROUP BY label)
       SELECT e.vec_id, CASE WHEN e.label = 3 THEN 'missing entry'
         WHEN md5(CAST(e.vec_id % 4 AS VARCHAR)) <> md5(CAST(v % 4 AS VARCHAR)) THEN 'numeric provenance mismatch'
         WHEN v % 2 = 1 THEN 'cleaned checksum mismatch' END AS failure
       FROM embeddings e LEFT JOIN last ON dest = e.label""",
)
def provenance_check(spark, sf):
    vectors = s.table(spark, sf, "embeddings").select(
        "vec_id",
        F.col("label").cast("string").alias("destination"),
        F.md5((F.col("vec_id") % 4).cast("string").cast("binary")).alias("numeric_sha256"),
    )
    entries = vectors.filter("destination <> '3'").select(
        F.col("vec_id").alias("ordinal"),
        "destination",
        F.col("numeric_sha256").alias("original_numeric_sha256"),
        F.when(F.col("vec_id") % 2 == 1, "other").otherwise(F.col("numeric_sha256")).alias("cleaned_numeric_sha256"),
    )
    return integrity.provenance_check(vectors, entries).select("vec_id", "failure")


STAGE = "CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN 'nvt' WHEN 1 THEN 'npt' ELSE 'production' END"


@query(
    "stage_reuse",
    s.with_ctes(
        [s.LINE_SQL],
        f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN 'absent'
              WHEN l_orderkey % 31 = 1 THEN 'corrupt' WHEN pk % 10 = 3 THEN 'mismatch'
              WHEN sk % 6 = 0 OR (sk % 6 = 1 AND {STAGE} = 'production') THEN 'incomplete'
              ELSE 'reusable' END AS decision FROM line""",
    ),
)
def stage_reuse(spark, sf):
    lines = s.lines(spark, sf)
    key = ["l_orderkey", "l_linenumber"]
    expected = lines.select(*key, F.expr(STAGE).alias("stage"), F.col("pk").alias("velocity_seed"))
    markers = lines.filter("l_orderkey % 5 <> 0").select(
        *key,
        F.expr(STAGE).alias("stage"),
        F.when(F.col("pk") % 10 == 3, None).otherwise(F.col("pk")).alias("velocity_seed"),
        (F.col("l_orderkey") % 31 == 1).alias("corrupt"),
    )
    suffixes = F.array(*map(F.lit, [".tpr", ".gro", ".cpt", ".log", ".xtc"]))
    size = F.when((F.col("suffix") == ".gro") & (F.col("sk") % 6 == 0), 0).when(
        (F.col("suffix") == ".xtc") & (F.col("sk") % 6 == 1), 0
    ).otherwise(1)
    outputs = lines.select(*key, "sk", F.explode(suffixes).alias("suffix")).withColumn("size_bytes", size)
    return integrity.stage_reuse(expected, markers, outputs, key, ["stage", "velocity_seed"]).select(
        *key, "decision"
    )


@query(
    "required_members",
    """SELECT path, reason FROM (VALUES
         ('http://none/', CASE WHEN (SELECT count(*) FROM pages WHERE url = 'http://none/') = 0 THEN 'missing' END),
         ('.html', CASE WHEN (SELECT count(*) FROM pages WHERE url LIKE '%.html') = 0 THEN 'missing' END),
         ('.absent', CASE WHEN (SELECT count(*) FROM pages WHERE url LIKE '%.absent') = 0 THEN 'missing' END),
         ((SELECT min(url) FROM pages), CASE WHEN (SELECT bool_or(contains(html, 'no such marker')) FROM pages
            WHERE url = (SELECT min(url) FROM pages)) THEN NULL ELSE 'marker missing' END)) v(path, reason)
       WHERE reason IS NOT NULL""",
)
def required_members(spark, sf):
    pages = s.table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("html").alias("text"))
    first = pages.agg(F.min("path")).first()[0]
    return integrity.required_members(
        pages, {"http://none/": None, first: "no such marker"}, [".html", ".absent"]
    )


@query("file_inventory")
def file_inventory(spark, sf):
    """Digest and size of every given table file; its SQL would need the file paths."""
    return file_source.inventory(spark, sf, "*.parquet")
