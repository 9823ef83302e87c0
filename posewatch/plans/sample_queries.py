"""Scores, pruning and observation over ``events`` read as RMSD samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from posewatch.functions import text
from posewatch.functions.staging import staged
from posewatch.functions.units import convert_rmsd
from posewatch.operators import prefix, pruning, score
from posewatch.plans import standins as s
from posewatch.plans.registry import query
from posewatch.session import materialise, scratch_dir
from posewatch.sources import growing, series
from posewatch.sources import lines as line_source
from posewatch.streaming import monitor

SCORES_SQL = """
maxima AS (SELECT run_id, pose_id, replica_id, max(rmsd_nm) AS m FROM samples GROUP BY ALL),
found AS (SELECT run_id, pose_id, count(*) AS n, max(m) * 10 AS observed FROM maxima GROUP BY ALL),
scores AS (
  SELECT p.run_id, p.pose_id,
    CASE WHEN p.pruned THEN 'PRUNED'
         WHEN coalesce(n, 0) = p.n_replicas_requested THEN 'COMPLETED' ELSE 'INCOMPLETE' END AS status,
    CAST(p.n_replicas_requested AS BIGINT) AS n_replicas_requested,
    coalesce(n, 0) AS n_replicas_completed,
    CASE WHEN NOT p.pruned AND n = p.n_replicas_requested THEN observed END AS md_score_angstrom,
    observed AS observed_max_rmsd_angstrom,
    CASE WHEN coalesce(n, 0) > p.n_replicas_requested
         THEN 'completed replica count exceeds requested replica count' END AS violation
  FROM sample_poses p LEFT JOIN found f ON p.run_id = f.run_id AND p.pose_id = f.pose_id)"""
BASE = [s.SAMPLES_SQL, s.SAMPLE_POSES_SQL]
CROSSED_SQL = """crossed AS (
  SELECT x.run_id, x.pose_id, x.replica_id, x.time_ps, x.rmsd_nm * 10 AS rmsd_angstrom
  FROM samples x JOIN sample_poses p ON x.run_id = p.run_id AND x.pose_id = p.pose_id
  WHERE x.rmsd_nm * 10 > p.pruning_threshold_angstrom)"""


@query(
    "replica_maximum",
    s.with_ctes(
        BASE,
        """SELECT run_id, pose_id, replica_id,
             concat(pose_id, '/', replica_id, '.xvg') AS source,
             arg_min(time_ps, {'a': -rmsd_nm, 'b': time_ps}) AS time_ps,
             max(rmsd_nm) AS max_rmsd_nm, max(rmsd_nm) * 10 AS max_rmsd_angstrom
           FROM samples GROUP BY run_id, pose_id, replica_id""",
    ),
)
def replica_maximum(spark, sf):
    file = F.concat("pose_id", F.lit("/"), "replica_id", F.lit(".xvg"))
    return score.replica_maxima(s.samples(spark, sf).withColumn("source", file))


@query("md_score", s.with_ctes([*BASE, SCORES_SQL], "SELECT * FROM scores"))
def md_score(spark, sf):
    return score.pose_scores(s.samples(spark, sf), s.sample_poses(spark, sf))


@query(
    "pose_ranking",
    s.with_ctes(
        [*BASE, SCORES_SQL],
        """SELECT *, CASE WHEN md_score_angstrom IS NOT NULL THEN
             rank() OVER (PARTITION BY run_id ORDER BY md_score_angstrom NULLS LAST) END AS score_rank
           FROM scores""",
    ),
)
def pose_ranking(spark, sf):
    return score.rank_of(materialise(md_score(spark, sf), "scores"))


@query(
    "most_stable_poses",
    s.with_ctes(
        [*BASE, SCORES_SQL],
        """SELECT run_id, pose_id, md_score_angstrom FROM scores
           ORDER BY md_score_angstrom ASC NULLS LAST, run_id, pose_id LIMIT 20""",
    ),
)
def most_stable_poses(spark, sf):
    top = score.ranked(md_score(spark, sf), limit=20)
    return top.select("run_id", "pose_id", "md_score_angstrom")


@query(
    "score_documents",
    s.with_ctes(
        [*BASE, SCORES_SQL,
         """peaks AS (SELECT run_id, pose_id, replica_id,
              arg_min(time_ps, {'a': -rmsd_nm, 'b': time_ps}) AS time_ps, max(rmsd_nm) AS m
            FROM samples GROUP BY run_id, pose_id, replica_id)""",
         """listed AS (SELECT run_id, pose_id,
              string_agg(concat_ws('@', replica_id, CAST(round(m * 1e6) AS BIGINT),
                CAST(round(time_ps * 1e6) AS BIGINT)), ';' ORDER BY replica_id) AS maxima
            FROM peaks GROUP BY run_id, pose_id)"""],
        """SELECT c.run_id, c.pose_id, c.status, c.n_replicas_completed, l.maxima
           FROM scores c LEFT JOIN listed l ON c.run_id = l.run_id AND c.pose_id = l.pose_id""",
    ),
)
def score_documents(spark, sf):
    samples = s.samples(spark, sf)
    scores = score.pose_scores(samples, s.sample_poses(spark, sf))
    documents = score.score_documents(scores, score.replica_maxima(samples))
    parsed = F.from_json(
        "document",
        "status string, n_replicas_completed bigint, replica_maxima array<struct<"
        "replica_id:string,max_rmsd_nm:double,time_ps:double>>",
    )
    listed = F.array_join(
        F.transform(
            "d.replica_maxima",
            lambda m: F.concat_ws(
                "@",
                m["replica_id"],
                F.rint(m["max_rmsd_nm"] * 1e6).cast("bigint").cast("string"),
                F.rint(m["time_ps"] * 1e6).cast("bigint").cast("string"),
            ),
        ),
        ";",
    )
    return documents.withColumn("d", parsed).select(
        "run_id", "pose_id", "d.status", "d.n_replicas_completed", listed.alias("maxima")
    )


@query(
    "golden_check",
    s.with_ctes(
        [*BASE, SCORES_SQL,
         """expected AS (SELECT run_id, pose_id,
              max(value) / 100 + CASE WHEN min(event_id) % 2 = 0 THEN 0 ELSE 0.00001 END AS e
            FROM (SELECT *, concat('run_', user_id % 4) AS run_id, concat('pose_', user_id) AS pose_id
                  FROM events) GROUP BY run_id, pose_id)"""],
        """SELECT x.run_id, x.pose_id, round(e, 9) AS expected_md_score_angstrom, md_score_angstrom,
             coalesce(abs(md_score_angstrom - e) <= 0.000001, false) AS within_tolerance
           FROM expected x LEFT JOIN scores c ON x.run_id = c.run_id AND x.pose_id = c.pose_id""",
    ),
)
def golden_check(spark, sf):
    samples = s.samples(spark, sf)
    drift = F.when(F.min("event_id") % 2 == 0, 0.0).otherwise(0.00001)
    expected = (
        s.table(spark, sf, "events")
        .selectExpr(f"{s.SAMPLE['run_id']} AS run_id", f"{s.SAMPLE['pose_id']} AS pose_id",
                    "value", "event_id")
        .groupBy("run_id", "pose_id")
        .agg((F.max("value") / 100 + drift).alias("expected_md_score_angstrom"))
    )
    scores = score.pose_scores(samples, s.sample_poses(spark, sf))
    return score.golden_check(scores, expected).withColumn(
        "expected_md_score_angstrom", F.round("expected_md_score_angstrom", 9)
    )


@query(
    "unit_conversion",
    """SELECT event_id, CASE event_type WHEN 'view' THEN value WHEN 'click' THEN value * 10
         ELSE value / 10 END AS converted FROM events""",
)
def unit_conversion(spark, sf):
    nm = F.col("event_type").isin("view", "click")
    src = F.when(nm, "nm").otherwise("angstrom")
    dst = F.when(F.col("event_type") == "view", "nm").when(nm, "angstrom").otherwise("nm")
    return s.table(spark, sf, "events").select(
        "event_id", convert_rmsd(F.col("value"), src, dst).alias("converted")
    )


# Text lines made from every event; the kind of fault goes by event number.
LINE = (
    "CASE event_id % 12 WHEN 0 THEN '# comment' WHEN 1 THEN '@ title' WHEN 2 THEN '' "
    "WHEN 3 THEN concat(event_id, ' nan') WHEN 4 THEN concat(event_id, ' 1d') "
    "WHEN 5 THEN concat(event_id, ' 0.1 2') WHEN 6 THEN concat(event_id, ' -', 1 + event_id % 7) "
    "WHEN 7 THEN concat('  ', event_id, '   ', event_id % 100, '.5e-1 ') "
    "WHEN 8 THEN concat(event_id, ' 0x1p3') "
    "ELSE concat(event_id, ' 0.', event_id) END"
)


@query(
    "sample_quarantine",
    f"""WITH l AS (SELECT event_id, trim({LINE}) AS line FROM events),
        d AS (SELECT *, regexp_split_to_array(line, '\\s+') AS w FROM l
              WHERE line <> '' AND line[1] NOT IN ('#', '@')),
        r AS (SELECT event_id, CASE WHEN len(w) <> 2 THEN 'column_count'
                WHEN w[2] = 'nan' THEN 'non_finite'
                WHEN NOT regexp_full_match(w[2], '[+-]?[0-9]+(\\.[0-9]*)?([eE][+-]?[0-9]+)?') THEN 'non_numeric'
                WHEN w[2][1] = '-' THEN 'negative_rmsd' END AS reason FROM d)
        SELECT reason, count(*) AS n, min(event_id) AS first_line, max(event_id) AS last_line
        FROM r WHERE reason IS NOT NULL GROUP BY reason""",
)
def sample_quarantine(spark, sf):
    lines = s.table(spark, sf, "events").selectExpr("event_id", f"{LINE} AS line")
    stripped = lines.withColumn("line", text.strip(F.col("line"))).filter(
        ~text.is_comment(F.col("line"))
    )
    words = staged(stripped, ["event_id"], w=text.words(F.col("line")))
    valued = staged(
        words.select(
            "event_id",
            F.size("w").alias("n"),
            F.get("w", F.lit(0)).alias("a"),
            F.get("w", F.lit(1)).alias("b"),
        ),
        ["event_id", "n", "a", "b"],
        t=text.parse_float(F.col("a")),
        r=text.parse_float(F.col("b")),
    )
    reason = text.sample_reason(*map(F.col, ["n", "a", "b", "t", "r"]))
    return (
        valued.withColumn("reason", reason)
        .filter("reason IS NOT NULL")
        .groupBy("reason")
        .agg(
            F.count("*").alias("n"),
            F.min("event_id").alias("first_line"),
            F.max("event_id").alias("last_line"),
        )
    )


# Series texts: one file per embedding, its values as samples every 10 ps.
MICRO = "CAST(round({v} * 1000000) AS BIGINT)"


def series_files(spark, sf):
    """(path, content) of a series text per embedding; signs stay, so some lines are faulty."""
    micro = lambda v: F.round(v.cast("double") * 1000000).cast("bigint")
    line = lambda v, i: F.concat(
        (i * 10).cast("string"),
        F.when(micro(v) < 0, " -0.").otherwise(" 0."),
        F.lpad(F.abs(micro(v)).cast("string"), 6, "0"),
    )
    # Every third file has only its magnitudes and is a valid series.
    values = F.when(
        F.col("vec_id") % 3 == 0, F.transform("embedding", lambda v: F.abs(v))
    ).otherwise(F.col("embedding"))
    body = F.concat(
        F.lit('# comment\n@ title "RMSD"\n'), F.array_join(F.transform(values, line), "\n"), F.lit("\n")
    )
    return s.table(spark, sf, "embeddings").select(
        F.concat(F.lit("series/"), F.col("vec_id")).alias("path"), body.cast("binary").alias("content")
    )


SERIES_SQL = f"""points AS (
  SELECT vec_id, i, CASE WHEN vec_id % 3 = 0 THEN abs({MICRO.format(v='CAST(v AS DOUBLE)')})
    ELSE {MICRO.format(v='CAST(v AS DOUBLE)')} END AS micro
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings))"""


@query(
    "xvg_scan",
    s.with_ctes(
        [SERIES_SQL],
        """SELECT concat('series/', vec_id) AS path,
             CASE WHEN min(micro) < 0 THEN 'negative_rmsd' END AS file_reason,
             count(*) AS n_lines, count(*) FILTER (micro < 0) AS n_faults,
             min(i + 3) FILTER (micro < 0) AS first_fault_line,
             CAST(max(CASE WHEN micro >= 0 THEN micro END) AS BIGINT) AS max_rmsd_micro_nm,
             CAST(max(i * 10) AS DOUBLE) AS last_time_ps
           FROM points GROUP BY vec_id""",
    ),
)
def xvg_scan(spark, sf):
    scan = series.scan_series(series_files(spark, sf))
    faulty = F.col("reason").isNotNull()
    return scan.groupBy("path").agg(
        F.max("file_reason").alias("file_reason"),
        F.count("line_no").alias("n_lines"),
        F.count_if(faulty).alias("n_faults"),
        F.min(F.when(faulty, F.col("line_no").cast("bigint"))).alias("first_fault_line"),
        F.max(F.when(~faulty, F.rint(F.col("rmsd_nm") * 1e6))).cast("bigint").alias("max_rmsd_micro_nm"),
        F.max("time_ps").alias("last_time_ps"),
    )


@query(
    "series_scores",
    s.with_ctes(
        [SERIES_SQL,
         """good AS (SELECT vec_id, max(micro) AS m FROM points GROUP BY vec_id HAVING min(micro) >= 0)"""],
        """SELECT concat('pose_', label) AS pose_id, count(*) AS n_replicas_completed,
             CAST(max(m) AS BIGINT) AS observed_max_micro_nm
           FROM good JOIN embeddings USING (vec_id) GROUP BY label""",
    ),
)
def series_scores(spark, sf):
    """Files to scores in one job: parse, reject faulty files, fold."""
    labels = s.table(spark, sf, "embeddings").select(
        F.concat(F.lit("series/"), F.col("vec_id")).alias("path"), "label"
    )
    good = series.accepted(series.scan_series(series_files(spark, sf)))
    per_file = good.groupBy("path").agg(F.max("rmsd_nm").alias("rmsd_nm"))
    samples = per_file.join(labels, "path").select(
        F.lit("run").alias("run_id"),
        F.concat(F.lit("pose_"), F.col("label")).alias("pose_id"),
        F.col("path").alias("replica_id"),
        "rmsd_nm",
    )
    return score.observed_maxima(samples).select(
        "pose_id",
        "n_replicas_completed",
        F.rint(F.col("observed_max_rmsd_angstrom") * 1e5).cast("bigint").alias("observed_max_micro_nm"),
    )


@query(
    "numeric_digest",
    s.with_ctes(
        [SERIES_SQL],
        """SELECT concat('series/', vec_id) AS path, sha256(concat(string_agg(
             concat(i * 10, CASE WHEN micro < 0 THEN ' -0.' ELSE ' 0.' END, lpad(CAST(abs(micro) AS VARCHAR), 6, '0')),
             chr(10) ORDER BY i), chr(10))) AS numeric_sha256
           FROM points GROUP BY vec_id""",
    ),
)
def numeric_digest(spark, sf):
    return series_files(spark, sf).select(
        "path", series.numeric_digest(F.col("content").cast("string")).alias("numeric_sha256")
    )


@query(
    "strict_time_check",
    s.with_ctes(
        BASE,
        """SELECT run_id, pose_id, replica_id, event_id, time_ps, previous_time_ps FROM (
             SELECT *, lag(time_ps) OVER (PARTITION BY run_id, pose_id, replica_id
               ORDER BY event_id % 97 * 1000000000000 + event_id) AS previous_time_ps FROM samples)
           WHERE time_ps <= previous_time_ps""",
    ),
)
def strict_time_check(spark, sf):
    """Time order in a line order that is shuffled on purpose."""
    lines = s.samples(spark, sf).withColumn(
        "line_no", F.col("event_id") % 97 * 1000000000000 + F.col("event_id")
    )
    return pruning.time_order_faults(lines, score.REPLICA_KEY, "line_no").select(
        *score.REPLICA_KEY, "event_id", "time_ps", "previous_time_ps"
    )


@query(
    "running_maximum",
    s.with_ctes(
        BASE,
        """SELECT run_id, pose_id, replica_id, event_id, time_ps, rmsd_nm,
             max(rmsd_nm) OVER (PARTITION BY run_id, pose_id, replica_id ORDER BY time_ps
               ROWS UNBOUNDED PRECEDING) AS running_max_rmsd_nm FROM samples""",
    ),
)
def running_maximum(spark, sf):
    return pruning.running_maximum(s.samples(spark, sf)).select(
        *score.REPLICA_KEY, "event_id", "time_ps", "rmsd_nm", "running_max_rmsd_nm"
    )


@query(
    "first_crossing",
    s.with_ctes(
        [*BASE, CROSSED_SQL],
        """SELECT run_id, pose_id, replica_id, min(time_ps) AS time_ps,
             arg_min(rmsd_angstrom, time_ps) AS rmsd_angstrom
           FROM crossed GROUP BY run_id, pose_id, replica_id""",
    ),
)
def first_crossing(spark, sf):
    return pruning.first_crossing(
        pruning.crossings(s.samples(spark, sf), s.sample_poses(spark, sf))
    )


TRIGGER_SQL = """SELECT run_id, pose_id, min(time_ps) AS trigger_simulation_time_ps,
  arg_min(replica_id, {'a': time_ps, 'b': replica_id}) AS trigger_replica_id,
  arg_min(rmsd_angstrom, {'a': time_ps, 'b': replica_id}) AS trigger_observed_rmsd_angstrom,
  max(rmsd_angstrom) AS max_crossing_angstrom
FROM crossed GROUP BY run_id, pose_id"""


@query("canonical_trigger", s.with_ctes([*BASE, CROSSED_SQL], TRIGGER_SQL))
def canonical_trigger(spark, sf):
    return pruning.canonical_trigger(
        pruning.crossings(s.samples(spark, sf), s.sample_poses(spark, sf))
    )


OBSERVED_SQL = """SELECT r.run_id, r.pose_id, r.replica_id,
  count(DISTINCT x.time_ps) AS samples_observed, coalesce(max(x.time_ps), 0) AS latest_time_ps,
  max(x.rmsd_nm) AS maximum_rmsd_nm, max(x.rmsd_nm) * 10 AS maximum_rmsd_angstrom,
  coalesce(bool_or(x.rmsd_nm * 10 > p.pruning_threshold_angstrom), false) AS triggered_pruning
FROM sample_replicas r JOIN sample_poses p ON r.run_id = p.run_id AND r.pose_id = p.pose_id
LEFT JOIN samples x ON x.run_id = r.run_id AND x.pose_id = r.pose_id AND x.replica_id = r.replica_id
GROUP BY r.run_id, r.pose_id, r.replica_id"""


@query("observation_summary", s.with_ctes([*BASE, s.SAMPLE_REPLICAS_SQL], OBSERVED_SQL))
def observation_summary(spark, sf):
    return pruning.observation_summary(
        s.samples(spark, sf), s.sample_poses(spark, sf), s.sample_replicas(spark, sf)
    )


FAILURES_SQL = """WITH marked AS (SELECT user_id, event_id, event_type = 'error' AS failed,
    max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id
      ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_success FROM events)
  SELECT user_id, last_success, count(*) AS n_failures, min(event_id) AS first_failure,
    max(event_id) AS last_failure
  FROM marked WHERE failed GROUP BY user_id, last_success HAVING count(*) >= 3"""


@query("consecutive_failures", FAILURES_SQL)
def consecutive_failures(spark, sf):
    snapshots = s.table(spark, sf, "events").select(
        "user_id", "event_id", (F.col("event_type") == "error").alias("failed")
    )
    return pruning.consecutive_failures(snapshots, ["user_id"], "event_id", 3)


@query(
    "unobserved_samples",
    s.with_ctes(
        [*BASE,
         """observed AS (SELECT run_id, pose_id, replica_id, max(time_ps) AS latest FROM samples
              WHERE event_id % 10 < 6 GROUP BY ALL)"""],
        """SELECT x.run_id, x.pose_id, x.replica_id, x.event_id, x.time_ps, x.rmsd_nm
           FROM samples x LEFT JOIN observed o ON x.run_id = o.run_id AND x.pose_id = o.pose_id
             AND x.replica_id = o.replica_id
           WHERE o.latest IS NULL OR x.time_ps > o.latest""",
    ),
)
def unobserved_samples(spark, sf):
    samples = s.samples(spark, sf)
    seen = samples.filter(F.col("event_id") % 10 < 6).groupBy(*score.REPLICA_KEY).agg(
        F.max("time_ps").alias("latest_time_ps")
    )
    return pruning.unobserved_samples(samples, seen).select(
        *score.REPLICA_KEY, "event_id", "time_ps", "rmsd_nm"
    )


@query(
    "pruning_preconditions",
    s.with_ctes(
        BASE,
        """SELECT run_id, pose_id, NULL AS replica_id, 'threshold_not_positive' AS reason
             FROM sample_poses WHERE pruning_threshold_angstrom - 2.25 + (length(pose_id) - 6) <= 0
           UNION ALL
           SELECT run_id, pose_id, replica_id, 'negative_rmsd' FROM samples WHERE rmsd_nm - 0.0005 < 0""",
    ),
)
def pruning_preconditions(spark, sf):
    """Thresholds and values shifted down so that some break the preconditions."""
    shifted = s.samples(spark, sf).withColumn("rmsd_nm", F.col("rmsd_nm") - 0.0005)
    limits = s.sample_poses(spark, sf).withColumn(
        "pruning_threshold_angstrom",
        F.col("pruning_threshold_angstrom") - 2.25 + (F.length("pose_id") - 6),
    )
    return pruning.precondition_violations(shifted, limits)


@query(
    "event_sequence",
    """SELECT user_id % 4 AS run_no, event_id,
         row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS sequence FROM events""",
)
def event_sequence(spark, sf):
    events = s.table(spark, sf, "events").select(
        (F.col("user_id") % 4).alias("run_no"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        "event_id",
    )
    return prefix.scan(events, ["run_no"], ["ts_us", "event_id"], "number", "sequence").drop("ts_us")


@query(
    "angstrom_series",
    s.with_ctes(
        BASE,
        """SELECT pose_id, replica_id, count(*) AS n, min(time_ps) AS first_time_ps,
             max(rmsd_nm * 10) AS max_angstrom FROM samples GROUP BY pose_id, replica_id""",
    ),
)
def angstrom_series(spark, sf):
    """The Å series of every replica, written below its folder and read back."""
    path = scratch_dir(spark, "angstrom-series")
    series.write_angstrom_series(s.samples(spark, sf), path, buckets=16)
    back = series.read_angstrom_series(spark, path)
    return back.groupBy("pose_id", "replica_id").agg(
        F.count("*").alias("n"),
        F.min("simulation_time_ps").alias("first_time_ps"),
        F.max("rmsd_angstrom").alias("max_angstrom"),
    )


# Lines of 16 series files, some with faults.
SERIES_LINE = {
    "g": "CAST(user_id % 16 AS INT)",
    "event_id": "event_id",
    "line": "CASE WHEN user_id % 16 = 1 AND event_id % 997 = 5 THEN 'x y' "
            "WHEN user_id % 16 = 2 AND event_id % 499 = 7 THEN '0 0.1' "
            "WHEN user_id % 16 = 3 AND event_id % 997 = 11 THEN '1 2 3' "
            "ELSE concat(event_id, ' ', value / 1000) END",
}
SERIES_LINES_SQL = [
    s.select_sql("numbered", SERIES_LINE, "events"),
    """parsed AS (SELECT g, event_id, string_split(line, ' ') AS w, TRY_CAST(string_split(line, ' ')[1] AS DOUBLE) AS t,
         TRY_CAST(string_split(line, ' ')[2] AS DOUBLE) AS r FROM numbered)""",
    """checked AS (SELECT *, CASE WHEN len(w) <> 2 THEN 'column_count' WHEN t IS NULL THEN 'non_numeric'
         WHEN t <= lag(t) OVER (PARTITION BY g ORDER BY event_id) THEN 'time_not_increasing' END AS reason FROM parsed)""",
]


def series_lines(spark, sf, path, some="true"):
    """One file per group below ``path``, lines in order of the events, led by a comment."""
    head = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("# note\n\n"), "line")).otherwise(F.col("line"))
    lines = s.table(spark, sf, "events").where(some).selectExpr(*s.exprs(SERIES_LINE)).withColumn("line", head)
    ordered = lines.repartition("g").sortWithinPartitions("g", "event_id").select("line", "g")
    ordered.write.mode("append").partitionBy("g").text(path)


def group_of(path):
    return F.regexp_extract(path, r"g=(\d+)", 1).cast("int").alias("g")


@query(
    "series_ranges",
    s.with_ctes(
        SERIES_LINES_SQL,
        """SELECT g, arg_min(reason, event_id) FILTER (reason IS NOT NULL) AS file_reason, count(reason) AS n_faults,
             CASE WHEN count(reason) = 0 THEN count(*) ELSE 0 END AS n_samples,
             CASE WHEN count(reason) = 0 THEN max(r) END AS max_rmsd_nm FROM checked GROUP BY g""",
    ),
)
def series_ranges(spark, sf):
    """Series files scanned in byte ranges: faults, verdicts and accepted samples."""
    path = scratch_dir(spark, "series-files")
    series_lines(spark, sf, path)
    found = line_source.scan(spark, path, "*.txt")
    faults = line_source.quarantine(found).groupBy(group_of(F.col("path"))).agg(F.count("line_no").alias("n_faults"))
    good = line_source.accepted(found).groupBy(group_of(F.col("path"))).agg(
        F.count("*").alias("n_samples"), F.max("rmsd_nm").alias("max_rmsd_nm")
    )
    files = found.files.select(group_of(F.col("path")), "file_reason")
    return files.join(faults, "g", "left").join(good, "g", "left").fillna(0, ["n_faults", "n_samples"])


@query(
    "stream_growing_series",
    s.with_ctes(
        SERIES_LINES_SQL,
        """SELECT g, count(*) AS n_lines, count(CASE WHEN len(w) <> 2 OR t IS NULL THEN 1 END) AS n_rejected, max(r) FILTER (len(w) = 2 AND t IS NOT NULL) AS max_rmsd_nm
           FROM checked GROUP BY g""",
    ),
)
def stream_growing_series(spark, sf):
    """Lines of a folder that grows between two runs of the same stream."""
    path, log = scratch_dir(spark, "growing"), scratch_dir(spark, "growing-log")
    for some in ("event_id % 2 = 0", "event_id % 2 = 1"):
        series_lines(spark, sf, path, some)
        lines = monitor.run_changelog(growing.appended_samples(spark, path, "*.txt"), "append", log)
    rejected = F.col("reason").isNotNull()
    return lines.groupBy(group_of(F.col("path"))).agg(
        F.count("*").alias("n_lines"), F.count_if(rejected).alias("n_rejected"),
        F.max(F.when(~rejected, F.col("rmsd_nm"))).alias("max_rmsd_nm"),
    )
