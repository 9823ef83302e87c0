"""Frames read from ``embeddings``: 22 points of three values, the last value twice more."""

from __future__ import annotations

from pyspark.sql import functions as F

from posewatch.operators import geometry
from posewatch.plans import standins as s
from posewatch.plans.registry import query
from posewatch.sources.frames import atoms_long

BOX = 0.15
COMPLEX = list(range(1, 23))
LIGAND = [15, 16, 17, 18, 19, 20, 21, 22]
FIT = [1, 3, 5, 7, 9, 11]
HEAVY = [16, 18, 20, 22]


def frames(spark, sf):
    points = F.transform(
        F.sequence(F.lit(0), F.lit(21)),
        lambda a: F.transform(
            F.sequence(F.lit(0), F.lit(2)),
            lambda k: F.get(F.col("embedding"), F.least(a * 3 + k, F.lit(63))).cast("double"),
        ),
    )
    return s.table(spark, sf, "embeddings").select(
        F.concat(F.lit("t"), F.col("label")).alias("trajectory_id"),
        F.col("vec_id").alias("frame_no"),
        (F.col("vec_id") * 10).cast("double").alias("time_ps"),
        F.lit(BOX).alias("box_nm"),
        points.alias("xyz"),
    )


FRAMES_SQL = [
    """long AS (SELECT concat('t', label) AS trajectory_id, vec_id AS frame_no,
         CAST((i - i % 3) / 3 AS INT) + 1 AS atom, i % 3 AS axis, v FROM (
           SELECT label, vec_id, unnest(embedding || [embedding[64], embedding[64]])::DOUBLE AS v, unnest(range(66)) AS i FROM embeddings))""",
]
SHIFT_SQL = f"""shifted AS (SELECT frame_no, axis, round_even((avg(v) FILTER (atom <= 14) - avg(v) FILTER (atom > 14)) / {BOX}, 0)
  * {BOX} AS shift FROM long GROUP BY frame_no, axis)"""


@query(
    "image_shift",
    s.with_ctes(
        [*FRAMES_SQL, SHIFT_SQL],
        """SELECT l.trajectory_id, l.frame_no, l.atom,
             round(max(v + CASE WHEN l.atom > 14 THEN shift ELSE 0 END) FILTER (l.axis = 0), 9) + 0 AS x,
             round(max(v + CASE WHEN l.atom > 14 THEN shift ELSE 0 END) FILTER (l.axis = 1), 9) + 0 AS y,
             round(max(v + CASE WHEN l.atom > 14 THEN shift ELSE 0 END) FILTER (l.axis = 2), 9) + 0 AS z
           FROM long l JOIN shifted s ON l.frame_no = s.frame_no AND l.axis = s.axis GROUP BY ALL""",
    ),
)
def image_shift(spark, sf):
    moved = atoms_long(geometry.image_shift(frames(spark, sf), COMPLEX, LIGAND))
    return moved.select(
        "trajectory_id", "frame_no", "atom",
        *[(F.round(c, 9) + 0).alias(c) for c in ("x", "y", "z")],
    )


@query(
    "time_slice",
    """SELECT concat('t', label) AS trajectory_id, count(*) AS n_frames, min(vec_id * 10)::DOUBLE AS first_ps,
         max(vec_id * 10)::DOUBLE AS last_ps FROM embeddings WHERE vec_id * 10 BETWEEN 500 AND 4000 GROUP BY label""",
)
def time_slice(spark, sf):
    return geometry.time_slice(frames(spark, sf), 500.0, 4000.0).groupBy("trajectory_id").agg(
        F.count("*").alias("n_frames"),
        F.min("time_ps").alias("first_ps"),
        F.max("time_ps").alias("last_ps"),
    )


REFERENCE_SQL = [
    *FRAMES_SQL,
    "firsts AS (SELECT trajectory_id, min(frame_no) AS frame_no FROM long GROUP BY trajectory_id)",
    """ref AS (SELECT l.trajectory_id, l.atom, l.axis, l.v FROM long l JOIN firsts f
         ON l.trajectory_id = f.trajectory_id AND l.frame_no = f.frame_no)""",
    f"""moves AS (SELECT l.frame_no, l.axis, avg(r.v) - avg(l.v) AS t FROM long l JOIN ref r
         ON l.trajectory_id = r.trajectory_id AND l.atom = r.atom AND l.axis = r.axis
         WHERE l.atom IN {tuple(FIT)} GROUP BY l.frame_no, l.axis)""",
    f"""rmsd AS (SELECT l.trajectory_id, l.frame_no, sqrt(sum((l.v + t - r.v) ** 2) / {len(HEAVY)}) AS v
         FROM long l JOIN ref r ON l.trajectory_id = r.trajectory_id AND l.atom = r.atom AND l.axis = r.axis
         JOIN moves m ON m.frame_no = l.frame_no AND m.axis = l.axis
         WHERE l.atom IN {tuple(HEAVY)} GROUP BY l.trajectory_id, l.frame_no)""",
]


def referenced(spark, sf):
    rows = frames(spark, sf)
    return geometry.with_reference(rows, geometry.reference_frames(rows))


@query(
    "rmsd_translation",
    s.with_ctes(
        REFERENCE_SQL,
        "SELECT trajectory_id, frame_no, round(v, 9) AS rmsd_nm FROM rmsd",
    ),
)
def rmsd_translation(spark, sf):
    return geometry.rmsd_translation(referenced(spark, sf), FIT, HEAVY).select(
        "trajectory_id", "frame_no", F.round("rmsd_nm", 9).alias("rmsd_nm")
    )


@query("rmsd_rot_trans")
def rmsd_rot_trans(spark, sf):
    return geometry.rmsd_rotation_translation(referenced(spark, sf), FIT, HEAVY).select(
        "trajectory_id", "frame_no", F.round("rmsd_nm", 9).alias("rmsd_nm")
    )


@query(
    "heavy_atoms",
    """SELECT l_orderkey AS file, l_partkey AS atom, l_linenumber, l_suppkey, l_quantity AS mass_da FROM lineitem
       WHERE l_returnflag = 'A' AND l_quantity > 2.5 AND EXISTS (
         SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_type = 'PROMO')""",
)
def heavy_atoms(spark, sf):
    """Line items as atoms; promoted parts of an order are its ligand group."""
    atoms = s.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("atom"), "l_linenumber", "l_suppkey",
        F.col("l_quantity").alias("mass_da"), F.col("l_returnflag").alias("resname"),
    )
    promo = s.table(spark, sf, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("atom"))
    ligand = atoms.join(promo, "atom", "left_semi").select("file", "atom")
    return geometry.heavy_atoms(atoms, ligand, "A").drop("resname")
