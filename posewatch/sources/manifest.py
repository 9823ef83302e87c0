"""Pose manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from posewatch.schemas import POSE_MANIFEST


def read_pose_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON-lines manifests, one pose per line.

    ``pose_no`` is not in the file: numbering needs a total order and is taken from
    pose_id or from a column of the caller. ``unknown_fields`` lists keys outside
    the schema, at the top and in the overrides; ``has_*`` flags tell a present
    null from an absent key.
    """
    return parse_pose_manifest(spark.read.text(path))


def parse_pose_manifest(lines: DataFrame) -> DataFrame:
    """As ``read_pose_manifest`` for a table with the entry texts in ``value``.

    Other columns are kept.
    """
    kept = [c for c in lines.columns if c != "value"]
    entry = F.from_json("value", StructType.fromDDL(POSE_MANIFEST), {"mode": "FAILFAST"})
    return (
        lines.filter(F.trim("value") != "")
        .select(*kept, entry.alias("e"), manifest_presence(F.col("value")).alias("presence"))
        .select(*kept, "e.*", "presence.*")
    )


def manifest_presence(raw_json: Column) -> Column:
    """Which override keys an entry text holds, whatever their value."""

    def keys(path: str) -> Column:
        value = F.get_json_object(raw_json, path)
        return F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))

    top = keys("$")
    overrides = keys("$.overrides")
    trajectory = keys("$.overrides.trajectory")
    pruning = keys("$.overrides.pruning")
    # Allowed keys of a manifest entry.
    allowed = {
        "": (top, ["pose_id", "prepared_system_dir", "start_structure", "topology", "index",
                   "ligand_resname", "overrides"]),
        "overrides.": (overrides, ["trajectory", "pruning"]),
        "overrides.trajectory.": (trajectory, ["replicas", "base_seed", "seeds"]),
        "overrides.pruning.": (pruning, ["enabled", "threshold_angstrom", "grace_period_seconds"]),
    }
    def unlisted(prefix: str, found: Column, names: list[str]) -> Column:
        extra = F.array_except(found, F.array(*map(F.lit, names)))
        return F.transform(extra, lambda key: F.concat(F.lit(prefix), key))

    unknown = F.concat(*[unlisted(prefix, *pair) for prefix, pair in allowed.items()])
    flags = [
        F.array_contains(found, name).alias(f"has_{name}")
        for found, names in ((trajectory, allowed["overrides.trajectory."][1]),
                             (pruning, allowed["overrides.pruning."][1]))
        for name in names
    ]
    return F.struct(unknown.alias("unknown_fields"), *flags)


def manifest_documents(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole manifest documents (manifest, text): their entries and what is wrong with the root.

    A document is an object of ``schema_version`` 1 and a list ``poses`` with at least one
    entry. Returns (manifest, pose_no, value) with the entry texts for
    ``parse_pose_manifest``, and (manifest, reason).
    """
    root = F.from_json("text", "schema_version string, poses array<string>", {"mode": "PERMISSIVE"})
    keys = F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>"))
    version = F.get_json_object("text", "$.schema_version")
    read = texts.select("manifest", "text", root.alias("r"), keys.alias("keys"), version.alias("version"))
    # Keys and version of the document.
    extra = F.array_except("keys", F.array(F.lit("schema_version"), F.lit("poses")))
    reasons = F.array_compact(
        F.array(
            F.when(F.try_parse_json("text").isNull() | ~F.ltrim("text").startswith("{"), "not an object"),
            F.when(F.col("version").isNull() | (F.col("version") != "1"), "schema_version is not 1"),
            F.when(F.col("r.poses").isNull() | (F.size("r.poses") < 1), "no poses"),
            F.when(F.size(extra) > 0, F.concat(F.lit("unknown field "), F.array_join(extra, ", "))),
        )
    )
    entries = read.select("manifest", F.posexplode("r.poses").alias("pose_no", "value"))
    return entries, read.select("manifest", F.explode(reasons).alias("reason"))
