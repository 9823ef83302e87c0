"""Digests of inputs and artifacts compared with what was recorded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posewatch.functions.identity import digest_valid, safe_relative_path
from posewatch.schemas import EXTERNAL_DESTINATION


def digest_diff(expected: DataFrame, actual: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are missing, unexpected, changed or given twice.

    Both sides are stacked and folded by key, which pre-aggregates before the
    shuffle and needs no full outer join.
    """
    stacked = expected.select(
        *key, F.col("sha256").alias("e"), F.lit(None).cast("string").alias("a")
    ).unionByName(
        actual.select(*key, F.lit(None).cast("string").alias("e"), F.col("sha256").alias("a"))
    )
    change = (
        F.when(F.col("n_actual") > 1, "duplicate")
        .when(F.col("n_actual") == 0, "missing")
        .when(F.col("n_expected") == 0, "unexpected")
        .when(F.col("actual") != F.col("expected"), "changed")
    )
    return (
        stacked.groupBy(*key)
        .agg(
            F.max("e").alias("expected"),
            F.max("a").alias("actual"),
            F.count("e").alias("n_expected"),
            F.count("a").alias("n_actual"),
        )
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select(*key, "change", "expected", "actual")
    )


def set_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Identifiers on one side only; no row means the sets are equal."""
    sides = a.select(column, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        b.select(column, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return (
        sides.groupBy(column)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
        .filter(F.col("l") != F.col("r"))
        .select(column, F.when(F.col("l") == 1, "left_only").otherwise("right_only").alias("side"))
    )


def _lookup(rows: DataFrame, inventory: DataFrame, key: Sequence[str], path: str) -> DataFrame:
    found = inventory.select(
        *key,
        F.col("path").alias(path),
        F.col("sha256").alias("__sha"),
        F.col("size_bytes").alias("__size"),
        F.lit(True).alias("__there"),
    )
    return rows.join(found, [*key, path], "left")


def _repeats(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("__n")).filter("__n > 1")


def verify_input_manifest(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Reason per manifest entry, null when the frozen input is intact.

    The first rule that fails gives the reason, in the order of the checks.
    """
    external = F.col("destination") == EXTERNAL_DESTINATION
    repeats = _repeats(manifest.filter(~external), ["run_id", "destination"])
    fields = ["pose_id", "source", "destination", "kind", "sha256"]
    absent = F.lit(False)
    for name in fields:
        absent = absent | F.col(name).isNull()
    reason = (
        F.when(absent, "invalid fields")
        .when(~digest_valid(F.col("sha256")), "invalid SHA-256")
        .when(external & (F.col("kind") != "external_topology_dependency"), "invalid external kind")
        .when(external, F.lit(None).cast("string"))
        .when(F.col("__n").isNotNull(), "duplicate destination")
        .when(~safe_relative_path(F.col("destination")), "unsafe destination")
        .when(F.col("__there").isNull(), "missing")
        .when(~F.col("__sha").eqNullSafe(F.col("sha256")), "changed")
    )
    return (
        _lookup(manifest.join(repeats, ["run_id", "destination"], "left"), inventory, ["run_id"], "destination")
        .withColumn("reason", reason)
        .select(*manifest.columns, "reason")
    )


def verify_artifacts(artifacts: DataFrame, inventory: DataFrame) -> DataFrame:
    """Reason per registered artifact: path, then size, then digest."""
    key = ["run_id", "artifact_path"]
    reason = (
        F.when(F.col("__n").isNotNull(), "duplicate")
        .when(~safe_relative_path(F.col("artifact_path")), "unsafe path")
        .when(F.col("__there").isNull(), "missing")
        .when(F.col("__size") != F.col("size_bytes"), "size changed")
        .when(~F.col("__sha").eqNullSafe(F.col("sha256")), "checksum changed")
    )
    return (
        _lookup(artifacts.join(_repeats(artifacts, key), key, "left"), inventory, ["run_id"], "artifact_path")
        .withColumn("reason", reason)
        .select(*artifacts.columns, "reason")
    )


def verify_checksums(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Listed files that are missing or whose content changed.

    ``lines`` comes from the checksum scan; lines with a fault keep their reason.
    """
    status = F.coalesce(
        F.col("reason"),
        F.when(F.col("__there").isNull(), "missing").when(
            ~F.col("__sha").eqNullSafe(F.col("sha256")), "mismatch"
        ),
    )
    return (
        _lookup(lines, inventory, [], "path")
        .withColumn("failure", status)
        .filter(F.col("failure").isNotNull())
        .select("path", "sha256", "failure")
    )


def provenance_check(series: DataFrame, transformations: DataFrame) -> DataFrame:
    """Series files without a provenance entry or with another numeric digest.

    The last entry of a destination counts.
    """
    last = (
        transformations.groupBy("destination")
        .agg(
            F.max_by(
                F.struct("original_numeric_sha256", "cleaned_numeric_sha256"), "ordinal"
            ).alias("t")
        )
    )
    digest = F.col("numeric_sha256")
    failure = (
        F.when(F.col("t").isNull(), "missing entry")
        .when(~digest.eqNullSafe(F.col("t.original_numeric_sha256")), "numeric provenance mismatch")
        .when(~digest.eqNullSafe(F.col("t.cleaned_numeric_sha256")), "cleaned checksum mismatch")
    )
    return (
        series.join(last, "destination", "left")
        .withColumn("failure", failure)
        .select(*series.columns, "failure")
    )


def stage_reuse(
    expected: DataFrame, markers: DataFrame, outputs: DataFrame, key: Sequence[str],
    identity: Sequence[str],
) -> DataFrame:
    """Whether a finished stage can be reused.

    ``expected`` and ``markers`` have the key and identity columns, ``outputs`` has
    the key, suffix and size of each output file. A production stage has one more
    output than the others.
    """
    # Output files of a stage.
    suffixes = [".tpr", ".gro", ".cpt", ".log", ".xtc"]
    stored = markers.select(
        *key, F.struct(*identity).alias("m"), F.col("corrupt").alias("__corrupt")
    )
    files = (
        outputs.filter(F.col("suffix").isin(*suffixes) & (F.col("size_bytes") > 0))
        .groupBy(*key)
        .agg(
            *[F.bool_or(F.col("suffix") == s).alias(f"has{s.replace('.', '_')}") for s in suffixes]
        )
    )
    basic = F.lit(True)
    for s in suffixes[:-1]:
        basic = basic & F.coalesce(f"has{s.replace('.', '_')}", F.lit(False))
    complete = basic & (
        (F.col("stage") != "production") | F.coalesce("has_xtc", F.lit(False))
    )
    same = F.lit(True)
    for name in identity:
        same = same & F.col(name).eqNullSafe(F.col(f"m.{name}"))
    decision = (
        F.when(F.col("m").isNull(), "absent")
        .when(F.col("__corrupt"), "corrupt")
        .when(~same, "mismatch")
        .when(~complete, "incomplete")
        .otherwise("reusable")
    )
    return (
        expected.join(stored, list(key), "left")
        .join(files, list(key), "left")
        .select(*expected.columns, decision.alias("decision"))
    )


def required_members(
    files: DataFrame, required: dict[str, str | None], suffixes: Sequence[str] = ()
) -> DataFrame:
    """Required paths that are missing or lack their marker text; required endings not seen.

    The requirements are a short given list. Each becomes a flag folded over the
    files in one pass, so nothing is joined.
    """
    flags = []
    names = []
    for i, (path, marker) in enumerate(required.items()):
        here = F.col("path") == path
        flags.append(F.coalesce(F.bool_or(here), F.lit(False)).alias(f"there_{i}"))
        ok = here if marker is None else here & F.col("text").contains(marker)
        flags.append(F.coalesce(F.bool_or(ok), F.lit(False)).alias(f"marked_{i}"))
        names.append((path, f"there_{i}", f"marked_{i}"))
    for i, suffix in enumerate(suffixes):
        flags.append(
            F.coalesce(F.bool_or(F.col("path").endswith(suffix)), F.lit(False)).alias(f"ends_{i}")
        )
        names.append((suffix, f"ends_{i}", f"ends_{i}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("path"),
                F.when(~F.col(there), "missing").when(~F.col(marked), "marker missing").alias("reason"),
            )
            for name, there, marked in names
        ]
    )
    return (
        files.agg(*flags).select(F.explode(rows).alias("r")).select("r.*")
        .filter(F.col("reason").isNotNull())
    )
