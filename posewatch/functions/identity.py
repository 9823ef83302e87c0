"""Identifiers, keys, digests and relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from posewatch.functions.text import SPACE

# Identifier formats.
RESNAME = r"^[A-Za-z0-9_+-]{1,16}\z"
DIGEST = r"^[0-9a-f]{64}\z"
CONTROL = r"[\x00-\x1f]"
UNSAFE_RUN = r"[^A-Za-z0-9_.-]+"
SLUG_LENGTH = 40
# What the slug is made of: past leading dots, dashes and unsafe characters, a run of those is one.
SLUG_SOURCE = rf"^[^A-Za-z0-9_]*+((?:[A-Za-z0-9_.-]|[^A-Za-z0-9_.-]++){{0,{SLUG_LENGTH}}})"


def pose_id_valid(pose_id: Column) -> Column:
    edge_space = pose_id.rlike(rf"^{SPACE}|{SPACE}\z")
    return (F.length(pose_id) > 0) & ~edge_space & ~pose_id.rlike(CONTROL)


def resname_valid(resname: Column) -> Column:
    return resname.rlike(RESNAME)


def digest_valid(digest: Column) -> Column:
    return digest.rlike(DIGEST)


def safe_relative_path(path: Column) -> Column:
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def pose_key(pose_id: Column) -> Column:
    """Readable slug plus the SHA-256 of the raw ID; distinct IDs keep distinct keys."""
    # Characters beyond the slug change nothing: cutting strips the end anyway.
    slug = F.regexp_replace(F.regexp_extract(pose_id, SLUG_SOURCE, 1), UNSAFE_RUN, "-")
    slug = F.regexp_replace(slug, r"[-.]+\z", "")
    slug = F.regexp_replace(slug, r"^\z", "pose")
    return F.concat(slug, F.lit("--"), F.sha2(pose_id.cast("binary"), 256))


def safe_label(value: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(value, UNSAFE_RUN, "-"), r"^-+|-+\z", "")
    return F.regexp_replace(cleaned, r"^\z", "run")  # a condition would work it out twice


def replica_id(number: Column) -> Column:
    return F.format_string("replica_%02d", number)


def task_id(pose_id: Column, replica: Column) -> Column:
    return F.concat_ws(":", pose_id, replica)


def external_identifier(path: Column) -> Column:
    """Path from the first force-field folder on, else the bare file name."""
    inside = F.regexp_extract(path, r"(?:^|/)([^/]*\.ff(?:/.*)?)$", 1)
    return F.when(inside != "", inside).otherwise(F.element_at(F.split(path, "/"), -1))


def file_suffix(path: Column) -> Column:
    """Lower-case last suffix with its dot, empty when the name has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))
