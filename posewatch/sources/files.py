"""File inventories, checksum lists and provenance documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posewatch.functions.identity import digest_valid, safe_relative_path

BINARY_CELL_LIMIT = 2**31 - 1
BLOCK = 1 << 20


def inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, sha256) of a tree, relative to its root.

    A file that does not fit a binary cell is read by its task in blocks, so its
    digest needs no more memory than that of a small one.
    """
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", pattern
    ).load(root)
    prefix = "^.*?" + _quoted(root.rstrip("/")) + "/"
    small = base.filter(F.col("length") <= BINARY_CELL_LIMIT).select(
        "path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")
    )
    # The scan packs files by size, so each large one is a partition of its own.
    large = (
        base.filter(F.col("length") > BINARY_CELL_LIMIT)
        .select("path", "length")
        .mapInArrow(_block_digests(BLOCK), "path string, size_bytes long, sha256 string")
    )
    return small.unionByName(large).withColumn("path", F.regexp_replace("path", prefix, ""))


def _block_digests(block: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            digests = []
            for uri in batch.column(0).to_pylist():
                if uri.startswith("file:"):
                    store, name = LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
                else:
                    store, name = FileSystem.from_uri(quote(uri, safe=":/"))
                digest = hashlib.sha256()
                with store.open_input_stream(name) as stream:
                    while data := stream.read(block):
                        digest.update(data)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.string())],
                ["path", "size_bytes", "sha256"],
            )

    return batches


def _quoted(value: str) -> str:
    return r"\Q" + value + r"\E"


def checksum_lines(lines: DataFrame) -> DataFrame:
    """(sha256, path, reason) of ``<digest>  <path>`` lines; blank lines are skipped."""
    split = F.split("line", "  ", 2)
    digest = F.get(split, F.lit(0))
    path = F.get(split, F.lit(1))
    return lines.filter(F.col("line") != "").select(
        *[c for c in lines.columns if c != "line"],
        digest.alias("sha256"),
        path.alias("path"),
        F.when(path.isNull(), "malformed_line")
        .when(~digest_valid(digest), "invalid_digest")
        .when(~safe_relative_path(path), "unsafe_path")
        .alias("reason"),
    )


def checksum_line(digest: Column, path: Column) -> Column:
    return F.concat(digest, F.lit("  "), path)


def artifact_manifest(files: DataFrame) -> DataFrame:
    """Files that belong into an artifact manifest, in path order.

    The manifest files themselves stay out.
    """
    name = F.element_at(F.split("path", "/"), -1)
    # Names of the manifest files.
    own = name.isin("artifact_manifest.csv", "checksums.sha256") | name.endswith("_artifacts.json")
    return files.filter(~own).orderBy("path")


def read_transformations(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, destination, digests) of provenance documents."""
    schema = (
        "transformations array<struct<destination:string,original_numeric_sha256:string,"
        "cleaned_numeric_sha256:string>>"
    )
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .json(path)
        .select(F.posexplode("transformations").alias("ordinal", "t"))
        .select("ordinal", "t.*")
    )
