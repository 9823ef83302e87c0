"""Five stages that turn raw documents into token sequences for training.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's `docs`. All but the last keep the columns of
`documents`. Rows are looked at by themselves: a null id is kept or dropped by its text,
and an empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posewatch import session
from posewatch.llm import bpe, decontaminate, jaccard_join, quality, secret_scan, tables


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go. A label counts for one row of its document."""
    keyed = session.materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    named = keyed.groupBy("doc_id").agg(F.min("_row").alias("_row"))
    labels = named.join(tables.read(spark, sf_dir, "labels"), "doc_id").select(F.col("_row").alias("doc_id"), "quality")
    judged = quality.judge(keyed, labels, id_col="_row")
    return keyed.join(judged.where(~F.col("kept")).select("_row"), "_row", "left_anti").drop("_row")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that link, directly or not, the one with the smallest id stays."""
    return jaccard_join.keep_first(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.clean(docs, tables.read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind; `n_chars` is the new length."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the decoded text."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_distinct),
    ("benchmark decontamination", keep_uncontaminated),
    ("secret scans", redact_secrets),
    ("BPE encoding", encode),
]

# Components and tokens are beyond SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = session.materialise(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
