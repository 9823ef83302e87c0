"""Queries of this subpackage and their checking SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posewatch.llm import (
    alignment, bpe, decontaminate, divergence, jaccard_join, licenses, packing, quality, relative_lz, secret_scan,
    suffix_array, suffix_tree, tables, warc,
)
from posewatch.session import materialise

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    out = bpe.encode(docs, public_tokenizers.path(TOKENIZER))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text(), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(tables.read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.archive(tables.read(spark, sf_dir, "pages"))
    return warc.read(archives, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failed_rules",
    )


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(tables.read(spark, sf_dir, "documents"))


def removed(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_removed")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_array.deduplicate(tables.read(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_bytes", removed("spans"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = relative_lz.deduplicate(tables.read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", removed("spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard_join.link(tables.read(spark, sf_dir, "documents"))
    return linked.withColumnRenamed("component", "component_id")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    # The table has no paths: a document is a file below source, language and id block.
    block = F.floor(F.col("doc_id") / 1000).cast("string")
    path = F.concat_ws("/", "source", "lang", block, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs, licenses.templates(spark), "doc_id", path)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(tables.read(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(tables.read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER))
    # Only the digest of the ids is wanted here, so the ids need not be written and shuffled.
    digest = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = packing.place(materialise(digest, "packing-pieces"))
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER)
    found = alignment.group(tables.read(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    digested = materialise(found.withColumn("groups_sha256", digest).drop("groups"), "alignment")
    return alignment.count_links(digested)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_licenses": op2_licenses,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_suffix_array": op4_suffix_array,
    "op6_decontaminate": op6_decontaminate,
    "op5_secrets": op5_secrets,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_relative_lz": op9_relative_lz,
    "op10_jaccard": op10_jaccard,
    "op11_divergence": op11_divergence,
    "op12_packing": op12_packing,
    "op13_alignment": op13_alignment,
}
# Checking SQL where SQL can express the result; the others are tested against plain
# versions in tests/llm.
CHECKS: dict[str, str] = {
    "op6_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
        spans AS (SELECT DISTINCT n FROM bw),
        dw AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, spans)),
        h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.x = bw.x AND dw.n = bw.n),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY 1)
        SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
    """.replace("\\\\", "\\"),
    "op7_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest
            FROM pages),
        t AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM t
    """,
    "op11_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        o AS (SELECT k, lang, source, t, count(*) AS n FROM (SELECT k, lang, source, unnest(w) AS t FROM d) GROUP BY ALL),
        kept AS (SELECT lang, t, sum(n) AS ln FROM o GROUP BY ALL HAVING count(*) >= 30),
        c AS (SELECT lang, source, t, sum(n) AS n FROM o SEMI JOIN kept USING (lang, t) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*) AS v, sum(ln) AS ln FROM kept GROUP BY ALL),
        gn AS (SELECT lang, source, coalesce(sum(n), 0) AS gn FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (
            SELECT lang, source, t, coalesce(n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)::HUGEINT) // (gn + 5 * v)::HUGEINT AS p,
                   1 + (1000000000::HUGEINT * (kept.ln + 5)::HUGEINT) // (v.ln + 5 * v)::HUGEINT AS q
            FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, t)),
        r AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                   (SELECT coalesce(sum(abs(x.p - y.p)), 0) FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t
                    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            UNION ALL
            SELECT lang, source, 'term', t, p - q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
        WHERE part = 'pair' OR rank <= 50
    """,
}
