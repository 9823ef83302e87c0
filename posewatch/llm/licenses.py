"""Licence scan of file trees, with DataFrame functions only.

Lines of files are compared with templates by the cosine of sparse TF-IDF vectors. A line
can only reach the threshold if it has one of the template's heavier words: words are left
out, lightest first, while their squared weights add up to less than the squared
threshold; a line without any of the rest stays below. Only lines with such a word become
vectors, and templates are joined by word.

A file's licence is that of its best line. A directory's licence is that of the licence
file in it, or else the one most of its own files declare. Files without a licence inherit
from their nearest ancestor directory: distinct directories are spread over their
ancestors and joined by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posewatch import session

THRESHOLD = 0.75
# Short notices by licence identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Proprietary", "All rights reserved."),
]
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def templates(spark: SparkSession) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template int, license string, text string")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+|[0-9]+"), F.lit(0))


def declared(files: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Best template of every file with a line of at least `threshold`.

    `files` has key and text, `known` template, license and text. Returns key, license,
    similarity and line number; of equal similarities the first line, then the first
    template counts.
    """
    posts = known.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy(
        "template", "license", "term").agg(F.count("*").alias("tf"))
    # In how many files each word occurs, template word or not; summed in the tasks first.
    seen = session.materialise(
        files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df")),
        "licence-words",
    )
    total = files.agg(F.count("text").alias("total"))
    idf = F.log((F.col("total") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weighed = session.materialise(
        posts.join(seen.join(F.broadcast(posts.select("term").distinct()), "term", "left_semi"), "term", "left")
        .crossJoin(F.broadcast(total))  # one row
        .select("template", "license", "term", idf.alias("idf"), (F.col("tf") * idf).alias("w")),
        "licence-templates",
    )
    norm = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weighed = weighed.join(F.broadcast(norm), "template")
    lighter = F.sum(F.pow(F.col("w") / F.col("norm"), F.lit(2.0))).over(
        Window.partitionBy("template").orderBy("w", "term")
    )
    cues = weighed.withColumn("upto", lighter).where(F.col("upto") >= threshold * threshold * 0.999999)
    lines = files.select("key", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    likely = (
        lines.select("key", "line", "words", F.explode(terms(F.col("words"))).alias("term"))
        .join(F.broadcast(cues.select("term").distinct()), "term", "left_semi")
        .select("key", "line", "words")
        .distinct()
    )
    counted = likely.select("key", "line", F.explode(terms(F.col("words"))).alias("term")).groupBy(
        "key", "line", "term").agg(F.count("*").alias("n"))
    # The large side is the lines' words; every one of them occurs in a file.
    vectors = counted.join(seen, "term").crossJoin(F.broadcast(total)).select(
        "key", "line", "term", (F.col("n") * idf).alias("x"))
    length = vectors.groupBy("key", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    dots = (
        vectors.join(F.broadcast(weighed.select("template", "license", "term", "w", "norm")), "term")
        .groupBy("key", "line", "template", "license", "norm")
        .agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    )
    scored = (
        dots.join(length, ["key", "line"])
        .withColumn("similarity", F.round(F.col("dot") / (F.col("norm") * F.col("length")), 9))
        .where(F.col("similarity") >= threshold)
    )
    best = F.max(F.struct("similarity", (-F.col("line")).alias("first"), (-F.col("template")).alias("low"), "license"))
    return scored.groupBy("key").agg(best.alias("b")).select(
        "key", "b.license", "b.similarity", (-F.col("b.first")).cast("long").alias("line")
    )


def inherited(files: DataFrame) -> DataFrame:
    """Licence of each directory that has files, from itself or its nearest ancestor.

    `files` has path and license (null: none). Returns dir, license and origin.
    """
    own = (
        files.where(F.col("license").isNotNull())
        .groupBy(parent("path").alias("dir"), "license")
        .agg(F.max(F.col("path").rlike(LICENCE_FILE)).alias("file"), F.count("*").alias("n"))
        .groupBy("dir")
        .agg(F.max_by("license", F.struct("file", "n", "license")).alias("license"))
    )
    steps = F.split("dir", "/")
    up = (
        files.select(parent("path").alias("dir"))
        .distinct()
        .select("dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth"))
        .select("dir", "depth", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/").alias("origin"))
    )
    found = up.join(own.withColumnRenamed("dir", "origin"), "origin")
    return found.groupBy("dir").agg(F.max(F.struct("depth", "license", "origin")).alias("b")).select(
        "dir", "b.license", "b.origin"
    )


def parent(path: str) -> Column:
    """Directory of a path; the top one is the empty string."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(files: DataFrame, known: DataFrame, key: str, path: Column, text_col: str = "text",
         threshold: float = THRESHOLD) -> DataFrame:
    """Licence of every file: declared, inherited or none.

    Returns `key`, `path`, `license`, `similarity` (null if inherited), `line` and
    `origin` (directory it comes from, null if declared). One row for each input row; rows
    of equal key declare together. A null text declares nothing, a null path lies in the
    top directory, a null key is a key of its own; no templates or no files give no
    licences or no rows. Other columns are not looked at.
    """
    input_ = files.select(
        F.coalesce(F.col(key).cast("string"), F.lit("null:")).alias("key"), F.col(key).alias("original"),
        F.coalesce(path, F.lit("")).alias("path"), F.col(text_col).alias("text"),
    )
    found = session.materialise(declared(input_.select("key", "text"), known, threshold), "licences")
    marked = input_.drop("text").join(found, "key", "left")
    by_dir = inherited(marked.select("path", "license")).withColumnRenamed("license", "from_dir")
    return (
        marked.withColumn("dir", parent("path"))
        .join(by_dir, "dir", "left")
        .select(
            F.col("original").alias(key),
            "path",
            F.coalesce("license", "from_dir").alias("license"),
            "similarity",
            "line",
            F.when(F.col("license").isNull(), F.col("origin")).alias("origin"),
        )
    )
