"""Ordered scans in two passes against plain Python and against one window."""

import random

import pytest
from pyspark.sql import functions as F

from posewatch.operators import prefix

KINDS = ["number", "sum_before", "maximum", "latest", "previous"]


def plain(rows, kind):
    """rows: (key, order, value) in order of one key."""
    out, top, last, total = [], None, None, 0
    for n, (_, _, v) in enumerate(rows):
        if kind == "previous":
            out.append(rows[n - 1][2] if n else None)
        elif kind == "sum_before":
            out.append(total)
        total += v or 0
        if v is not None:
            top = v if top is None else max(top, v)
            last = v
        if kind == "number":
            out.append(n + 1)
        elif kind == "maximum":
            out.append(top)
        elif kind == "latest":
            out.append(last)
    return out


def expected(rows, kind):
    found = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for r, x in zip(own, plain(own, kind), strict=True):
            found[r[:2]] = x
    return found


@pytest.fixture(scope="module", params=["small keys", "one hot key", "mixed", "all null"])
def rows(request):
    draw = random.Random(request.param)
    n = 3_000
    key = {
        "small keys": lambda i: f"k{i % 900}",
        "one hot key": lambda i: "hot",
        "mixed": lambda i: "hot" if i % 3 else draw.choice([None, "a", "zz", f"k{i % 50}"]),
        "all null": lambda i: None,
    }[request.param]
    return [(key(i), i, None if draw.random() < 0.3 else float(draw.randint(-50, 50))) for i in range(n)]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("number", ["long", "double"])
def test_two_passes(spark, rows, kind, number):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, i long, v double").repartition(4)
        df = df.withColumn("v", F.col("v").cast(number))
        got = prefix.scan(df, ["k"], ["i"], kind, "out", F.col("v"), window_rows=0)
        assert got.columns == ["k", "i", "v", "out"]
        assert {(r.k, r.i): r.out for r in got.collect()} == expected(rows, kind)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("kind", KINDS)
def test_same_as_one_window(spark, rows, kind):
    df = spark.createDataFrame(rows, "k string, i long, v double")
    got = prefix.scan(df, ["k"], ["i"], kind, "out", F.col("v"))
    assert {(r.k, r.i): r.out for r in got.collect()} == expected(rows, kind)


def test_carries_are_few_and_equal_order_values_are_cut(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(F.lit(7).alias("k"), F.lit(1).alias("same"), "id")
        ranged = df.withColumn(prefix._VALUE, F.lit(None).cast("long")).repartitionByRange("k", "same", F.xxhash64("id"))
        local = prefix._scanned(ranged.withColumn(prefix._PART, F.spark_partition_id()), ["k"], "number").persist()
        parts = {r[0]: r[1] for r in local.groupBy(prefix._PART).count().collect()}
        assert len(parts) == 8 and max(parts.values()) < 5_000  # one order value over all tasks
        carried = prefix.carries(local, ["k"], "number").collect()
        assert len(carried) == len(parts) and sum(r["__met"] for r in carried) == len(parts) - 1
        local.unpersist()
        numbers = prefix.scan(df, ["k"], ["same"], "number", "n", window_rows=0)
        assert sorted(r.n for r in numbers.select("n").collect()) == list(range(1, 20_001))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_keys_and_no_rows(spark):
    df = spark.range(500).select("id", (F.col("id") * 7 % 500).alias("o"))
    got = prefix.scan(df, [], ["o"], "number", "n", window_rows=0)
    assert all(r.n == r.o + 1 for r in got.collect())
    for rows in (0, 10):
        assert prefix.scan(df.limit(0), ["id"], ["o"], "maximum", "n", F.col("o"), window_rows=rows).count() == 0
