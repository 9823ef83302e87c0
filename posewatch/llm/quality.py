"""Quality rules with risk-controlled thresholds (free style).

Measures of every whole text are taken once. For each stratum (language) and measure, a
cutoff is chosen on labelled documents: going from lenient to strict over a fixed grid,
the exact binomial (Clopper-Pearson) upper bound of the share of good documents that the
cutoff rejects must stay within `LIMIT`. The walk stops at the first cutoff without the
guarantee, so no correction is needed along the grid; over strata and measures the level
is divided by their number (Bonferroni). All cutoffs of all strata thus keep the limit
together with a chance of at least 1 - `LEVEL`. Good documents that the base rule rejects
are lost anyway and are not counted.

Strata with too few labelled documents for that are judged together, as one stratum; there
the limit holds for all of them and not for each. If these are too few as well, only as many
measures are tried, in the order of `GRID`, as their number can certify. All this is chosen
by the numbers of documents alone, not by what the cutoffs reject, so the level holds. What
is too small even so, or has no labelled good document, gets no cutoff.

Labelled documents are counted per (stratum, measure, grid cell) with partial sums; the
counts and the chosen cutoffs have a few hundred rows for each stratum and are joined
back by stratum.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posewatch import session
from posewatch.llm import tables, words

LIMIT = 0.001
LEVEL = 0.05
# A document fails if a measure lies above its cutoff. The grid goes from strict to
# lenient; a cutoff is one of these values.
GRID = {
    "symbols_per_word": [round(0.05 * 1.15**i, 4) for i in range(36)],
    "duplicate_line_share": [round(0.02 * i, 4) for i in range(5, 50)],
    "repeated_word_share": [round(0.02 * i, 4) for i in range(5, 50)],
    "mean_word_length": [round(5 + 0.1 * i, 4) for i in range(80)],
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.ones(256, bool)  # bytes that begin a code point and are no white space
_LETTER[0x80:0xC0] = False
_LETTER[[0x20, *range(0x09, 0x0E)]] = False


def repeated_words(h: np.ndarray, n: int = 8) -> int:
    """Words in windows of `n` words that the text has twice or more."""
    if len(h) < n + 1:
        return 0
    g = words.grams(h, n)
    order = np.argsort(g)
    same = g[order][1:] == g[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(g), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    edge[: len(g)] += hit
    edge[n : n + len(g)] -= hit
    return int((np.cumsum(edge) > 0).sum())


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """Counts of every whole text: id, stratum and the columns of `COUNTS`.

    One row for each input row. A null text has no words; a null stratum is a stratum.
    """
    spark = df.sparkSession
    tables.bounded(spark)
    kinds = dict(df.dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, `{stratum}` {kinds[stratum]}, " + ", ".join(f"{c} long" for c in COUNTS)
    out_schema = tables.arrow_schema(spark, schema)

    def batches(it):
        for batch in it:
            w = words.words(batch.column(2), lower=False)
            rows = []
            for i in range(len(w)):
                text, h = w.text(i), w.of(i)
                lines = [x for x in text.tobytes().split(b"\n") if x.strip()]
                rows.append(
                    (
                        len(h),
                        int(_LETTER[text].sum()),
                        int(_SYMBOL[text].sum()),
                        len(lines) - len({*lines}),
                        repeated_words(h),
                        len(lines),
                    )
                )
            numbers = np.array(rows, np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(numbers[:, j]) for j in range(len(COUNTS)))],
                schema=out_schema,
            )

    return df.select(id_col, stratum, text_col).mapInArrow(batches, schema)


def with_measures(counts: DataFrame) -> DataFrame:
    some = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return counts.withColumns(
        {
            "symbols_per_word": F.col("n_symbols") / some,
            "duplicate_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeated_word_share": F.col("n_repeat_words") / some,
            "mean_word_length": F.col("word_chars") / some,
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def upper_tail(x: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Chance of at most `x` successes in `n` trials of chance `p`. The exact upper bound
    for `x` of `n` is below `p` if this is below the level."""

    def one(x: int, n: int, p: float) -> float:
        total, log = 0.0, n * math.log1p(-p)
        for k in range(int(x) + 1):
            total += math.exp(log)
            if n == k:
                break
            log += math.log(n - k) - math.log(k + 1) + math.log(p) - math.log1p(-p)
        return min(total, 1.0)

    # Beyond ten times the expected number the chance is 1 for any level in use.
    return pd.Series([one(a, b, c) if a <= 10 * b * c + 50 else 1.0 for a, b, c in zip(x, n, p, strict=True)])


def exceeded_by(measure: str):
    return lambda cutoff: F.col(measure) > cutoff


def cutoffs(good: DataFrame, stratum: str, limit: float = LIMIT, level: float = LEVEL) -> DataFrame:
    """Cutoff of each (stratum, measure) with the guarantee; others have no row.

    `good` holds the measures of labelled good documents that pass the base rule.
    """
    n_rules = len(GRID)
    cells = F.array(
        *(
            F.struct(
                F.lit(name).alias("measure"),
                # how many cutoffs of the grid, from the strictest on, the value exceeds
                F.size(F.filter(F.array(*map(F.lit, map(float, grid))), exceeded_by(name))).alias("cell"),
            )
            for name, grid in GRID.items()
        )
    )
    counted = (
        good.select(F.col(stratum).alias("stratum"), F.explode(cells).alias("c"))
        .groupBy("stratum", "c.measure", "c.cell")
        .agg(F.count("*").alias("n"))
    )
    # Each measure has all documents. A stratum that can certify all measures beside all
    # other strata stands alone (`own`), the others are one pool with a null `name`.
    clean = F.lit(math.log1p(-limit))  # of the chance that one more document is good
    sizes = counted.where(F.col("measure") == next(iter(GRID))).groupBy("stratum").agg(F.sum("n").alias("size"))
    every = sizes.agg(F.count("*").alias("n_strata"))
    members = (
        sizes.crossJoin(F.broadcast(every))  # one row
        .withColumn("own", clean * F.col("size") <= F.log(level / (F.col("n_strata") * n_rules)))
        .select("stratum", "own", F.when(F.col("own"), F.col("stratum")).alias("name"), "size")
    )
    groups = members.groupBy("own", "name").agg(F.sum("size").alias("size"))
    tried = groups.agg(F.count("*").alias("n_groups"))
    # Level of each measure of a group, and how many of the measures it tries.
    share = F.lit(level) / F.col("n_groups")
    afford = F.floor(share * F.exp(-clean * F.least(F.col("size"), F.lit(int(30 / -math.log1p(-limit))))))
    shares = (
        groups.crossJoin(F.broadcast(tried))  # one row
        .withColumn("n_tried", F.least(afford, F.lit(n_rules)))
        .where("n_tried > 0")
        .select(F.col("own").alias("_own"), F.col("name").alias("_name"), "n_tried", (share / F.col("n_tried")).alias("share"))
    )
    rank = F.create_map(*(x for i, n in enumerate(GRID) for x in (F.lit(n), F.lit(i))))
    of = members.select(F.col("stratum").alias("_stratum"), "own", "name")
    counted = (
        counted.join(of, F.col("stratum").eqNullSafe(F.col("_stratum")))
        .groupBy("own", "name", "measure", "cell")
        .agg(F.sum("n").alias("n"))
    )
    same_group = (F.col("own") == F.col("_own")) & F.col("name").eqNullSafe(F.col("_name"))
    per = Window.partitionBy("own", "name", "measure")
    grid = F.create_map(*(x for n, g in GRID.items() for x in (F.lit(n), F.array(*map(F.lit, map(float, g))))))
    # Rejected by cutoff j: the documents of the cells above j.
    filled = (
        counted.groupBy("own", "name", "measure")
        .agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("by_cell"), F.sum("n").alias("total"))
        .withColumn("grid", grid[F.col("measure")])
        .select("own", "name", "measure", "by_cell", "total", F.posexplode("grid").alias("j", "cutoff"))
        .withColumn(
            "x",
            F.aggregate(
                F.map_entries("by_cell"),
                F.lit(0).cast("long"),
                lambda a, e: a + F.when(e["key"] > F.col("j"), e["value"]).otherwise(F.lit(0)),
            ),
        )
        .join(shares, same_group)
        .where(rank[F.col("measure")] < F.col("n_tried"))
        .withColumn("chance", F.pandas_udf(upper_tail, T.DoubleType())("x", "total", F.lit(limit)))
        .withColumn("safe", F.col("chance") <= F.col("share"))
    )
    stop = F.max(F.when(~F.col("safe"), F.col("j"))).over(per)
    found = (
        filled.withColumn("stop", F.coalesce(stop, F.lit(-1)))
        .where(F.col("j") > F.col("stop"))
        .groupBy(F.col("own").alias("_own"), F.col("name").alias("_name"), "measure")
        .agg(F.min("cutoff").alias("cutoff"))
    )
    return members.join(found, same_group).select("stratum", "measure", "cutoff")


def judge(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang"
) -> DataFrame:
    """Counts and verdict of every document.

    Returns `id_col`, `stratum`, `COUNTS`, `base_failed`, `failed_rules` (array of
    measure names) and `kept`. `labels` has `doc_id` and `quality` (1 good); labels of
    unknown documents, null labels and repeated equal labels change nothing. One row for
    each input row; a null or empty text has no words and fails the base rule; a null
    stratum is a stratum of its own; empty tables give no rows; other columns are not
    looked at. The counts are written once below the shared folder and read twice.
    """
    counts = session.materialise(measure(df, id_col, text_col, stratum), "quality")
    measured = with_measures(counts)
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_label")).distinct()
    chosen = cutoffs(
        measured.where(~base_failed()).join(good, F.col(id_col) == F.col("_label"), "left_semi"), stratum
    )
    wide = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("measure", "cutoff"))).alias("cut"))
    rules = F.array_compact(
        F.array(*(F.when(F.col(n) > F.col("cut")[n], F.lit(n)) for n in GRID))
    )
    return (
        # a few rows, one for each stratum; larger tables are left to the optimizer
        measured.join(wide, F.col(stratum).eqNullSafe(F.col("stratum")), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("failed_rules", F.when(F.col("cut").isNull(), F.array().cast("array<string>")).otherwise(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .select(id_col, *([F.col(stratum)] if stratum != id_col else []), *COUNTS, "base_failed", "failed_rules", "kept")
    )
