"""Benchmark decontamination by winnowing, with DataFrame functions only.

The fingerprint of a window of `SPAN` words is the least hash of its k-word grams; the
least of a sliding window is what winnowing keeps. Equal windows have equal fingerprints,
so every shared span of `SPAN` words is met. Windows of documents whose fingerprint occurs
in the benchmark are extended to all their words and compared as texts. Items of fewer
words than a window are windows of their own length and are treated alike.

All work on words is done inside the row of a document; only windows that share a
fingerprint are shuffled. The fingerprints of the benchmark are broadcast if there are at
most `SMALL` of them and shuffled otherwise.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posewatch import session
from posewatch.functions.staging import staged

SPAN = 10
GRAM = 4
SMALL = 1_000_000  # fingerprints of 8 bytes
SEPARATORS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    small = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(small, F.lit(SEPARATORS), F.lit(0)), F.array().cast("array<string>"))


def shifted(df: DataFrame, column: str, by: int, how) -> DataFrame:
    """Combine each element with the one `by` places on; the column gets shorter by that."""
    left = F.slice(column, F.lit(1), F.greatest(F.size(column) - by, F.lit(0)))
    right = F.slice(column, F.lit(1 + by), F.greatest(F.size(column) - by, F.lit(0)))
    return staged(df, [c for c in df.columns if c != column], **{column: F.zip_with(left, right, how)})


def fingerprints(df: DataFrame, span: int) -> DataFrame:
    """Adds `prints`: the fingerprint of every window of `span` words of `words`."""
    k = min(GRAM, span)
    df = staged(df, df.columns, prints=F.transform("words", lambda w: F.xxhash64(w)))
    for length, how in ((k, lambda a, b: F.xxhash64(a, b)), (span - k + 1, lambda a, b: F.least(a, b))):
        have = 1
        while have < length:
            # a least may overlap itself, a hash is built in the same steps everywhere
            by = min(have, length - have)
            df = shifted(df, "prints", by, how)
            have += by
    return df


def windows(items: DataFrame, item_id: str, text_col: str) -> DataFrame:
    """Windows of the benchmark: item, span, text of the window."""
    cut = staged(items, [F.col(item_id).alias("item")], words=words(F.col(text_col))).where(F.size("words") > 0)
    span = F.least(F.size("words"), F.lit(SPAN))
    return cut.select(
        "item", span.alias("span"), F.explode(F.sequence(F.lit(1), F.size("words") - span + 1)).alias("at"), "words"
    ).select("item", "span", F.array_join(F.slice("words", F.col("at"), F.col("span")), " ").alias("window"))


def hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str) -> DataFrame:
    """Occurrences of benchmark windows: id, hash of the text, start, span, item."""
    known = windows(items, item_id, item_text)
    found = None
    spans = sorted(r.span for r in known.select("span").distinct().collect())  # at most SPAN numbers
    keys = [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("of")]
    cut = staged(docs, keys, words=words(F.col(text_col)))
    for span in spans or [SPAN]:
        own = known.where(F.col("span") == span)
        prints = (
            fingerprints(own.select(F.split("window", " ").alias("words")), span)
            .select(F.explode("prints").alias("print"))
            .distinct()
        )
        if prints.count() <= SMALL:
            prints = F.broadcast(prints)
        near = (
            fingerprints(cut, span)
            .select("id", "of", "words", F.posexplode("prints").alias("at", "print"))
            .join(prints, "print", "left_semi")
            .select("id", "of", "at", F.array_join(F.slice("words", F.col("at") + 1, span), " ").alias("window"))
        )
        part = near.join(own, "window").select("id", "of", "at", "span", "item").distinct()
        found = part if found is None else found.union(part)
    return found


def scan(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Words, hit words and items of every document.

    Returns `id_col`, `n_words`, `n_hit` (words inside any occurrence of a window, long)
    and `items` (their ids as sorted strings), one row for each input row. A null or
    empty text has no words; a null or wordless item has no window; rows with equal id and
    text get equal results; repeated items count once by id, an item without id counts for
    `n_hit` only. Empty tables give no rows or no hits. Other columns are not looked at.
    """
    every = session.materialise(hits(docs, items, id_col, text_col, item_id, item_text), "hits")
    covered = (
        every.select("id", "of", "at", "span")
        .distinct()
        .select("id", "of", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("span") - 1)).alias("word"))
        .distinct()
        .groupBy("id", "of")
        .agg(F.count("*").alias("hit"))
    )
    named = (
        every.select("id", "of", F.col("item").cast("string").alias("item"))
        .distinct()
        .groupBy("id", "of")
        # a document's items are bounded by the benchmark
        .agg(F.array_sort(F.collect_list("item")).alias("found"))
    )
    both = covered.join(named.withColumnsRenamed({"id": "id2", "of": "of2"}),
                        F.col("id").eqNullSafe(F.col("id2")) & (F.col("of") == F.col("of2")))
    counted = docs.select(
        F.col(id_col).alias("doc"),
        F.xxhash64(text_col).alias("own"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORDS_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"),
    )
    return counted.join(
        both.select("id", "of", "hit", "found"),
        F.col("doc").eqNullSafe(F.col("id")) & (F.col("own") == F.col("of")),
        "left",
    ).select(
        F.col("doc").alias(id_col),
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("found", F.array().cast("array<string>")).alias("items"),
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """The documents without any word inside a benchmark window, columns unchanged.

    Of rows with equal id and text all stay or none.
    """
    bad = hits(docs, items, id_col, text_col, item_id, item_text).select("id", "of").distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("id")) & (F.xxhash64(text_col) == F.col("of")), "left_anti")
