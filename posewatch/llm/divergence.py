"""Divergence of sources within a language, with strings joined back last (free style).

Each task counts its own documents' terms per (language, source) and writes the counts
once, term and digest side by side. From there on only 64-bit digests are shuffled: the
string column of the written table is not read by the jobs that sum, filter, compare and
rank. For the digests that pass the document limit the least and the greatest string are
found; where these differ, two terms share the digest, and its rows are summed again by
digest and string, so a collision never changes a result. Texts are joined back for the
ranked terms alone.

A term without occurrences in a group still has a share there. Sums over all kept terms
are therefore taken from the terms that occur: a pair of sources meets only in the terms
that both hold, and the rest follows from each source's shares and the other's base share.
Shares are whole numbers and computed in decimals, so no rounding is left to chance.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posewatch.llm import tables
from posewatch.session import materialise

MIN_DOCS = 30
TOP = 50
SMOOTH = 5
SCALE = 1_000_000_000
# Entries that a task holds before it writes its counts out; some 250 bytes each.
HELD = 600_000
SALTS = 32
# A set of this many 64-bit digests takes about 50 MB where it is broadcast.
BROADCAST_ROWS = 2_000_000

# Letters and all bytes above ASCII stay, A-Z lower-cased; the rest parts terms.
_TERM_BYTES = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_TALLY = "lang string, source string, digest long, term string, n long, docs long, lead boolean"


def tally(df: DataFrame, text_col: str, lang_col: str, source_col: str, bits: int = 64) -> DataFrame:
    """Counts of each task: (lang, source, digest, term, n, docs, lead).

    `docs` is the number of documents, `lead` marks one row of each term of a block of
    counts. A group also gives a row without digest, so that it is known even without terms.
    """
    schema = tables.arrow_schema(df.sparkSession, _TALLY)
    tables.bounded(df.sparkSession)

    def rows(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            lead = [t not in known for t in terms]
            for t, new in zip(terms, lead, strict=True):
                if new:
                    d = xxhash.xxh3_64_intdigest(t) >> (64 - bits)
                    known[t] = d - (1 << 64) if d >> 63 else d
            size = len(terms) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()),
                    pa.array([source] * size, pa.string()),
                    pa.array([None, *map(known.__getitem__, terms)], pa.int64()),
                    pa.array([None, *terms], pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *map(docs.__getitem__, terms)], pa.int64()),
                    pa.array([False, *lead], pa.bool_()),
                ],
                schema=schema,
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.encode().translate(_TERM_BYTES).split()
                if (lang, source) not in counts:
                    counts[lang, source] = Counter(), Counter()
                    held += 1
                n, docs = counts[lang, source]
                held -= len(n)
                n.update(words)
                docs.update(set(words))
                held += len(n)
            if held >= HELD:
                yield from rows(counts)
                counts, held = {}, 0
        yield from rows(counts)

    def given(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    return df.select(given(lang_col), given(source_col), given(text_col)).mapInArrow(work, _TALLY)


def _among(df: DataFrame, digests: DataFrame, how: str) -> DataFrame:
    """Semi or anti join by digest; the digests are broadcast if they are few."""
    few = digests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(digests) if few else digests, "digest", how)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 5) / (total + 5 * terms)); null without terms."""
    part = F.lit(SCALE).cast("decimal(18,0)") * (n + SMOOTH).cast("decimal(19,0)")
    whole = (total + SMOOTH * terms).cast("decimal(20,0)")
    return F.when(terms > 0, 1 + F.call_function("div", part, whole))


def kept_rows(counts: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Counts of kept terms per group, and the string of every kept digest.

    `apart` is empty, or the string where strings share a digest.
    """
    within = Window.partitionBy("lang", "digest")
    summed = (
        counts.where(F.col("digest").isNotNull())
        .select("lang", "source", "digest", "n", "docs")
        .repartition("lang", "digest")  # rows are one per term and task; both steps below stay there
        .groupBy("lang", "source", "digest")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("docs", F.sum("docs").over(within))
        .where(F.col("docs") >= min_docs)
        .drop("docs")
    )
    found = materialise(summed, "divergence-digests")
    strings = _among(counts.where("lead").select("digest", "term"), found.select("digest").distinct(), "left_semi")
    known = materialise(
        strings.groupBy("digest").agg(F.min("term").alias("least"), F.max("term").alias("greatest")),
        "divergence-strings",
    )
    shared = known.where("least <> greatest").select("digest")
    within = Window.partitionBy("lang", "digest", "apart")
    apart = (
        _among(counts.select("lang", "source", "digest", "term", "n", "docs"), shared, "left_semi")
        .groupBy("lang", "source", "digest", F.col("term").alias("apart"))
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("docs", F.sum("docs").over(within))
        .where(F.col("docs") >= min_docs)
        .drop("docs")
    )
    alone = _among(found, shared, "left_anti").withColumn("apart", F.lit(""))
    return alone.unionByName(apart), known.select("digest", F.col("least").alias("term"))


def _shares(kept: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept rows with the shares p (group) and q (language), and the groups' figures."""
    term = ["lang", "digest", "apart"]
    rows = materialise(kept.withColumn("lang_n", F.sum("n").over(Window.partitionBy(*term))), "divergence-kept")
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_held"))
    by_lang = (
        rows.groupBy(*term).agg(F.sum("n").alias("n"))
        .groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("n_terms"))
    )
    zero = {"total": 0, "n_held": 0, "lang_total": 0, "n_terms": 0}
    groups = (
        counts.select("lang", "source").distinct()
        .join(own, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(zero)
        .withColumn("base", _share(F.lit(0).cast("long"), F.col("total"), F.col("n_terms")))
    )
    groups = materialise(groups, "divergence-groups")
    # A group may hold a third of all rows: its figures are repeated for each salt.
    salted = groups.drop("n_held").withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    shares = (
        rows.withColumn("salt", F.pmod("digest", F.lit(SALTS)).cast("int"))
        .join(salted, ["lang", "source", "salt"])
        .select(
            *term, "source", "base",
            _share(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"),
            _share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms")).alias("q"),
        )
    )
    return materialise(shares, "divergence-shares"), groups


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Distance of every source to each other source of its language."""
    right = shares.select("lang", "digest", "apart", *[F.col(c).alias(f"{c}_2") for c in ("source", "p", "base")])
    met = (
        shares.join(right, ["lang", "digest", "apart"]).where("source < source_2")
        .groupBy("lang", "source", "source_2").agg(
            F.count("*").alias("n_both"),
            F.sum(F.abs(F.col("p") - F.col("p_2"))).alias("apart_by"),
            F.sum(F.abs(F.col("p") - F.col("base_2"))).alias("from_first"),
            F.sum(F.abs(F.col("p_2") - F.col("base"))).alias("from_second"),
        )
    )
    other = groups.select("lang", *[F.col(c).alias(f"{c}_2") for c in ("source", "base", "n_held")])
    # Each source's own shares, few different ones, against the base share of each other source.
    levels = shares.groupBy("lang", "source", "p").count()
    alone = (
        levels.join(other.select("lang", "source_2", "base_2"), "lang").where("source <> source_2")
        .groupBy("lang", "source", "source_2")
        .agg(F.sum(F.col("count") * F.abs(F.col("p") - F.col("base_2"))).alias("own"))
    )
    back = alone.select("lang", F.col("source_2").alias("source"), F.col("source").alias("source_2"), F.col("own").alias("own_2"))
    key = ["lang", "source", "source_2"]
    none = dict.fromkeys(["n_both", "apart_by", "from_first", "from_second", "own", "own_2"], 0)
    total = (
        groups.join(other, "lang").where("source < source_2")
        .join(met, key, "left").join(alone, key, "left").join(back, key, "left").fillna(none)
        .withColumn("neither", F.col("n_terms") - F.col("n_held") - F.col("n_held_2") + F.col("n_both"))
        .select(*key, F.when(F.col("n_terms") == 0, F.lit(0).cast("long")).otherwise(
            F.col("apart_by") + F.col("own") - F.col("from_first") + F.col("own_2") - F.col("from_second")
            + F.col("neither") * F.abs(F.col("base") - F.col("base_2"))
        ).alias("value"))
    )
    sides = F.array(F.struct("source", F.col("source_2").alias("item")), F.struct(F.col("source_2").alias("source"), F.col("source").alias("item")))
    return total.select("lang", F.inline(sides), "value")


def audit(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    digest_bits: int = 64,
) -> DataFrame:
    """How far the sources of each language are apart, and the terms each one favours.

    Returns (lang, source, part, item, value, rank). Part `pair` has each other source of
    the language with the distance of their term shares; part `term` the `top` terms
    whose share in the group exceeds their share in the language. Ranks go by value
    downwards, then by item in byte order.

    Null texts, languages and sources count as empty; a document without terms still
    makes its group known; every row is a document, repeated rows and ids included;
    other columns are not looked at; an empty table gives no rows. A language without
    kept terms has distances of 0 and no terms. `digest_bits` below 64 serves tests of
    colliding digests.
    """
    counts = materialise(tally(df, text_col, lang_col, source_col, digest_bits), "divergence-counts")
    kept, strings = kept_rows(counts, min_docs)
    shares, groups = _shares(kept, counts)
    group = Window.partitionBy("lang", "source")
    place = F.row_number().over(group.orderBy(F.desc("value"), "item"))
    pairs = _pairs(shares, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    favoured = (
        shares.select("lang", "source", "digest", "apart", (F.col("p") - F.col("q")).alias("value"))
        .where("value > 0")
        .withColumn("near", F.rank().over(group.orderBy(F.desc("value"))))
        .where(F.col("near") <= top)  # equal values at the border stay until the strings are known
    )
    named = favoured.join(strings, "digest", "left").select(
        "lang", "source", F.lit("term").alias("part"),
        F.when(F.col("apart") == "", F.col("term")).otherwise(F.col("apart")).alias("item"), "value",
    )
    return (
        pairs.withColumn("rank", place)
        .unionByName(named.withColumn("rank", place).where(F.col("rank") <= top))
        .select("lang", "source", "part", "item", "value", "rank")
    )
