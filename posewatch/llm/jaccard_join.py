"""Similarity join on word shingles by a grouped prefix join (free style).

Two documents link when the Jaccard similarity of their shingle sets is at least
`percent` / 100. Sets that link share a token among the first `n - ceil(t n) + 1` tokens of
either, in any one order of all tokens. The order here puts frequent tokens last: those
are a list of fixed length, counted over the whole input; all others go by their hash.

1. Sketch: size, set hash, prefix and a parity signature of every document, written once.
2. Equal sets become one variant; variants with equal prefix and size become one group.
   Only groups are spread over their prefix tokens, so copies cost nothing here.
3. Tokens of one variant only fall away. The rest is expanded to variants, and each
   token's list is searched for pairs. Size, position and signature give upper bounds
   of the overlap, so nearly all remaining pairs are links.
4. Round one pairs each variant with at most `LEADERS` leaders of its list, so a family
   of copies costs a few lines per member, not a line per pair. A variant with fewer
   possible partners is a leader itself and so meets all others of its list. After verification, lists whose
   variants are in several components give all their remaining pairs across components
   in the last round. Lists of more than `LIST` variants are cut into parts, which lead
   to one more round of leaders; the last round pairs part with part.
5. Pairs are verified with the whole sets; links become components.

No pair within a component is ever needed twice, and no link between two components
can be missed: every such pair shares a prefix token and meets in the last round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posewatch import session
from posewatch.llm import tables, words
from posewatch.llm.components import components

FREQUENT = 1 << 17  # greatest length of the list of frequent tokens, sent to every task (2 MB)
RARE = 8  # tokens seen less often are not looked at for that list
LIST = 2048  # variants of one token in one part
LEADERS = 8  # partners after which a variant is not compared further in round one
FLUSH = 2_000_000  # tokens counted at once in a task
FETCH = 1_000_000  # ids of documents to verify that may be sent to every task (8 MB)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `n` words; fewer words are one run."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(words.grams(h, min(n, len(h))))


def needed_overlap(total: int, percent: int) -> int:
    """Least intersection of two linked sets whose sizes add up to `total`."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def frequent_tokens(docs: DataFrame, text_col: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (by documents) and their counts, sorted by token.

    Tasks report tokens that they see twice or more. The result only sets the order of
    tokens, so a count may be low without changing any result.
    """

    def tally(parts: list[np.ndarray]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(parts), return_counts=True)
        keep = count > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(token[keep].view(np.int64)), pa.array(count[keep].astype(np.int64))], ["token", "n"]
        )

    def batches(it):
        parts, size = [np.zeros(0, np.uint64)], 0
        for batch in it:
            w = words.words(batch.column(0), lower=True)
            for i in range(len(w)):
                parts.append(shingle_set(w.of(i), n))
                size += len(parts[-1])
            if size > FLUSH:
                yield tally(parts)
                parts, size = [np.zeros(0, np.uint64)], 0
        yield tally(parts)

    counts = session.materialise(
        docs.select(text_col)
        .mapInArrow(batches, "token long, n long")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .where(f"n >= {RARE}"),
        "counts",
    )
    # The least count at which the list has at most FREQUENT tokens, from a histogram of
    # a few hundred cells.
    cell = F.floor(F.log2("n") * 8)
    cells = sorted(counts.groupBy(cell.alias("cell")).count().collect(), reverse=True)
    size, least = 0, None
    for row in cells:
        size += row["count"]
        if size > FREQUENT:
            break
        least = row["cell"]
    top = counts.where(cell >= least if least is not None else F.lit(False)).toPandas()  # at most FREQUENT rows
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["n"].to_numpy(np.int64)[order]


def sketch(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """One row for each document: id, size, set hash, prefix, prefix hash, signature."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_tokens(docs, text_col, n))
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, size int, vid long, group long, prefix array<long>, bits binary"
    out_schema = tables.arrow_schema(spark, schema)

    def one(s: np.ndarray, token: np.ndarray, count: np.ndarray):
        if not len(s):
            return 0, None, None, None, None
        vid = int(words.mix(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15)) + s.sum()[None]).view(np.int64)[0])
        rank = np.zeros(len(s), np.int64)
        if len(token):
            at = np.minimum(np.searchsorted(token, s), len(token) - 1)
            rank = np.where(token[at] == s, count[at], 0)
        order = np.lexsort((s, rank))[: prefix_length(len(s), percent)]
        prefix = s[order]
        group = int(words.grams(prefix, len(prefix)).view(np.int64)[0])
        width = 1 << max(6, int(len(s) - 1).bit_length() - 1)
        bits = np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1)
        return len(s), vid, group, prefix.view(np.int64), bits.tobytes()

    def batches(it):
        token, count = frequent.value
        for batch in it:
            w = words.words(batch.column(1), lower=True)
            rows = [one(shingle_set(w.of(i), n), token, count) for i in range(len(w))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(out_schema.field(0).type)]
                + [pa.array(list(c), out_schema.field(j + 1).type) for j, c in enumerate(columns)],
                schema=out_schema,
            )

    return session.materialise(docs.select(id_col, text_col).mapInArrow(batches, schema), "sketch")


def differ_at_least(a: int, wa: int, b: int, wb: int) -> int:
    """Lower bound of the symmetric difference of two sets from their parity bits."""
    while wa > wb:
        wa >>= 1
        a = (a >> wa) ^ (a & ((1 << wa) - 1))
    while wb > wa:
        wb >>= 1
        b = (b >> wb) ^ (b & ((1 << wb) - 1))
    return (a ^ b).bit_count()


def search(percent: int, leaders_only: bool):
    """Pairs of each list of (key, part, vid, size, pos, bits, comp) rows in key order."""

    def possible(x, y) -> bool:
        (_, nx, px, bx, _, _), (_, ny, py, by, _, _) = x, y
        total = nx + ny
        need = needed_overlap(total, percent)
        if need > min(nx, ny) or 1 + min(nx - px - 1, ny - py - 1) < need:
            return False
        return differ_at_least(int.from_bytes(bx), 8 * len(bx), int.from_bytes(by), 8 * len(by)) <= total - 2 * need

    def pairs(rows: list) -> Iterator[tuple[int, int]]:
        if leaders_only:
            leaders = []
            for x in rows:
                partners = 0
                for y in leaders:
                    if possible(x, y):
                        yield y[0], x[0]
                        partners += 1
                        if partners == LEADERS:
                            break
                else:
                    leaders.append(x)
        else:
            cross = len({x[5] for x in rows}) > 1  # a block of two parts
            rows = sorted(rows, key=lambda x: x[1])
            for i, x in enumerate(rows):
                for y in rows[i + 1 :]:
                    if 100 * x[1] < percent * y[1]:
                        break
                    if x[4] != y[4] and (not cross or x[5] != y[5]) and possible(x, y):
                        yield x[0], y[0]

    def batches(it):
        def rows():
            for batch in it:
                yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)

        out: list[tuple[int, int]] = []
        for _, group in groupby(rows(), key=lambda r: r[:2]):
            members = [r[2:] for r in group]
            if len(members) > 1:
                out += ((min(p), max(p)) for p in pairs(members))
            if len(out) > 50_000:
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in {*out}])
                out = []
        found = list({*out})
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"]
        )

    return batches


def candidate_pairs(lists: DataFrame, percent: int, leaders_only: bool) -> DataFrame:
    """Pairs (a, b) to verify. `lists` has token, n, vid, size, pos, bits, comp."""
    parts = F.ceil(F.col("n") / LIST).cast("int")
    part = F.pmod(F.xxhash64("vid"), parts).cast("int")
    if leaders_only:
        keyed = lists.withColumn("part", part).withColumn("block", F.concat_ws("-", part))
    else:
        # every pair of parts meets in one block
        other = F.explode(F.sequence(F.lit(0), parts - 1))
        keyed = (
            lists.withColumn("part", part)
            .withColumn("other", other)
            .withColumn("block", F.concat_ws("-", F.least("part", "other"), F.greatest("part", "other")))
        )
    return (
        keyed.repartition("token", "block")
        .sortWithinPartitions("token", "block", "vid")
        .select("token", "block", "vid", "size", "pos", "bits", "comp", "part")
        .mapInArrow(search(percent, leaders_only), "a long, b long")
        .distinct()
    )


def verified(
    pairs: DataFrame, docs: DataFrame, first: DataFrame, id_col: str, text_col: str, n: int, percent: int
) -> DataFrame:
    """The pairs whose whole sets link. `first` names a document for each variant."""
    spark = docs.sparkSession
    vids = pairs.select(F.explode(F.array("a", "b")).alias("vid")).distinct()
    ids = session.materialise(first.join(vids, "vid", "left_semi"), "fetch")
    wanted = ids.select("doc").distinct()
    if ids.count() <= FETCH:
        wanted = F.broadcast(wanted)  # checked just now; a larger one is shuffled
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = named.join(wanted, F.col("_id").eqNullSafe(F.col("doc")), "left_semi").select("_text")

    def batches(it):
        for batch in it:
            w = words.words(batch.column(0), lower=True)
            sets = [shingle_set(w.of(i), n) for i in range(len(w))]
            sets = [s for s in sets if len(s)]
            vid = [words.mix(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15)) + s.sum()[None])[0] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(vid, np.uint64).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["vid", "tokens"],
            )

    sets = texts.mapInArrow(batches, "vid long, tokens binary").join(vids, "vid", "left_semi").dropDuplicates(["vid"])
    sets = session.materialise(sets, "sets")

    def check(it):
        for batch in it:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    tables.bounded(spark)
    return session.materialise(
        pairs.join(sets.withColumnsRenamed({"vid": "b", "tokens": "tb"}), "b")
        .join(sets.withColumnsRenamed({"vid": "a", "tokens": "ta"}), "a")
        .select("a", "b", "ta", "tb")
        .mapInArrow(check, "a long, b long"),
        "linked",
    )


def sent(small: DataFrame) -> DataFrame:
    """A written table, marked to be sent to every task if it has at most `FETCH` rows."""
    small = session.materialise(small, "small")
    return F.broadcast(small) if small.count() <= FETCH else small


def link(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90
) -> DataFrame:
    """Set size and component of every document.

    Returns `id_col`, `n_shingles` (long) and `component` (least id reachable by links,
    the own id included), one row for each input row. Words are lower-cased A-Z. A null
    or empty text, or one of white space, has an empty set and links with nothing; a text
    of fewer than `n` words has its whole sequence as the only shingle. Rows with equal
    ids are looked at one by one; a null id is the greatest of all. Empty tables give no
    rows, and other columns are not looked at.
    """
    rows = sketch(docs, id_col, text_col, n, percent)
    some = rows.where("size > 0")
    narrow = some.select("id", "vid", "size", "group")
    first = session.materialise(
        narrow.groupBy("vid", "size", "group").agg(F.min("id").alias("doc")), "variants"
    )
    copies = sent(
        narrow.join(first.select("vid", "doc"), "vid").where(~F.col("id").eqNullSafe(F.col("doc"))).select("id", "vid")
    )
    variants = some.join(copies, ["id", "vid"], "left_anti").select("vid", "size", "group", "prefix", "bits")
    # Groups of several variants: the head is spread for all of them.
    several = first.groupBy("group", "size").agg(F.min("vid").alias("head"), F.count("*").alias("members")).where("members > 1")
    several = session.materialise(several, "groups")
    others = sent(
        first.join(several, ["group", "size"]).where("vid <> head").select("head", F.col("vid").alias("other"))
    )
    heads = variants.join(others.select(F.col("other").alias("vid")), "vid", "left_anti").join(
        sent(several.select(F.col("head").alias("vid"), "members")), "vid", "left"
    )
    spread = heads.select(
        "vid", "size", F.coalesce("members", F.lit(1)).cast("int").alias("members"), F.posexplode("prefix").alias("pos", "token")
    )
    shared = spread.groupBy("token").agg(F.sum("members").alias("n")).where("n > 1")
    kept = session.materialise(spread.join(shared, "token").select("token", "n", "vid", "size", "pos", "members"), "lists")
    expanded = (
        kept.where("members > 1")
        .join(others.withColumnRenamed("head", "vid"), "vid")
        .select("token", "n", F.col("other").alias("vid"), "size", "pos")
    )
    lists = kept.drop("members").union(expanded)
    bits = variants.select("vid", "bits")

    def search_lists(some_lists: DataFrame, leaders_only: bool) -> DataFrame:
        found = candidate_pairs(some_lists.join(bits, "vid"), percent, leaders_only)
        return session.materialise(found, "pairs")

    def verify(pairs: DataFrame) -> DataFrame:
        return verified(pairs, docs, first, id_col, text_col, n, percent)

    def unmerged(edges: DataFrame, pairs: DataFrame) -> DataFrame:
        """Lists in which pairs across components may be left, rows with component.

        A list whose variants all became leaders has had all its pairs looked at. What
        follows a leader is the greater of a pair, as lists are searched in order.
        """
        comp = components(edges)
        followers = pairs.select(F.col("b").alias("follower")).distinct()
        known = (
            lists.join(comp, F.col("vid") == F.col("node"), "left")
            .withColumn("comp", F.coalesce("comp", "vid"))
            .join(followers, F.col("vid") == F.col("follower"), "left")
        )
        known = session.materialise(known.drop("node"), "known")
        left = (
            known.groupBy("token", "n")
            .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("follower").alias("f"))
            .where((F.col("lo") < F.col("hi")) & ((F.col("f") > 0) | (F.col("n") > LIST)))
        )
        return known.drop("follower").join(left.select("token"), "token", "left_semi")

    pairs = search_lists(lists.withColumn("comp", F.col("vid")), leaders_only=True)
    edges = verify(pairs)
    if not lists.where(F.col("n") > LIST).isEmpty():
        # Parts of one list have leaders of their own: let those meet.
        heads = unmerged(edges, pairs).groupBy("token", "comp").agg(
            F.min_by(F.struct("vid", "size", "pos"), "vid").alias("r"))
        size = heads.groupBy("token").agg(F.count("*").alias("n"))
        more = search_lists(heads.select("token", "comp", "r.*").join(size, "token"), leaders_only=True)
        edges, pairs = edges.union(verify(more)), pairs.union(more)
    edges = edges.union(verify(search_lists(unmerged(edges, pairs), leaders_only=False)))
    comp = components(edges)
    whole = (
        first.join(comp, F.col("vid") == F.col("node"), "left")
        .select("vid", "doc", F.coalesce("comp", "vid").alias("comp"))
    )
    least = whole.groupBy("comp").agg(F.min("doc").alias("least"))
    by_variant = whole.join(least, "comp").select(F.col("vid").alias("_vid"), "least")
    return rows.join(by_variant, F.col("vid") == F.col("_vid"), "left").select(
        F.col("id").alias(id_col),
        F.col("size").cast("long").alias("n_shingles"),
        F.coalesce("least", "id").alias("component"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row of each group of documents that link, directly or not; columns unchanged.

    The row with the smallest id stays, a null id being the greatest. Rows are told apart
    by a number that is written once, so null and repeated ids, also of different texts or
    of equal rows, are documents of their own. Rows without words stay.
    """
    keyed = session.materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    linked = link(keyed, "_row", text_col, n, percent)
    named = linked.join(keyed.select("_row", F.col(id_col).alias("_id")), "_row").select("_row", "_id", "component")
    named = session.materialise(named, "components")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first")
    gone = (
        named.join(named.groupBy("component").agg(first), "component")
        .where(F.col("_row") != F.col("first._row")).select("_row")
    )
    return keyed.join(gone, "_row", "left_anti").drop("_row")
