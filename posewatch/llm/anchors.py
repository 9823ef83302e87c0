"""Bringing equal windows of different documents together, shared by the two operators
on repeated substrings.

Every window of `size` items (bytes or words) has one anchor: the k-gram with the least
hash inside it. Equal windows have equal anchors, so all places of a window meet at the
hash of its anchor. The windows of one anchor start at consecutive places; the text they
cover is a stretch. Stretches are compared as wholes first, by hash: within the part of
the input that a task reads and then over all tasks. What this leaves open are stretches
that share an anchor and differ, one for each distinct stretch. Their items are cut out
of the documents and dealt out by anchor.

A stretch covers its windows and the distance to the next anchor, so open stretches are
few where texts repeat in long runs. Tasks put equal stretches of their own input
together before anything is shuffled, so a passage in a third of all documents costs a
row per task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posewatch import session
from posewatch.llm import tables, words

PIECE = 1 << 21  # items worked on at once
HELD = 400_000  # stretches that a task compares among themselves
LEAST_ID = -(1 << 63)  # stands for a null id

Cut = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def byte_items(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, the first item of each text, and a hash for each item."""
    data, offsets = words.buffers(column)
    return data, offsets, words._BYTES[data]


def word_items(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = words.words(column, lower=False)
    return w.hashes, w.begin, w.hashes


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of `n` items, built from runs of doubled length."""
    out, have, base, built = h, 1, {1: words._BASE}, {1: h}
    while have * 2 <= n:
        out = out[:-have] * base[have] + out[have:]
        base[have * 2] = np.uint64(int(base[have]) ** 2 & (1 << 64) - 1)
        have *= 2
        built[have] = out
    for part in sorted(built, reverse=True)[1:]:
        if n - have >= part:
            tail = built[part][have:]
            m = min(len(out), len(tail))
            out = out[:m] * base[part] + tail[:m]
            have += part
    return words.mix(out)


def stretches(h: np.ndarray, size: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, first start and number of windows of each stretch of a sequence."""
    none = np.zeros(0, np.int64)
    if len(h) < size:
        return none.view(np.uint64), none, none
    g = run_hashes(h, k)
    place = np.arange(len(g), dtype=np.uint64)
    # the place in the low bits makes the leftmost of equal hashes the least
    low = (g & ~np.uint64(PIECE * 2 - 1)) | place
    have, width = 1, size - k + 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    anchor = (low & np.uint64(PIECE * 2 - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return g[anchor[first]], first, np.diff(np.r_[first, len(anchor)])


def stretch_table(docs: DataFrame, id_col: str, text_col: str, cut: Cut, size: int, k: int, earliest: bool) -> DataFrame:
    """Stretches (anchor, whole, doc, at, n). A null anchor marks a stretch whose windows
    are all repeated, found within a task; its equal that goes on is in the table too.

    `earliest`: only places after the first count as repeated.
    """
    schema = "anchor long, whole long, doc long, at int, n int"

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        anchor, whole, doc, at, n = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((at, doc, whole, anchor))
        # of repeated rows, which have equal places, only one is kept
        fresh = np.zeros(len(order), bool)
        fresh[:1] = True
        for x in (anchor, whole, doc, at):
            fresh[1:] |= x[order][1:] != x[order][:-1]
        order = order[fresh]
        a, w, d, p = anchor[order], whole[order], doc[order], at[order]
        same = np.r_[False, (a[1:] == a[:-1]) & (w[1:] == w[:-1])][: len(order)]
        repeated = same if earliest else same | np.r_[same[1:], False]
        goes_on = ~same
        count = n[order]
        parts = [(a[goes_on], w[goes_on], d[goes_on], p[goes_on], count[goes_on], None)]
        parts.append((None, None, d[repeated], p[repeated], count[repeated], repeated.sum()))
        columns = []
        for j, kind in enumerate((np.uint64, np.uint64, np.int64, np.int32, np.int32)):
            live = pa.array(parts[0][j].view(np.int64) if kind is np.uint64 else parts[0][j].astype(kind))
            dead = pa.nulls(int(parts[1][5]), pa.int64()) if parts[1][j] is None else pa.array(parts[1][j].astype(kind))
            columns.append(pa.concat_arrays([live, dead]))
        return pa.RecordBatch.from_arrays(columns, ["anchor", "whole", "doc", "at", "n"])

    def batches(it):
        rows, held = [], 0
        for batch in it:
            ids = batch.column(0).fill_null(LEAST_ID).to_numpy(zero_copy_only=False)
            _, begin, h = cut(batch.column(1))
            for i, doc in enumerate(ids):
                own = h[begin[i] : begin[i + 1]]
                for from_ in range(0, max(len(own) - size + 1, 0), PIECE):
                    piece = own[from_ : from_ + PIECE + size - 1]
                    anchor, first, n = stretches(piece, size, k)
                    last = first + n + size - 1
                    whole = spans_hash(piece, first, last)
                    rows.append((anchor, whole, np.full(len(first), doc), first + from_, n))
                    held += len(first)
            if held > HELD:
                yield settle(rows)
                rows, held = [], 0
        if rows:
            yield settle(rows)

    tables.bounded(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(batches, schema)


def spans_hash(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the spans [first, last) of a sequence of hashes."""
    up, down = words._powers(1 << max(20, int(len(h)).bit_length()))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return words.mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


def compared(table: DataFrame, earliest: bool) -> tuple[DataFrame, DataFrame]:
    """Repeated stretches (doc, at, n) and open ones (anchor, doc, at, n).

    A written table feeds both, so the stretches are found and shuffled once. Tasks that
    read repeated rows bring equal places, which count once.
    """
    live = table.where("anchor is not null")
    by_anchor, by_whole = Window.partitionBy("anchor"), Window.partitionBy("anchor", "whole")
    in_order = by_whole.orderBy("doc", "at")
    again = (F.lag("doc").over(in_order) == F.col("doc")) & (F.lag("at").over(in_order) == F.col("at"))
    judged = (
        live.withColumn("first", F.dense_rank().over(in_order))
        .withColumn("again", F.coalesce(again, F.lit(False)))
        .withColumn("places", F.max("first").over(by_whole))
        .withColumn("differ", F.min("whole").over(by_anchor) < F.max("whole").over(by_anchor))
        .where("not again and (places > 1 or differ)")
        .select(
            "anchor", "doc", "at", "n",
            (F.col("first") > 1 if earliest else F.col("places") > 1).alias("repeated"),
            (F.col("differ") & (F.col("first") == 1)).alias("open"),
        )
    )
    early = table.where("anchor is null").select(
        "anchor", "doc", "at", "n", F.lit(True).alias("repeated"), F.lit(False).alias("open")
    )
    judged = session.materialise(judged.union(early), "stretches")
    return judged.where("repeated").select("doc", "at", "n"), judged.where("open").select("anchor", "doc", "at", "n")


def grouped(table: DataFrame, *columns: str) -> DataFrame:
    """One row for each document: the columns as parallel lists, in order of place.

    The lists of a document are no longer than its text.
    """
    rows = table.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    return rows.select(F.col("doc").alias("_doc"), *(F.col("rows")[c].alias(f"_{c}") for c in columns))


def with_lists(docs: DataFrame, id_col: str, text_col: str, lists: DataFrame, how: str) -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID))
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), key.alias("_key")).join(
        lists, F.col("_key") == F.col("_doc"), how
    )


def removed(batch: pa.RecordBatch, at: int, i: int, size: int, n_items: int) -> np.ndarray:
    """Mask of the items covered by the repeated windows of row `i`; the columns `at` and
    `at + 1` hold first starts and numbers of windows."""
    mask = np.zeros(n_items + 1, np.int64)
    starts = batch.column(at)[i].values
    if starts is not None and len(starts):
        first = starts.to_numpy()
        n = batch.column(at + 1)[i].values.to_numpy()
        keep = first + n + size - 1 <= n_items  # rows of equal id may have other texts
        np.add.at(mask, first[keep], 1)
        np.add.at(mask, (first + n + size - 1)[keep], -1)
    return np.cumsum(mask)[:-1] > 0
