"""Removal of repeated byte strings with suffix arrays (free style).

A byte goes if a string of `SIZE` bytes over it also starts earlier, in a document of
smaller id or earlier in the same one. `anchors` deals out the stretches of text that may
hold such strings, so that all places of a string meet in one shard, and settles whole
equal stretches by hash. A shard then concatenates its stretches and

1. sorts their suffixes by Larsson and Sadakane's refinement: ranks by 8 bytes, then
   groups of equal rank only are sorted again by the rank h places on, and h doubles;
2. finds the common prefixes of neighbours by Kasai's scan, run over all stretches of
   the shard in step;
3. takes every run of neighbours with `SIZE` or more common bytes as one string, whose
   least place stays.

An anchor with more text than a shard holds is cut into several shards. Each gives its
distinct strings as a sorted run, cut at fixed points by binary search; the runs of one
range are merged by binary search in each other, and the least place wins.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posewatch import session
from posewatch.llm import anchors, tables, words

SIZE = 100
GRAM = 16
SHARD = 2 << 20  # bytes of text in one shard
RANGES = 16  # parts of the runs of one anchor that are merged apart


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order. The order is total, as the scan for common prefixes needs it."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | wide[i : i + n]
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, np.int64)  # place of the first suffix of the group
    lead = np.r_[True, key[order][1:] != key[order][:-1]]
    rank[order] = np.flatnonzero(lead)[np.cumsum(lead) - 1]
    h = 8
    while h < n:
        alone = lead & np.r_[lead[1:], True]
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        suffix = order[places]
        own, next_ = rank[suffix], np.where(suffix + h < n, rank[np.minimum(suffix + h, n)] + 1, 0)
        by = np.argsort(own * np.int64(n + 2) + next_, kind="stable")
        suffix, own, next_ = suffix[by], own[by], next_[by]
        order[places] = suffix
        new = np.r_[True, (own[1:] != own[:-1]) | (next_[1:] != next_[:-1])]
        lead[places] = new
        rank[suffix] = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, begin: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Common bytes of each suffix with its predecessor in `order`, up to `most`, for the
    first `count` suffixes of the stretches at `begin`; zero for the others.

    The scan goes through all stretches in step: the next suffix of a stretch shares at
    least one byte less with its predecessor than the one before.
    """
    n = len(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    wide = np.concatenate([text, np.zeros(most + 1, np.uint8)])
    out = np.zeros(n, np.int64)
    h = np.zeros(len(begin), np.int64)
    for step in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > step)
        here = begin[live] + step
        at = place[here]
        before = order[np.maximum(at - 1, 0)]
        have = np.where(at > 0, np.maximum(h[live] - 1, 0), 0)
        grow = np.flatnonzero((at > 0) & (have < most))
        while len(grow):
            grow = grow[wide[here[grow] + have[grow]] == wide[before[grow] + have[grow]]]
            have[grow] += 1
            grow = grow[have[grow] < most]
        h[live] = have
        out[at] = have
    return out


class Shard:
    """Stretches of text; `later` is true for the windows that have an earlier equal."""

    def __init__(self, texts: list[np.ndarray], doc: np.ndarray, at: np.ndarray, size: int):
        lengths = np.array([len(t) + 1 for t in texts])
        self.text = np.concatenate([np.r_[t + 1, np.uint8(0)].astype(np.uint8) for t in texts])
        self.begin = np.r_[0, np.cumsum(lengths)][:-1]
        self.count = lengths - size  # windows of each stretch
        owner = np.repeat(np.arange(len(texts)), lengths)
        step = np.arange(len(self.text)) - self.begin[owner]
        order = suffix_array(self.text)
        common = common_prefixes(self.text, order, self.begin, self.count, size)
        window = step[order] < self.count[owner[order]]
        # Strings are runs of neighbours with `size` common bytes.
        string = np.cumsum(common < size)[window]
        suffix = order[window]
        d, p = doc[owner[suffix]], at[owner[suffix]] + step[suffix]
        by = np.lexsort((p, d, string))
        self.suffix, string, self.doc, self.place = suffix[by], string[by], d[by], p[by]
        same = np.r_[False, string[1:] == string[:-1]]
        lead = np.flatnonzero(~same)[np.cumsum(~same) - 1]
        self.first = ~same
        self.later = same & ((self.doc != self.doc[lead]) | (self.place != self.place[lead]))


def runs(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive places of a document as (doc, first, number)."""
    order = np.lexsort((place, doc))
    d, p = doc[order], place[order]
    if not len(d):
        return d, p, p
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)])
    last = np.r_[first[1:], len(d)] - 1
    return d[first], p[first], p[last] - p[first] + 1


def cut_out(docs: DataFrame, id_col: str, text_col: str, open_: DataFrame, size: int) -> DataFrame:
    """Text of the open stretches: anchor, doc, at, text."""
    lists = anchors.grouped(open_, "at", "n", "anchor")
    rows = anchors.with_lists(docs, id_col, text_col, lists, "inner").select("_text", "_key", "_at", "_n", "_anchor")

    def batches(it):
        for batch in it:
            data, offsets = words.buffers(batch.column(0))
            keys = batch.column(1).to_numpy()
            for i in range(batch.num_rows):
                at, n, anchor = (batch.column(j)[i].values.to_numpy() for j in (2, 3, 4))
                own = data[offsets[i] : offsets[i + 1]]
                last = at + n + size - 1
                keep = last <= len(own)
                texts = [own[a:b].tobytes() for a, b in zip(at[keep], last[keep], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[keep]), pa.array(np.full(len(texts), keys[i])), pa.array(at[keep]), pa.array(texts, pa.binary())],
                    ["anchor", "doc", "at", "text"],
                )

    tables.bounded(docs.sparkSession)
    return rows.mapInArrow(batches, "anchor long, doc long, at int, text binary")


def sorted_shards(stretches: DataFrame, size: int, shard: int) -> DataFrame:
    """Repeated windows (doc, at, n) of every shard, and the sorted runs of cut anchors
    (anchor, part, strings, docs, places as packed numbers)."""
    schema = "doc long, at int, n int, anchor long, part int, strings binary, docs binary, places binary"

    def solve(rows: list[tuple], cut: set[int]):
        anchor = np.array([r[0] for r in rows])
        texts = [np.frombuffer(r[3], np.uint8) for r in rows]
        s = Shard(texts, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), size)
        d, p, n = runs(s.doc[s.later], s.place[s.later])
        out = {"doc": pa.array(d, pa.int64()), "at": pa.array(p, pa.int32()), "n": pa.array(n, pa.int32())}
        blank = {c: pa.nulls(len(d), t) for c, t in (("anchor", pa.int64()), ("part", pa.int32()), ("strings", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()))}
        yield pa.RecordBatch.from_pydict(out | blank)
        for a in cut:
            # The windows that stay so far, as a run sorted by the hash of the string.
            owner = np.searchsorted(s.begin, s.suffix, "right") - 1
            mine = s.first & (anchor[owner] == a)
            h = anchors.run_hashes(words._BYTES[s.text], size)[s.suffix[mine]]
            order = np.argsort(h)
            h, doc, place = h[order], s.doc[mine][order], s.place[mine][order]
            edges = np.searchsorted(h, np.arange(1, RANGES, dtype=np.uint64) * np.uint64((1 << 64) // RANGES))
            bounds = [0, *edges.tolist(), len(h)]
            rows_ = [
                {"anchor": a, "part": j, "strings": h[x:y].tobytes(), "docs": doc[x:y].tobytes(), "places": place[x:y].astype(np.int64).tobytes()}
                for j, (x, y) in enumerate(pairwise(bounds)) if y > x
            ]
            yield pa.RecordBatch.from_pylist([{"doc": None, "at": None, "n": None} | r for r in rows_], tables_schema)

    tables_schema = tables.arrow_schema(stretches.sparkSession, schema)

    def batches(it):
        rows, held, cut = [], 0, set()
        for batch in it:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held > shard:
                    # A shard ends between anchors, or else inside one that is cut.
                    if rows[-1][0] == row[0]:
                        cut.add(row[0])
                    yield from solve(rows, cut)
                    cut = {row[0]} if rows[-1][0] == row[0] else set()
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3])
        if rows:
            yield from solve(rows, cut)

    parts = stretches.repartition("anchor").sortWithinPartitions("anchor", "doc", "at")
    return session.materialise(parts.mapInArrow(batches, schema), "shards")


def merged_runs(shards: DataFrame) -> DataFrame:
    """Windows (doc, at, n) that are not the least place of their string over all shards
    of a cut anchor."""

    def merge(key, pieces):
        text = doc = place = None
        lost: list[tuple[np.ndarray, np.ndarray]] = []
        for piece in pieces:
            for row in piece.to_pylist():
                h = np.frombuffer(row["strings"], np.uint64)
                d, p = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["places"], np.int64)
                if text is None:
                    text, doc, place = h.copy(), d.copy(), p.copy()
                    continue
                at = np.minimum(np.searchsorted(text, h), len(text) - 1)
                same = text[at] == h
                t = at[same]
                less = (d[same] < doc[t]) | ((d[same] == doc[t]) & (p[same] < place[t]))
                other = ~less & ((d[same] != doc[t]) | (p[same] != place[t]))
                lost.append((doc[t][less], place[t][less]))
                lost.append((d[same][other], p[same][other]))
                doc[t[less]], place[t[less]] = d[same][less], p[same][less]
                where = np.searchsorted(text, h[~same])
                text = np.insert(text, where, h[~same])
                doc, place = np.insert(doc, where, d[~same]), np.insert(place, where, p[~same])
        docs = np.concatenate([x for x, _ in lost]) if lost else np.zeros(0, np.int64)
        places = np.concatenate([x for _, x in lost]) if lost else np.zeros(0, np.int64)
        d, p, n = runs(docs, places)
        return pa.table({"doc": pa.array(d, pa.int64()), "at": pa.array(p, pa.int32()), "n": pa.array(n, pa.int32())})

    def one(key, table):
        return merge(key, table.to_batches())

    return (
        shards.where("anchor is not null")
        .groupBy("anchor", "part")
        .applyInArrow(one, "doc long, at int, n int")
    )


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, shard: int = SHARD
) -> DataFrame:
    """Bytes of every document without those of repeated strings.

    Returns `id_col`, `n_bytes`, `kept` (binary) and `spans`, the maximal removed runs as
    (start, end) in bytes, one row for each input row. A null text is empty and a null id
    comes before all others; a text shorter than `size` stays. Rows of equal id are
    places of one document: the same start in two of them is one place, and of different
    texts all are looked at. Empty tables give no rows; other columns are not looked at.
    """
    table = anchors.stretch_table(docs, id_col, text_col, anchors.byte_items, size, GRAM, earliest=True)
    repeated, open_ = anchors.compared(table, earliest=True)
    shards = sorted_shards(cut_out(docs, id_col, text_col, open_, size), size, shard)
    found = repeated.union(shards.where("doc is not null").select("doc", "at", "n")).union(merged_runs(shards))
    lists = anchors.grouped(session.materialise(found, "repeated"), "at", "n")
    rows = anchors.with_lists(docs, id_col, text_col, lists, "left").select("_id", "_text", "_at", "_n")
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_bytes long, kept binary, spans array<struct<start:int,end:int>>"
    out_schema = tables.arrow_schema(docs.sparkSession, schema)

    def batches(it):
        for batch in it:
            data, offsets = words.buffers(batch.column(1))
            n_bytes, kept, spans = [], [], []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                gone = anchors.removed(batch, 2, i, size, len(own))
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                n_bytes.append(len(own))
                kept.append(own[~gone].tobytes())
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(out_schema.field(0).type), pa.array(n_bytes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, out_schema.field(3).type)],
                schema=out_schema,
            )

    return rows.mapInArrow(batches, schema)
