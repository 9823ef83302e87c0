"""Removal of repeated word windows by relative Lempel-Ziv parsing (free style).

A word goes if a window of `SIZE` words over it also starts at another place, in any
document. `anchors` deals out stretches of text so that all places of a window meet in
one shard, and settles whole equal stretches by hash. The stretches of a shard are its
reference block, indexed by the hash of every window. Each stretch is parsed against the
block of every shard it was dealt to: at a start whose window the index has at another
place, the factor is extended to its longest match; its windows are repeated, and parsing
goes on with the first window that crosses the end of the factor, one place at a time
until the next match. So windows over the border of two factors are looked up one by one.
All stretches of a shard are parsed in step.

A shard that has too many words for one anchor is cut; the windows that found no partner
in it are compared between shards by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posewatch import session
from posewatch.llm import anchors, tables, words
from posewatch.llm.suffix_array import runs

SIZE = 35
GRAM = 8
SHARD = 1 << 19  # words in one shard


def parse(block: np.ndarray, window: np.ndarray, begin: np.ndarray, count: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """Mask of the windows of the stretches that occur at another place of the block.

    `block` are the words of all stretches, with a separator after each, `window` the
    hash of the window at each word, `begin` and `count` the first window of each stretch
    and their number, `place` a number for each place in the input.
    """
    starts = np.concatenate([np.arange(b, b + c) for b, c in zip(begin, count, strict=True)]) if len(begin) else begin
    index = starts[np.lexsort((place[starts], window[starts]))]
    keys = window[index]
    hit = np.zeros(len(block), bool)
    # First and last entry of each hash: a partner is one with another place.
    at, end = begin.copy(), begin + count
    live = np.flatnonzero(at < end)
    while len(live):
        here = at[live]
        low = np.searchsorted(keys, window[here], "left")
        high = np.searchsorted(keys, window[here], "right") - 1
        partner = np.where(place[index[low]] != place[here], index[low], index[high])
        found = place[partner] != place[here]
        go, to = here[found], partner[found]
        length = np.full(len(go), size)
        grow = np.arange(len(go))
        while len(grow):
            # a factor ends at the end of either stretch: separators differ from all words
            grow = grow[block[go[grow] + length[grow]] == block[to[grow] + length[grow]]]
            length[grow] += 1
        edge = np.zeros(len(block) + 1, np.int64)
        np.add.at(edge, go, 1)
        np.add.at(edge, go + length - size + 1, -1)
        hit |= np.cumsum(edge)[:-1] > 0
        step = np.ones(len(here), np.int64)
        step[found] = length - size + 1
        at[live] += step
        live = live[at[live] < end[live]]
    return hit


def cut_out(docs: DataFrame, id_col: str, text_col: str, open_: DataFrame, size: int) -> DataFrame:
    """Words of the open stretches as packed hashes: anchor, doc, at, words."""
    lists = anchors.grouped(open_, "at", "n", "anchor")
    rows = anchors.with_lists(docs, id_col, text_col, lists, "inner").select("_text", "_key", "_at", "_n", "_anchor")

    def batches(it):
        for batch in it:
            w = words.words(batch.column(0), lower=False)
            keys = batch.column(1).to_numpy()
            for i in range(batch.num_rows):
                at, n, anchor = (batch.column(j)[i].values.to_numpy() for j in (2, 3, 4))
                own = w.of(i)
                last = at + n + size - 1
                keep = last <= len(own)
                cut = [own[a:b].tobytes() for a, b in zip(at[keep], last[keep], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[keep]), pa.array(np.full(len(cut), keys[i])), pa.array(at[keep]), pa.array(cut, pa.binary())],
                    ["anchor", "doc", "at", "words"],
                )

    tables.bounded(docs.sparkSession)
    return rows.mapInArrow(batches, "anchor long, doc long, at int, words binary")


def parsed_shards(stretches: DataFrame, size: int, shard: int) -> DataFrame:
    """Repeated windows (doc, at, n, no string) of every shard, and of cut anchors the
    distinct windows (doc, at, 1, string) for comparison with other shards."""
    schema = "doc long, at int, n int, string long"

    def solve(rows: list[tuple], cut: set[int]):
        parts = [np.frombuffer(r[3], np.uint64) for r in rows]
        lengths = np.array([len(p) + 1 for p in parts])
        begin = np.r_[0, np.cumsum(lengths)][:-1]
        block = np.concatenate([np.r_[p, np.uint64(i)] for i, p in enumerate(parts)])
        block = np.r_[block, np.uint64(len(parts))]
        count = lengths - size
        owner = np.repeat(np.arange(len(parts)), lengths)
        doc, at = np.array([r[1] for r in rows])[owner], np.array([r[2] for r in rows])[owner]
        at = at + np.arange(len(owner)) - begin[owner]
        window = np.zeros(len(block), np.uint64)
        h = anchors.run_hashes(block, size)
        window[: len(h)] = h
        _, place = np.unique(np.rec.fromarrays([doc, at]), return_inverse=True)
        hit = parse(block, window, begin, count, np.r_[place, -1], size)[:-1]
        d, p, n = runs(doc[hit], at[hit])
        yield pa.RecordBatch.from_arrays(
            [pa.array(d, pa.int64()), pa.array(p, pa.int32()), pa.array(n, pa.int32()), pa.nulls(len(d), pa.int64())],
            ["doc", "at", "n", "string"],
        )
        for a in cut:
            mine = np.flatnonzero((np.array([r[0] for r in rows]) == a)[owner] & (np.arange(len(owner)) - begin[owner] < count[owner]))
            _, one = np.unique(window[mine], return_index=True)
            mine = mine[one]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[mine], pa.int64()), pa.array(at[mine], pa.int32()), pa.array(np.ones(len(mine)), pa.int32()), pa.array(window[mine].view(np.int64))],
                ["doc", "at", "n", "string"],
            )

    def batches(it):
        rows, held, cut = [], 0, set()
        for batch in it:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held > shard:
                    if rows[-1][0] == row[0]:
                        cut.add(row[0])
                    yield from solve(rows, cut)
                    cut = {row[0]} if rows[-1][0] == row[0] else set()
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3]) // 8
        if rows:
            yield from solve(rows, cut)

    parts = stretches.repartition("anchor").sortWithinPartitions("anchor", "doc", "at")
    return session.materialise(parts.mapInArrow(batches, schema), "shards")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, shard: int = SHARD
) -> DataFrame:
    """Words of every document without those of repeated windows.

    Returns `id_col`, `n_words`, `kept` (kept words joined by one space) and `spans`, the
    maximal removed runs as (start, end) in words, one row for each input row. A null or
    empty text has no words; a text of fewer than `size` words stays whole. Rows of equal
    id are places of one document: the same start in two of them is one place. A null id
    is a document of its own. Empty tables give no rows; other columns are not looked at.
    """
    table = anchors.stretch_table(docs, id_col, text_col, anchors.word_items, size, GRAM, earliest=False)
    repeated, open_ = anchors.compared(table, earliest=False)
    shards = parsed_shards(cut_out(docs, id_col, text_col, open_, size), size, shard)
    cut = shards.where("string is not null")
    shared = cut.groupBy("string").agg(F.min(F.struct("doc", "at")).alias("lo"), F.max(F.struct("doc", "at")).alias("hi"))
    between = cut.join(shared.where("lo < hi").select("string"), "string", "left_semi").select("doc", "at", "n")
    found = repeated.union(shards.where("string is null").select("doc", "at", "n")).union(between)
    lists = anchors.grouped(session.materialise(found, "repeated"), "at", "n")
    rows = anchors.with_lists(docs, id_col, text_col, lists, "left").select("_id", "_text", "_at", "_n")
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_words long, kept string, spans array<struct<start:int,end:int>>"
    out_schema = tables.arrow_schema(docs.sparkSession, schema)

    def batches(it):
        for batch in it:
            w = words.words(batch.column(1), lower=False)
            n_words, kept, spans = [], [], []
            for i in range(batch.num_rows):
                own = w.text(i).tobytes().split()  # ASCII white space is what parts words
                gone = anchors.removed(batch, 2, i, size, len(own))
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                if len(edge):
                    own_kept = [x for x, g in zip(own, gone, strict=True) if not g]
                else:
                    own_kept = own
                n_words.append(len(own))
                kept.append(b" ".join(own_kept).decode())
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(out_schema.field(0).type), pa.array(n_words, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, out_schema.field(3).type)],
                schema=out_schema,
            )

    return rows.mapInArrow(batches, schema)
