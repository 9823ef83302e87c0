"""Alignment of the tokens that two tokenizers give for the same text (free style).

Both token lists spell the same bytes. Each list's cumulative ends go into a dictionary
from end to index; the ends that both dictionaries hold, in order, cut the two lists into
groups, and within a group every token of one list is linked with every one of the other.

How many documents hold a linked pair is a corpus-wide count. A task collects the
documents of some two million tokens as a chunk, lists each pair of the chunk once with
the number of its documents, and keeps a document's pairs as positions in that list. What
is shuffled by pair is therefore one row per chunk and pair, also for a pair that every
document holds; the counts go back to their chunk, whose documents look them up there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posewatch.llm import byte_tokens, tables
from posewatch.session import materialise

CHUNK_TOKENS = 2_000_000
# Groups with more links than this are expanded by distinct ids instead of by token.
WIDE = 1 << 16
_FOUND = (
    "n_a long, n_b long, n_groups long, n_links long, groups string, chunk long, _at binary, _times binary, "
    "_pairs array<long>, _docs array<long>"
)


class PieceTokens:
    """Ids of a sentencepiece model and the bytes that each id stands for."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes_of.append(
                bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
            )

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = byte_tokens.load(byte_path, False), PieceTokens(piece_path)
        self.size_a = np.array([len(x) for x in self.a.bytes_of], np.int64)
        self.size_b = np.array([len(x) for x in self.b.bytes_of], np.int64)
        self.n_b = len(self.size_b)
        self.shift = (len(self.size_a) * self.n_b).bit_length()
        # Id and the mark after it (inside a group, between its sides, after the group) as
        # bytes, each in a row that zeros fill up.
        self.most = max(len(self.size_a), self.n_b)
        self.marked = np.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(self.most)])
        self.marked = self.marked.view(np.uint8).reshape(len(self.marked), -1)

    def cuts(self, text: str, ids_b: list[int]):
        """Ids of both sides and the index after each group's last token; None if the
        sides do not spell space and text.

        The byte vocabulary has all bytes and no normaliser, so its ids cut the text as it is
        and only their length is checked.
        """
        raw = b" " + text.encode()
        if b"".join(map(self.b.bytes_of.__getitem__, ids_b)) != raw:
            return None
        ids_a, ids_b = self.a.encode(" " + text).astype(np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = self.size_a[ids_a].cumsum(), self.size_b[ids_b].cumsum()
        if ends_a[-1] != len(raw):
            return None
        index_a = dict(zip(ends_a.tolist(), range(1, len(ids_a) + 1), strict=True))
        index_b = dict(zip(ends_b.tolist(), range(1, len(ids_b) + 1), strict=True))
        ends = sorted(index_a.keys() & index_b.keys())
        n = len(ends)
        return (
            ids_a, ids_b,
            np.fromiter(map(index_a.__getitem__, ends), np.int64, n), np.fromiter(map(index_b.__getitem__, ends), np.int64, n),
        )

    def groups_text(self, ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> bytes:
        """`a1,a2|b1;a3|b2,b3`: each id is put where its group and side have it."""
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        shown_a, shown_b = ids_a.copy(), ids_b.copy()
        shown_a[cut_a - 1] += self.most
        shown_b[cut_b - 1] += 2 * self.most
        out[np.arange(len(ids_a)) + np.repeat(np.r_[0, cut_b[:-1]], np.diff(cut_a, prepend=0))] = shown_a
        out[np.arange(len(ids_b)) + np.repeat(cut_a, np.diff(cut_b, prepend=0))] = shown_b
        shown = self.marked[out]
        return shown[shown > 0].tobytes()[:-1]

    def links(self, found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text its number of links; and (text, pair, times) of each text's distinct pairs, sorted."""
        a, b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        sizes = np.array([(len(x[0]), len(x[1]), len(x[2])) for x in found], np.int64)
        before = sizes.cumsum(axis=0) - sizes
        end_a, end_b = (np.concatenate([x[i + 2] + s for x, s in zip(found, before[:, i], strict=True)]) for i in (0, 1))
        text = np.repeat(np.arange(len(found)), sizes[:, 2]) << self.shift
        start_a, start_b = np.r_[0, end_a[:-1]], np.r_[0, end_b[:-1]]
        wide_b = end_b - start_b
        n = (end_a - start_a) * wide_b
        n_links = np.add.reduceat(n, before[:, 2])
        wide = np.flatnonzero(n > WIDE)
        single = np.flatnonzero(n == 1)
        rest = np.flatnonzero((n > 1) & (n <= WIDE))
        keys = [text[single] | (a[start_a[single]] * self.n_b + b[start_b[single]])]
        group = np.repeat(rest, n[rest])
        turn, place = np.divmod(np.arange(len(group)) - np.repeat(n[rest].cumsum() - n[rest], n[rest]), wide_b[group])
        keys.append(text[group] | (a[start_a[group] + turn] * self.n_b + b[start_b[group] + place]))
        keys, times = np.unique(np.concatenate(keys), return_counts=True)
        if len(wide):
            more_keys, more_times = [keys], [times]
            for g in wide:
                ua, ca = np.unique(a[start_a[g] : end_a[g]], return_counts=True)
                ub, cb = np.unique(b[start_b[g] : end_b[g]], return_counts=True)
                more_keys.append((text[g] | (ua[:, None] * self.n_b + ub)).ravel())
                more_times.append((ca[:, None] * cb).ravel())
            keys, where = np.unique(np.concatenate(more_keys), return_inverse=True)
            times = np.zeros(len(keys), np.int64)
            np.add.at(times, where, np.concatenate(more_times))
        return n_links, keys >> self.shift, keys & ((1 << self.shift) - 1), times


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def packed(x: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """Non-negative numbers below 2^35, seven bits a byte, as one string for each stretch."""
    size = 1 + sum((x >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    at = size.cumsum() - size
    out = np.zeros(int(size.sum()), np.uint8)
    for j in range(5):
        some = size > j
        out[at[some] + j] = (x[some] >> 7 * j & 127) | ((size[some] > j + 1) << 7)
    ends = np.r_[at, len(out)][cuts].tolist()
    data = out.tobytes()
    return [data[s:e] for s, e in zip(ends, ends[1:], strict=False)]


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.r_[0, last[:-1] + 1] if len(last) else last
    out = np.zeros(len(last), np.int64)
    for j in range(5):
        some = first + j <= last
        out[some] |= (raw[first[some] + j] & 127).astype(np.int64) << 7 * j
    return out


def group(df: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of both tokenizers' ids for every whole text.

    Rows of documents have `id_col`, n_a, n_b, n_groups, n_links and `groups`, the decimal
    ids as `a1,a2|b1;a3|b2,b3`. Between them are rows of pairs for `count_links`, whose
    `_pairs` is not null; these and the other internal columns are stable once written.
    Texts that are null or empty, or that one tokenizer does not spell out byte for byte
    (with a space before them), have zeros and empty groups. Every row is a document;
    other columns are not looked at; an empty table gives no rows.
    """
    tables.bounded(df.sparkSession)
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, {_FOUND}"
    types = tables.arrow_schema(df.sparkSession, schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=types)

    def flushed(both: Aligner, held: list[tuple], chunk: int) -> Iterator[pa.RecordBatch]:
        n_links, text, pair, times = both.links([x[1] for x in held])
        pairs, at, docs = np.unique(pair, return_inverse=True, return_counts=True)
        ids_a, ids_b = np.divmod(pairs, both.n_b)
        cuts = np.searchsorted(text, np.arange(len(held) + 1))
        gaps = np.diff(at, prepend=0)
        gaps[cuts[:-1]] = at[cuts[:-1]]
        rows = []
        for (key, (a, b, ends, _), shown), n, x, m in zip(held, n_links.tolist(), packed(gaps, cuts), packed(times, cuts), strict=True):
            rows.append((key, len(a), len(b), len(ends), n, shown, chunk, x, m, None, None))
        for lo in range(0, len(rows), 500):
            yield batch_of(rows[lo : lo + 500])
        yield batch_of([(None,) * 6 + (chunk, None, None, ids_a << 32 | ids_b, docs)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_path, piece_path)
        chunk = TaskContext.get().partitionId() << 32
        held, tokens = [], 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bare = []
            for key, text, ids_b in zip(batch.column(0).to_pylist(), texts, both.b.encode(texts), strict=True):
                found = both.cuts(text, ids_b) if text else None
                if found is None:
                    bare.append((key, 0, 0, 0, 0, "", None, None, None, None, None))
                    continue
                held.append((key, found, both.groups_text(*found)))
                tokens += len(found[0])
                if tokens >= CHUNK_TOKENS:
                    yield from flushed(both, held, chunk)
                    held, tokens, chunk = [], 0, chunk + 1
            if bare:
                yield batch_of(bare)
        if held:
            yield from flushed(both, held, chunk)

    return df.select(id_col, text_col).mapInArrow(work, schema)


def count_links(found: DataFrame) -> DataFrame:
    """Add n_best and count_sum to the written rows of `group`; further columns stay.

    A pair counts each document that holds it linked, however often; n_best are the links
    whose pair has the highest count of its first id, ties included. Rows of pairs go.
    """
    lists = found.where(F.col("_pairs").isNotNull())
    here = lists.select("chunk", F.posexplode(F.arrays_zip("_pairs", "_docs")).alias("at", "x")).select(
        "chunk", "at", F.col("x._pairs").alias("pair"), F.col("x._docs").alias("docs")
    )
    first = Window.partitionBy("first")
    counted = (
        here.groupBy("pair").agg(F.sum("docs").alias("n"))
        .withColumn("first", F.shiftright("pair", 32))
        .select("pair", "n", (F.col("n") == F.max("n").over(first)).alias("best"))
    )
    values = here.join(counted, "pair").select(F.col("chunk").alias("_chunk"), "at", "n", "best")
    docs = found.where(F.col("_pairs").isNull()).drop("_pairs", "_docs")
    shown = docs.drop("chunk", "_at", "_times").columns
    schema = docs.select(*shown).schema.add("n_best", "long").add("count_sum", "long")

    def look_up(rows: pa.Table, counts: pa.Table) -> pa.Table:
        at = counts.column("at").to_numpy()
        n, best = np.zeros((2, len(at)), np.int64)
        n[at] = counts.column("n").to_numpy()
        best[at] = counts.column("best").to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for gaps, times in zip(rows.column("_at").to_pylist(), rows.column("_times").to_pylist(), strict=True):
            where, times = unpacked(gaps).cumsum(), unpacked(times)
            n_best.append(int((times * best[where]).sum()))
            count_sum.append(int((times * n[where]).sum()))
        out = [rows.column(c) for c in shown] + [pa.array(x, pa.int64()) for x in (n_best, count_sum)]
        return pa.Table.from_arrays(out, [*shown, "n_best", "count_sum"])

    with_links = docs.where(F.col("chunk").isNotNull()).groupBy("chunk").cogroup(values.groupBy("_chunk"))
    none = F.lit(0).cast("long")
    return with_links.applyInArrow(look_up, schema).unionByName(
        docs.where(F.col("chunk").isNull()).select(*shown, none.alias("n_best"), none.alias("count_sum"))
    )


def align(df: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of every text with its links' counts; see `group` and `count_links`."""
    return count_links(materialise(group(df, byte_path, piece_path, id_col, text_col), "alignment"))
