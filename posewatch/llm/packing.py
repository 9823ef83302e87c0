"""Packing of documents into sequences of a fixed number of tokens (free style).

Each task encodes its own texts, cuts documents that are longer than a sequence, and
numbers its pieces of each length. What packing needs to know is how many pieces of each
length there are, a table of at most `capacity` rows. From it the driver works out the
patterns of lengths by bin completion (`bin_completion`); their number does not grow with
the documents. A piece's number among all pieces of its length then gives its sequence
and its place there by arithmetic, so pieces never come together in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posewatch.llm import bin_completion, byte_tokens, tables
from posewatch.session import materialise

CAPACITY = 1024
END_ID = 2
# Bytes of ids in an Arrow batch that goes back to Spark, beyond one piece.
BATCH_BYTES = 4 << 20
_PIECE = "piece int, start long, length int, ids binary, part int, number long"


def cut(
    df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of every whole text, each with its ids as little-endian unsigned 32-bit numbers.

    A document is its ids and then `end_id`. Only one longer than `capacity` is cut: its
    last pieces are full, its first one holds the rest. Returns `id_col`, piece (from 0),
    start, length, ids, and (part, number): the task and the piece's number among the
    task's pieces of its length. Write the result before it is used further, for these
    two are stable only then. A null text counts as empty and gives `end_id` alone; every
    row is a document; other columns are not looked at; an empty table gives no rows.
    """
    spark = df.sparkSession
    tables.bounded(spark)
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, {_PIECE}"
    types = tables.arrow_schema(spark, schema)
    end = np.array([end_id], np.uint32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_tokens.load(path, True).encode
        part, numbers = TaskContext.get().partitionId(), defaultdict(int)
        out, held = [], 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), types, strict=True)], schema=types)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encode(text or ""), end]).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                ends = range(first, len(ids) + 1, capacity)
                for piece, stop in enumerate(ends):
                    start = 0 if not piece else stop - capacity
                    n = stop - start
                    out.append((key, piece, start, n, ids[start:stop].tobytes(), part, numbers[n]))
                    numbers[n] += 1
                    held += 4 * n
                    if held >= BATCH_BYTES:
                        yield flushed()
                        out, held = [], 0
        if out:
            yield flushed()

    return df.select(id_col, text_col).mapInArrow(work, schema)


class Places:
    """Where the k-th piece of a length goes, from the patterns."""

    def __init__(self, patterns: list[tuple[int, bin_completion.Pattern]]):
        given: dict[int, int] = defaultdict(int)
        rows, sequence = [], 0
        for bins, pattern in patterns:
            offset = 0
            for length, times in pattern:
                rows.append((length, given[length], sequence, times, offset))
                given[length] += bins * times
                offset += length * times
            sequence += bins
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.key = table[:, 0] << 48 | table[:, 1]
        self.first, self.sequence, self.times, self.offset = table[:, 1:].T

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length, rank = length.astype(np.int64), rank.astype(np.int64)
        at = np.searchsorted(self.key, length << 48 | rank, "right") - 1
        turn, place = np.divmod(rank - self.first[at], self.times[at])
        return self.sequence[at] + turn, self.offset[at] + place * length


def place(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = bin_completion.NODES) -> DataFrame:
    """Add sequence_id and offset to written pieces (length, part, number, any others).

    Pieces of one sequence follow each other without a gap from 0. An empty table stays empty.
    """
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    by_part = materialise(by_part, "packing-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(bin_completion.solve(counts, capacity, nodes))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    ranked = pieces.join(before, ["length", "part"]).select(
        *[c for c in pieces.columns if c not in ("part", "number")], (F.col("number") + F.col("_before")).alias("_rank")
    )
    kept = ranked.drop("_rank").columns
    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places(*(batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "_rank")))
            columns = [batch.column(c) for c in kept] + [pa.array(x, pa.int64()) for x in found]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(work, schema)


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their ids, sequence and place; see `cut` and `place`."""
    return place(materialise(cut(df, path, capacity, end_id, id_col, text_col), "packing-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the pieces of each sequence, joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda out, x: F.concat(out, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").cast("long").alias("n_tokens"), joined.alias("ids"))
