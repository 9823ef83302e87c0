"""Ordered scans in two passes, whatever share of the table one key holds.

A plain window puts every row of a key into one task. Here the rows are dealt by ranges
of (key, order, tie-breaker), so a hot key spreads over as many tasks as its size asks
for, a small one stays whole, and rows of one order value can be parted. Each task scans
its own sorted rows and writes them with the result so far; its last row also carries the
state of its last key. Only a task's first key can have begun in an earlier task, so
there is at most one carry per task. The carries are folded over these few rows, broadcast
(two values a task), and added in the second pass, which shuffles nothing.

Tables of up to ``WINDOW_ROWS`` rows take a plain window, which is quicker and no risk there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from posewatch.session import materialise

WINDOW_ROWS = 1_000_000
_PART, _LEAD, _FIRST, _LAST, _LOCAL, _VALUE, _TOTAL = (
    "__part", "__lead", "__first", "__last", "__local", "__value", "__total",
)


@dataclass(frozen=True)
class _Scan:
    """A running result: over one task's rows, its carry, and both together.

    ``local`` gets the values of a batch (masked), the start of each row's stretch of
    equal keys, and the state that the first stretch goes on from (None: it is new); it
    returns the results and the state after the last row.
    """

    local: Callable
    carry: Callable[[Column], Column]
    both: Callable[[Column, Column, Column], Column]
    plain: Callable


def _scalar(out: np.ma.MaskedArray):
    return None if np.ma.getmaskarray(out)[-1] else out.data[-1]


def _numbers(value, start, state):
    out = np.arange(len(start)) - start + 1
    out[start == 0] += state or 0
    return np.ma.array(out), out[-1]


def _sums(value, start, state):
    added = value.filled(0)
    run = added.cumsum()
    out = run - np.r_[0, run][start]
    out[start == 0] += state or 0
    return np.ma.array(out - added), out[-1]


def _maxima(value, start, state):
    known, rank = np.unique(value.data, return_inverse=True)
    rank = np.where(np.ma.getmaskarray(value), 0, rank + 1)
    width = len(known) + 1
    rank = np.maximum.accumulate(start * width + rank) - start * width  # a later stretch starts above
    out = np.ma.array(known[np.maximum(rank, 1) - 1], mask=rank == 0)
    if state is not None:
        own = np.flatnonzero(start == 0)
        out[own] = np.where(rank[own] == 0, state, np.maximum(out.data[own], state))
    return out, _scalar(out)


def _latest(value, start, state):
    at = np.maximum.accumulate(np.where(np.ma.getmaskarray(value), -1, np.arange(len(start))))
    none = at < start
    out = np.ma.array(value.data[at], mask=none)
    if state is not None:
        out[(start == 0) & none] = state
    return out, _scalar(out)


def _previous(value, start, state):
    out = np.ma.concatenate([np.ma.masked_all(1, value.dtype), value[:-1]])
    out[start == np.arange(len(start))] = np.ma.masked
    if state is not None:
        out[0] = state
    return out, _scalar(value)


_BEFORE, _SO_FAR = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
SCANS = {
    "number": _Scan(
        _numbers, F.sum, lambda own, carry, first: own + carry,
        lambda v, w: F.row_number().over(w).cast("long"),
    ),
    "sum_before": _Scan(
        _sums, F.sum, lambda own, carry, first: own + carry,
        lambda v, w: F.coalesce(F.sum(v).over(w.rowsBetween(*_BEFORE)), F.lit(0)),
    ),
    "maximum": _Scan(
        _maxima, F.max, lambda own, carry, first: F.greatest(own, carry),
        lambda v, w: F.max(v).over(w.rowsBetween(*_SO_FAR)),
    ),
    "latest": _Scan(
        _latest, lambda c: F.last(c, ignorenulls=True), lambda own, carry, first: F.coalesce(own, carry),
        lambda v, w: F.last(v, ignorenulls=True).over(w.rowsBetween(*_SO_FAR)),
    ),
    # Only the first row of a task can have its predecessor in another task.
    "previous": _Scan(
        _previous, F.last, lambda own, carry, first: F.when(first, carry).otherwise(own),
        lambda v, w: F.lag(v).over(w),
    ),
}


def few(df: DataFrame, rows: int) -> bool:
    """Whether the table has at most so many rows; reads little further than that."""
    return df.limit(rows + 1).count() <= rows


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    kind: str,
    name: str,
    value: Column | None = None,
    window_rows: int | None = None,
) -> DataFrame:
    """Add a running result per key, in the order of the ``order`` columns.

    ``kind`` is one of: number (dense, from 1), sum_before (of the earlier rows, from 0),
    maximum (so far), latest (value so far that is not null), previous (value of the row
    before). Values are long or double numbers. Without keys the table is one sequence.
    Null keys are a key, a null order value comes first, and rows of equal order follow
    each other in any order, which is the same for all of one result.
    """
    how = SCANS[kind]
    value = F.lit(None).cast("long") if value is None else value
    if few(df, WINDOW_ROWS if window_rows is None else window_rows):
        window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
        return df.withColumn(name, how.plain(value, window))
    valued = df.withColumn(_VALUE, value)
    if valued.schema[_VALUE].dataType != DoubleType():
        valued = valued.withColumn(_VALUE, F.col(_VALUE).cast("long"))
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    ranges = [*keys, *order, F.xxhash64(*plain)]
    ranged = valued.repartitionByRange(*ranges).sortWithinPartitions(*ranges)
    local = materialise(_scanned(ranged.withColumn(_PART, F.spark_partition_id()), list(keys), kind), "prefix-scan")
    own, carry = F.col(_LOCAL), F.col("__carry")
    joined = local.join(F.broadcast(carries(local, list(keys), kind)), _PART, "left")
    result = F.when(F.col(_LEAD) & F.col("__met"), how.both(own, carry, F.col(_FIRST))).otherwise(own)
    return joined.select(*df.columns, result.alias(name))


def new_key(keys: list[pa.Array], before: list | None, n: int) -> np.ndarray:
    """Where a row's key differs from that of the row before, batches included; nulls are equal."""
    new = np.zeros(n, bool)
    for i, key in enumerate(keys):
        old = pa.concat_arrays([pa.array([before[i] if before else None], key.type), key.slice(0, n - 1)])
        differs = pc.fill_null(pc.not_equal(key, old), False)
        new |= pc.or_(differs, pc.xor(pc.is_null(key), pc.is_null(old))).to_numpy(zero_copy_only=False)
    new[0] |= before is None
    return new


def _scanned(ranged: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Every task's own scan; its first and last row are marked, the last has the key's total."""
    number = LongType() if kind == "number" else ranged.schema[_VALUE].dataType
    added = ((_LOCAL, number), (_LEAD, BooleanType()), (_FIRST, BooleanType()), (_TOTAL, number), (_LAST, BooleanType()))
    schema = StructType(list(ranged.schema.fields))
    for name, of in added:
        schema = schema.add(name, of)
    types = to_arrow_schema(schema)
    given, local = ranged.columns, SCANS[kind].local

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state, lead, held = None, None, True, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held is not None:  # another batch follows, so its last row is not the task's
                yield pa.RecordBatch.from_arrays([*held, pa.array(np.zeros(len(held[0]), bool))], schema=types)
            key = [batch.column(k) for k in keys]
            new = new_key(key, before, n)
            first = np.zeros(n, bool)
            first[0] = before is None
            changes = np.flatnonzero(new & ~first)
            leading = np.arange(n) < (changes[0] if len(changes) else n) if lead else np.zeros(n, bool)
            lead = lead and not len(changes)
            before = [k[n - 1].as_py() for k in key]
            raw = batch.column(_VALUE)
            value = np.ma.array(
                pc.fill_null(raw, 0).to_numpy(zero_copy_only=False), mask=pc.is_null(raw).to_numpy(zero_copy_only=False)
            )
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            out, state = local(value, start, None if new[0] else state)
            total = [None] * (n - 1) + [None if state is None else state.item()]
            held = [
                *[batch.column(c) for c in given],
                pa.array(out.data, types.field(_LOCAL).type, mask=np.ma.getmaskarray(out)),
                pa.array(leading), pa.array(first), pa.array(total, types.field(_TOTAL).type),
            ]
        if held is not None:
            last = np.arange(len(held[0])) == len(held[0]) - 1
            yield pa.RecordBatch.from_arrays([*held, pa.array(last)], schema=types)

    return ranged.mapInArrow(work, schema)


def carries(local: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(part, carry, met) of each task: the totals of the earlier tasks that end in its first key."""
    key = F.struct(*keys) if keys else F.lit(0)
    none = F.lit(None).cast(local.schema[_TOTAL].dataType)
    ends = local.where(_LAST).select(key.alias("key"), _PART, F.lit(True).alias("end"), F.col(_TOTAL).alias("total"))
    starts = local.where(_FIRST).select(key.alias("key"), _PART, F.lit(False).alias("end"), none.alias("total"))
    before = Window.partitionBy("key").orderBy(_PART, "end").rowsBetween(*_BEFORE)
    return (
        ends.unionByName(starts)
        .select(
            _PART, "end",
            SCANS[kind].carry(F.col("total")).over(before).alias("__carry"),
            (F.count_if("end").over(before) > 0).alias("__met"),
        )
        .where(~F.col("end"))
        .drop("end")
    )
