"""Keyed state of streams: one small value per replica, snapshot key or event block.

Each processor keeps what the next micro-batch needs and nothing else. Sample times of a
replica rise, so its latest time stands for all samples seen; a run of failures is four
numbers; the sequences of an event block that were exported are the borders of their
intervals. State and output of a micro-batch are committed together, so a replayed batch
starts from the state before it.

A call per replica costs a millisecond whatever it does. Replicas are dealt into buckets, and
a bucket is one call: its state is a list with an entry per replica, its rows come as the
few Arrow tables that the tasks before the shuffle made of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from posewatch.operators.score import REPLICA_KEY

# Sequences of one run per state row; a run with very many events is many rows.
BLOCK = 1 << 16
# Buckets that keys are dealt into; a checkpoint holds its state by them.
BUCKETS = 1 << 9
# Rows that a task takes together before it parts them by bucket.
CHUNK = 1 << 19


def _rows(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of one key in one micro-batch."""
    held = list(batches)
    return held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _stream(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _by_bucket(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[pa.RecordBatch]:
    """(bucket, rows) with the rows of a bucket and chunk as one Arrow stream."""
    for table in _chunks(batches):
        if once:
            table = table.group_by(table.column_names, use_threads=False).aggregate([])
        bucket = table["__bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        lows = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        table = table.drop_columns("__bucket").take(pa.array(order)).combine_chunks()
        parts = [_stream(table.slice(lo, hi - lo)) for lo, hi in zip(lows, np.r_[lows[1:], len(bucket)])]
        yield pa.record_batch([pa.array(bucket[lows], pa.int32()), pa.array(parts, pa.binary())], ["bucket", "rows"])


def _in_buckets(rows: DataFrame, keys: Sequence[str], once: bool = False):
    """Rows by bucket of their key; ``once``: equal rows that a task meets together stay one."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def work(batches):
        return _by_bucket(batches, once)

    return rows.withColumn("__bucket", bucket).mapInArrow(work, "bucket int, rows binary").groupBy("bucket")


def _table(batches: Iterator[pd.DataFrame]) -> pa.Table:
    """The rows of one bucket in one micro-batch."""
    return pa.concat_tables([pa.ipc.open_stream(part).read_all() for held in batches for part in held["rows"]])


def _entries(state: ListState, schema: pa.Schema) -> pa.Table:
    columns = list(zip(*state.get())) or [()] * len(schema)
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, schema.types)], schema)


def _keep(state: ListState, entries: pa.Table, old: np.ndarray, changed: np.ndarray) -> None:
    """Write entries by their numbers; the list is written anew only if an old one changed."""
    only_new = not np.isin(changed, old).any()
    rows = entries.take(pa.array(changed)) if only_new else entries
    rows = list(zip(*(c.to_pylist() for c in rows.columns)))
    if only_new:
        state.appendList(rows)
    else:
        state.put(rows)


def _numbered(keys: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """A number for each row, from 0 for the key of each row of the second result."""
    number = np.zeros(len(keys), np.int64)
    for c in keys.columns:
        # one dictionary for all chunks, with an entry for null
        part = c.combine_chunks().dictionary_encode("encode")
        number = number * len(part.dictionary) + part.indices.to_numpy()
        _, first, number = np.unique(number, return_index=True, return_inverse=True)
    return number, keys.take(pa.array(first))


def _floats(column: pa.ChunkedArray, empty: float) -> np.ndarray:
    return column.fill_null(empty).to_numpy()


def _some(values: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=~there)


def _times_after(latest: np.ndarray, number: np.ndarray, time: np.ndarray) -> np.ndarray:
    """Rows of each time above the latest one of their number, one a time, in order."""
    at = np.lexsort((time, number))
    at = at[time[at] > latest[number[at]]]
    other = (number[at][1:] != number[at][:-1]) | (time[at][1:] != time[at][:-1])
    return at[np.r_[True, other]] if len(at) else at


class NewSamples(StatefulProcessor):
    """Samples later than all earlier ones of their replica, for the replicas of a bucket.

    A sample without a time cannot be known again; it is kept once a batch.
    """

    def __init__(self, entry: StructType):
        self.entry = entry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getListState("latest", self.entry)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _table(rows)
        kinds = [rows.schema.field(k) for k in REPLICA_KEY]
        before = _entries(self.latest, pa.schema([*kinds, ("time_ps", pa.float64())]))
        number, keys = _numbered(pa.concat_tables([before.select(REPLICA_KEY), rows.select(REPLICA_KEY)]))
        old, number = number[: len(before)], number[len(before) :]
        latest = np.full(len(keys), -np.inf)
        latest[old] = _floats(before["time_ps"], -np.inf)
        time = _floats(rows["time_ps"], np.nan)
        new = _times_after(latest, number, time)
        if len(new):
            np.maximum.at(latest, number[new], time[new])
            now = pa.table([*keys.columns, _some(latest, latest > -np.inf)], before.schema)
            _keep(self.latest, now, old, np.unique(number[new]))
            yield rows.take(pa.array(new)).to_pandas(types_mapper=pd.ArrowDtype)
        if np.isnan(time).any():
            yield rows.filter(pa.array(np.isnan(time))).to_pandas(types_mapper=pd.ArrowDtype).drop_duplicates()

    def close(self) -> None:
        pass


class ReplicaWatch(StatefulProcessor):
    """Samples seen, latest time and largest RMSD of the replicas of a bucket.

    Samples without a time are not counted; the RMSD is the largest of all rows, as samples of
    one time may differ.
    """

    def __init__(self, entry: StructType):
        self.entry = entry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.watch = handle.getListState("watch", self.entry)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _table(rows)
        kinds = [rows.schema.field(k) for k in REPLICA_KEY]
        columns = [("samples_observed", pa.int64()), ("latest_time_ps", pa.float64()), ("maximum_rmsd_nm", pa.float64())]
        before = _entries(self.watch, pa.schema([*kinds, *columns]))
        number, keys = _numbered(pa.concat_tables([before.select(REPLICA_KEY), rows.select(REPLICA_KEY)]))
        old, number = number[: len(before)], number[len(before) :]
        n, latest, top, known = np.zeros(len(keys), np.int64), *np.full((2, len(keys)), -np.inf), np.zeros(len(keys), bool)
        n[old] = before["samples_observed"].to_numpy()
        latest[old] = _floats(before["latest_time_ps"], -np.inf)
        time = _floats(rows["time_ps"], np.nan)
        new = _times_after(latest, number, time)
        n += np.bincount(number[new], minlength=len(keys))
        np.maximum.at(latest, number[new], time[new])
        for at, rmsd in ((old, before["maximum_rmsd_nm"]), (number, rows["rmsd_nm"])):
            there = rmsd.is_valid().to_numpy()
            known[at[there]] = True
            np.maximum.at(top, at[there], _floats(rmsd, 0)[there])
        now = pa.table([*keys.columns, pa.array(n), _some(latest, latest > -np.inf), _some(top, known)], before.schema)
        here = np.unique(number)
        _keep(self.watch, now, old, here)
        yield now.take(pa.array(here)).to_pandas(types_mapper=pd.ArrowDtype)

    def close(self) -> None:
        pass


class FailureRuns(StatefulProcessor):
    """Runs of failed snapshots that reach the limit, each time they grow."""

    def __init__(self, keys: Sequence[str], order: str, limit: int):
        self.keys, self.order, self.limit = list(keys), order, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("run", "last_success long, n long, first long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.open.get() or (None, 0, None, None)
        rows = _rows(rows).sort_values(self.order, kind="stable")
        at, failed = rows[self.order].to_numpy(), rows["failed"].to_numpy(bool)
        run = np.cumsum(~failed)  # run 0 goes on from the last batch
        out = []
        for k in np.unique(run):
            own = at[(run == k) & failed]
            last_success, n, first, last = before if k == 0 else (int(at[(run == k) & ~failed][0]), 0, None, None)
            if len(own):
                n, first, last = n + len(own), int(own[0]) if first is None else first, int(own[-1])
                if n >= self.limit:
                    out.append([*key, last_success, n, first, last])
            now = (last_success, n, first, last)
        self.open.update(now)
        if out:
            frame = pd.DataFrame(out, columns=[*self.keys, "last_success", "n_failures", "first_failure", "last_failure"])
            yield frame.astype({"last_success": "Int64"})

    def close(self) -> None:
        pass


class FreshEvents(StatefulProcessor):
    """Events whose sequence has not come before; the state is the intervals that have."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "intervals string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _rows(rows)[self.columns]
        numbered = rows["sequence"].notna()
        fresh = rows[numbered].drop_duplicates("sequence").sort_values("sequence")
        number = fresh["sequence"].to_numpy(np.int64)
        seen = self.done.get()
        lows, highs = np.array(json.loads(seen[0]) if seen else [[], []], np.int64)
        at = np.searchsorted(lows, number, "right") - 1
        known = (at >= 0) & (number <= np.r_[highs, 0][at]) if len(lows) else np.zeros(len(number), bool)
        fresh, number = fresh[~known], number[~known]
        if len(number):
            lows, highs = np.sort(np.r_[lows, number]), np.sort(np.r_[highs, number])
            apart = lows[1:] > highs[:-1] + 1
            self.done.update((json.dumps([lows[np.r_[True, apart]].tolist(), highs[np.r_[apart, True]].tolist()]),))
        # A row without a number cannot be known again; it is kept once a batch.
        out = pd.concat([fresh, rows[~numbered].drop_duplicates()])
        if len(out):
            yield out

    def close(self) -> None:
        pass


def new_samples(samples: DataFrame) -> DataFrame:
    """Each simulation time of a replica once, for samples that arrive in time order."""
    entry = StructType([*[samples.schema[k] for k in REPLICA_KEY], StructField("time_ps", DoubleType())])
    rows = _in_buckets(samples, REPLICA_KEY, once=True)
    return rows.transformWithStateInPandas(NewSamples(entry), samples.schema, "Append", "None")


def replica_watch(samples: DataFrame) -> DataFrame:
    """(samples_observed, latest_time_ps, maximum_rmsd_nm) of every replica that had rows."""
    schema = StructType(
        [*[samples.schema[k] for k in REPLICA_KEY], StructField("samples_observed", LongType()),
         StructField("latest_time_ps", DoubleType()), StructField("maximum_rmsd_nm", DoubleType())]
    )
    rows = samples.select(*REPLICA_KEY, "time_ps", "rmsd_nm")
    return _in_buckets(rows, REPLICA_KEY).transformWithStateInPandas(ReplicaWatch(schema), schema, "Update", "None")


def failure_runs(snapshots: DataFrame, keys: Sequence[str], order: str, limit: int) -> DataFrame:
    """Runs that grew to the limit or beyond; a run comes again when it grows on.

    ``order`` is a whole number; snapshots of a key arrive in order from batch to batch.
    """
    schema = StructType([snapshots.schema[k] for k in keys])
    for name in ("last_success", "n_failures", "first_failure", "last_failure"):
        schema = schema.add(name, LongType())
    rows = snapshots.select(*keys, F.col(order).cast("long").alias(order), "failed")
    return rows.groupBy(*keys).transformWithStateInPandas(FailureRuns(keys, order, limit), schema, "Update", "None")


def fresh_events(events: DataFrame) -> DataFrame:
    """Events with a (run_id, sequence) that has not come before; no log is read."""
    block = F.floor(F.col("sequence") / F.lit(BLOCK)).cast("long")
    blocks = events.withColumn("__block", block).groupBy("run_id", "__block")
    return blocks.transformWithStateInPandas(FreshEvents(events.columns), events.schema, "Append", "None")
