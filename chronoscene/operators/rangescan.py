"""Scans over a globally sorted table without gathering any key in one task.

The table is range-partitioned and sorted by (entity, order), so a hot entity is spread over many partitions. A first pass
runs the scan inside each partition from an empty state and keeps only its last state (one small record per partition).
The driver folds these records, as many as there are partitions, into the state that enters each partition; the second
pass repeats the scan from that state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from chronoscene.storage import checkpointed, partitions_for

Step = Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame | None, tuple | None]]


def range_sorted(df: DataFrame, keys: list[str], num_partitions: int | None = None) -> DataFrame:
    """Globally sorted copy of ``df`` with its partition number in ``_pid``, fixed by a checkpoint."""
    n = num_partitions or partitions_for(df.sparkSession)
    out = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return checkpointed(out.withColumn("_pid", F.spark_partition_id()))


def carried_scan(
    ordered: DataFrame, step: Step, merge: Callable[[tuple | None, tuple], tuple], schema: T.StructType
) -> DataFrame:
    """Runs ``step`` over a ``range_sorted`` table with the state carried across partitions.

    ``step(batch, state)`` returns the output rows and the new state; ``merge(carry, last)`` gives the state after a
    partition whose own scan, begun empty, ended with ``last``.
    """

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, state = None, None
        for batch in batches:
            if len(batch):
                pid = int(batch["_pid"].iloc[0])
                _, state = step(batch, state)
        if pid is not None:
            yield pd.DataFrame({"pid": [pid], "state": [pickle.dumps(state)]})

    last = {r.pid: pickle.loads(r.state) for r in ordered.mapInPandas(summarize, "pid int, state binary").collect()}
    entering, carry = {}, None
    for pid in sorted(last):
        entering[pid] = carry
        carry = merge(carry, last[pid])

    def rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, begun = None, False
        for batch in batches:
            if len(batch):
                if not begun:
                    state, begun = entering[int(batch["_pid"].iloc[0])], True
                out, state = step(batch, state)
                if out is not None and len(out):
                    yield out

    return ordered.mapInPandas(rescan, schema)


def runs(keys: np.ndarray) -> np.ndarray:
    """Start positions of the runs of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def running_best(df: DataFrame, group: str, order: list[str], items: str, k: int, into: str, inclusive: bool = False, num_partitions: int | None = None) -> DataFrame:
    """Adds, per ``group`` in ``order``, the ``k`` smallest of the ``items`` of all rows before, with ``inclusive`` of the row itself too.

    ``items`` is an array of structs that compare by their fields in order (texts and numbers, no nulls). ``group`` must be a
    string without nulls. The state is a list of ``k`` items, so long groups cost no more per row than short ones.
    """
    ordered = range_sorted(df, [group, *order], num_partitions)
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(into, df.schema[items].dataType)])
    plain = lambda v: tuple(plain(x) for x in v.values()) if isinstance(v, dict) else tuple(map(plain, v)) if isinstance(v, (list, np.ndarray)) else v

    def best(rows: list[tuple]) -> list[tuple]:
        return sorted(rows, key=lambda x: x[0])[:k]

    def step(batch: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        key, top, single = state if state else (None, [], True)
        out = []
        for g, own in zip(batch[group], batch[items], strict=True):
            if g != key:
                key, top, single = g, [], state is None and not out
            after = best(top + [(plain(x), x) for x in own]) if own is not None and len(own) else top
            out.append([x for _, x in (after if inclusive else top)])
            top = after
        result = batch[names].copy()
        result[into] = out
        return result, (key, top, single)

    def merge(carry: tuple | None, last: tuple) -> tuple:
        return (last[0], best(carry[1] + last[1]), True) if carry and last[2] and carry[0] == last[0] else last

    return carried_scan(ordered, step, merge, schema)


def prefix_sum(
    df: DataFrame, group: str, order: list[str], value: str, into: str = "before", rank: str = "rank", num_partitions: int | None = None
) -> DataFrame:
    """Adds, per ``group`` in ``order``, the sum of ``value`` in the rows before (``into``) and their number (``rank``).

    ``group`` must be a string without nulls, ``value`` a whole number; null values count 0. Rows that are equal in
    ``order`` get consecutive places in either order; give a total order where that matters.
    """
    ordered = range_sorted(df, [group, *order], num_partitions)
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.LongType()), T.StructField(rank, T.LongType())])

    def step(batch: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        keys = batch[group].to_numpy(dtype=object)
        amount = batch[value].fillna(0).to_numpy(dtype=np.int64)
        at = runs(keys)
        size = np.diff(np.append(at, len(keys)))
        total = np.cumsum(amount)
        before = total - amount
        base = np.repeat(before[at], size)
        before, place = before - base, np.arange(len(keys)) - np.repeat(at, size)
        if state and state[0] == keys[0]:
            before[: size[0]] += state[1]
            place[: size[0]] += state[2]
        out = batch[names].copy()
        out[into], out[rank] = before, place
        single = len(at) == 1 and (state is None or (state[0] == keys[0] and state[3]))
        return out, (keys[-1], int(before[-1] + amount[-1]), int(place[-1] + 1), single)

    def merge(carry: tuple | None, last: tuple) -> tuple:
        if carry and last[3] and carry[0] == last[0]:
            return (last[0], carry[1] + last[1], carry[2] + last[2], True)
        return last

    return carried_scan(ordered, step, merge, schema)
