"""Top N rows of every group by merging sorted runs with a loser tree.

Each input partition becomes a run: sorted by group and score in the JVM (spilling where needed) and cut to N rows per group,
so a group of millions of rows leaves at most N per run. The runs are stored by hash bucket of the group (the shuffle), each
still in order; a bucket's runs are merged by a loser tree that jumps to the next group once N rows of one are out. A bucket
is cut by hash of the group into slices that lie one after the other, so a task holds one slice at a time, whatever the
size of its bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from chronoscene.storage import materialized, partitions_for


class LoserTree:
    """Tournament over sorted runs of keys; ``winner`` is the run with the smallest head, None when all are used up."""

    def __init__(self, heads: list[tuple | None]) -> None:
        self.k = max(len(heads), 1)
        self.heads = [*heads] or [None]
        self.losers = [-1] * self.k
        self.winner: int | None = 0
        for run in range(self.k):
            self._enter(run)
        self._settle()

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _enter(self, run: int) -> None:
        at, best = (run + self.k) // 2, run
        while at > 0:
            other = self.losers[at]
            if other < 0:
                self.losers[at] = best
                return
            if self._less(other, best):
                self.losers[at], best = best, other
            at //= 2
        self.best = best

    def _settle(self) -> None:
        self.winner = self.best if self.heads[self.best] is not None else None

    def replace(self, head: tuple | None) -> None:
        """Gives the winning run its next head and plays its path again."""
        run = self.winner
        self.heads[run] = head
        at, best = (run + self.k) // 2, run
        while at > 0:
            other = self.losers[at]
            if self._less(other, best):
                self.losers[at], best = best, other
            at //= 2
        self.best = best
        self._settle()

    def runner_up(self) -> tuple | None:
        """Smallest head but the winner's; it has lost to the winner, so it lies on the winner's path."""
        at, least = (self.winner + self.k) // 2, None
        while at > 0:
            head = self.heads[self.losers[at]]
            if head is not None and (least is None or head < least):
                least = head
            at //= 2
        return least


def merge_runs(runs: list[list[tuple]], n: int) -> list[tuple[int, int]]:
    """``(run, place)`` of the first ``n`` different keys of each group, in order; a key is ``(group, *score)``."""
    after = []
    for rows in runs:  # place of the next group, for the jump
        jump = [len(rows)] * len(rows)
        for i in range(len(rows) - 2, -1, -1):
            jump[i] = jump[i + 1] if rows[i][0] == rows[i + 1][0] else i + 1
        after.append(jump)
    at = [0] * len(runs)
    tree = LoserTree([rows[0] if rows else None for rows in runs])
    out, group, taken, last = [], None, 0, None
    while tree.winner is not None:
        run = tree.winner
        rows, key = runs[run], tree.heads[run]
        if key[0] != group:
            group, taken, last = key[0], 0, None
        if taken >= n:
            at[run] = after[run][at[run]]
        else:
            other = tree.runner_up()
            alone = other is None or other[0] != group
            end = after[run][at[run]] if alone else at[run] + 1
            while at[run] < end and taken < n:
                key = rows[at[run]]
                if key != last:
                    out.append((run, at[run]))
                    taken, last = taken + 1, key
                at[run] += 1
            if taken >= n:
                at[run] = after[run][at[run] - 1]
        tree.replace(rows[at[run]] if at[run] < len(rows) else None)
    return out


def slices_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each slice together; slices follow one another and may go over several batches."""
    held: list[pd.DataFrame] = []
    for b in batches:
        at = [*np.flatnonzero(np.diff(b["slice"].to_numpy())) + 1, len(b)]
        begin = 0
        for end in at:
            part = b.iloc[begin:end]
            if held and len(part) and held[-1]["slice"].iloc[0] != part["slice"].iloc[0]:
                yield pd.concat(held, ignore_index=True)
                held = []
            if len(part):
                held.append(part)
            begin = end
    if held:
        yield pd.concat(held, ignore_index=True)


def top_n(df: DataFrame, group: list[str], order: list[str], n: int, buckets: int | None = None, slice_rows: int = 100_000) -> DataFrame:
    """The ``n`` first rows of each group by ``order`` (whole numbers, smaller first; negate for largest first).

    Columns: ``group`` and ``order`` only. Rows with a null in any of them are left out; rows equal in all of them count
    once, which also makes the tie rule total. An empty table gives no rows. A slice has about ``slice_rows`` rows of runs; a
    group is never divided, and adds at most ``n`` rows per run.
    """
    columns = [*group, *order]
    spark = df.sparkSession
    buckets = buckets or 2 * partitions_for(spark)
    rows = df.select(*[F.col(c).cast("string") if c in group else F.col(c).cast("long").alias(c) for c in columns]).dropna()
    schema = T.StructType([T.StructField(c, T.StringType() if c in group else T.LongType()) for c in columns])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail: tuple | None = None  # group, rows taken and last row of the open group
        for b in batches:
            if not len(b):
                continue
            keys = [b[c].to_numpy() for c in columns]
            same_group = np.ones(len(b), bool)
            same_row = np.ones(len(b), bool)
            for c, v in zip(columns, keys, strict=True):
                prior = np.empty_like(v)
                prior[1:], prior[0] = v[:-1], v[0]
                equal = prior == v
                if c in group:
                    same_group &= equal
                same_row &= equal
            first = tuple(v[0] for v in keys)
            same_group[0] = bool(tail) and tail[0] == first[: len(group)]
            same_row[0] = bool(tail) and tail[2] == first
            start = ~same_group
            new = ~same_row
            count = np.cumsum(new)
            begin = np.maximum.accumulate(np.where(start, np.arange(len(b)), -1))
            base = np.where(begin >= 0, count[np.maximum(begin, 0)] - 1, -(tail[1] if tail else 0))
            place = count - base
            keep = b[new & (place <= n)]
            tail = (tuple(v[-1] for v in keys[: len(group)]), int(place[-1]), tuple(v[-1] for v in keys))
            if len(keep):
                yield keep

    runs = materialized(rows.sortWithinPartitions(*columns).mapInPandas(cut, schema).withColumn("run", F.spark_partition_id()))
    slices = max(math.ceil(runs.count() / (buckets * slice_rows)), 1)
    sliced = runs.withColumn("slice", F.pmod(F.xxhash64(*group), F.lit(slices)).cast("int"))
    stored = sliced.repartition(buckets, *group).sortWithinPartitions("slice", "run", *columns)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices_of(batches):
            yield merge_slice(b)

    def merge_slice(b: pd.DataFrame) -> pd.DataFrame:
        code = pd.MultiIndex.from_frame(b[group]).factorize()[0] if len(group) > 1 else pd.factorize(b[group[0]])[0]
        # Codes follow the order of the groups, as that of the sorted runs.
        ordered = b[group].assign(code=code).drop_duplicates("code").sort_values(group, key=lambda s: s.str.encode("utf-8"))
        rank = np.empty(len(ordered), np.int64)
        rank[ordered["code"].to_numpy()] = np.arange(len(ordered))
        keys = list(zip(rank[code].tolist(), *[b[c].tolist() for c in order], strict=True))
        starts = np.flatnonzero(np.diff(b["run"].to_numpy(), prepend=-1))
        ends = [*starts[1:].tolist(), len(b)]
        picked = merge_runs([keys[s:e] for s, e in zip(starts.tolist(), ends, strict=True)], n)
        return b.iloc[[int(starts[r]) + i for r, i in picked]][columns]

    return stored.select(*columns, "run", "slice").mapInPandas(merge, schema)


def boxes(frames: DataFrame) -> DataFrame:
    """``(video_id, gt_label, neg_area, fid, gt_instance_id, pos)`` of positions with label, id and a box with area."""
    rows = F.transform(
        F.coalesce("gt_bboxes", F.expr("array()").cast(frames.schema["gt_bboxes"].dataType)),
        lambda b, i: F.struct(F.get("gt_labels", i).alias("gt_label"), F.get("gt_instance_ids", i).alias("gt_instance_id"), b.alias("b"), i.alias("pos")),
    )
    flat = frames.select("video_id", "fid", F.inline(rows)).where("gt_label is not null and gt_instance_id is not null and b.x2 > b.x1 and b.y2 > b.y1")
    area = (F.col("b.x2").cast("long") - F.col("b.x1")) * (F.col("b.y2").cast("long") - F.col("b.y1"))
    return flat.select("video_id", "gt_label", (-area).alias("neg_area"), "fid", "gt_instance_id", "pos")
