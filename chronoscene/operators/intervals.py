"""Continuous periods and gaps of intervals per entity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chronoscene.operators.rangescan import carried_scan, range_sorted, runs

KINDS = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("island", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
    ]
)


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, num_partitions: int | None = None) -> DataFrame:
    """Rows ``(entity, kind, start, end)``: ``period`` for each maximal covered stretch, ``gap`` between two of them.

    Positions are whole numbers. Intervals that touch are joined. Rows with a null in any of the three columns and those
    that don't end after their start are left out; an empty table gives no rows; repeated rows and other columns don't
    matter. No gap is given before the first or after the last period.

    Intervals with the same start are first reduced to the longest one (map-side), the rest is range-sorted by entity and
    start; partitions pass on only (entity, largest end, start of the open period). A hot entity is thus never gathered.
    """
    lean = (
        df.select(F.col(entity).cast("string").alias("entity"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"))
        .where("entity is not null and start is not null and end is not null and end > start")
        .groupBy("entity", "start")
        .agg(F.max("end").alias("end"))
    )
    ordered = range_sorted(lean, ["entity", "start"], num_partitions)

    def step(batch: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        keys = batch["entity"].to_numpy(dtype=object)
        s, e = batch["start"].to_numpy(np.int64), batch["end"].to_numpy(np.int64)
        at = runs(keys)
        reach = batch["end"].groupby(np.repeat(np.arange(len(at)), np.diff(np.append(at, len(keys))))).cummax().to_numpy(np.int64)
        known = np.ones(len(keys), bool)
        known[at] = False
        before = np.where(known, np.roll(reach, 1), 0)
        carried = state is not None and state[0] == keys[0]
        if carried:
            stop = at[1] if len(at) > 1 else len(keys)
            before[0], known[0] = state[1], True
            before[1:stop] = np.maximum(before[1:stop], state[1])
            reach[:stop] = np.maximum(reach[:stop], state[1])
        opens = ~known | (before < s)
        island = pd.Series(np.where(opens, s, 0))
        island[~opens] = np.nan
        if carried and not opens[0]:
            island[0] = state[2]
        island = island.ffill().to_numpy(np.int64)
        gaps = opens & known
        first = runs(np.rec.fromarrays([np.repeat(np.arange(len(at)), np.diff(np.append(at, len(keys)))), island]))
        last = np.append(first[1:], len(keys)) - 1
        out = pd.DataFrame(
            {
                "entity": np.concatenate([keys[gaps], keys[first]]),
                "kind": ["gap"] * int(gaps.sum()) + ["period"] * len(first),
                "island": np.concatenate([s[gaps], island[first]]),
                "start": np.concatenate([before[gaps], island[first]]),
                "end": np.concatenate([s[gaps], reach[last]]),
            }
        )
        single = len(at) == 1 and (state is None or (carried and state[3]))
        return out, (keys[-1], int(reach[-1]), int(island[-1]), single)

    def merge(carry: tuple | None, last: tuple) -> tuple:
        if carry and last[3] and carry[0] == last[0]:
            return (last[0], max(carry[1], last[1]), last[2] if carry[1] < last[2] else carry[2], True)
        return last

    pieces = carried_scan(ordered, step, merge, KINDS)
    return pieces.groupBy("entity", "kind", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


#: One position: clock, fraction or decimal number, with % or s behind it.
POSITION = r"(\d+(?::\d+){1,2}(?:\.\d+)?|\d+\s*/\s*\d+|\d+(?:\.\d+)?)\s*(%|s)?"
ONE = rf"^[^\w%]*{POSITION}[^\w%]*$"
TWO = rf"^[^\w%]*(?:from\s+)?{POSITION}\s*(?:,|;|-|–|—|\.\.|to|until|till)\s*{POSITION}[^\w%]*$"


def _position(text: Column, unit: Column) -> Column:
    """struct(value, in_seconds) of one position."""
    clock, ratio = F.split(text, ":"), F.split(text, "/")
    part = lambda parts, i: F.try_element_at(parts, F.lit(i)).cast("double")
    seconds = F.aggregate(clock, F.lit(0.0), lambda acc, x: acc * 60 + x.cast("double"))
    value = (
        F.when(text.contains(":"), seconds)
        .when(text.contains("/"), F.when(part(ratio, 2) > 0, part(ratio, 1) / part(ratio, 2)))
        .when(unit == "%", text.cast("double") / 100)
        .otherwise(text.cast("double"))
    )
    return F.struct(value.alias("value"), (text.contains(":") | (unit == "s")).alias("in_seconds"))


def read_intervals(texts: Column) -> Column:
    """array<struct<start, end: double, in_seconds: boolean>> of an array of texts in many notations.

    A text holds a whole interval (``[1/4, 1/2]``, ``0.0%-10.0%``, ``3.00s - 9.60s``, ``from 1/3 until 1``), or the array
    holds the two bounds as texts of their own. Unreadable texts give nothing; a null or empty array gives an empty one.
    """
    def read(x: Column) -> Column:
        t = F.lower(F.trim(x))
        get = lambda pattern, i: F.regexp_extract(t, pattern, i)
        unit = F.when(get(TWO, 2) == "", get(TWO, 4)).otherwise(get(TWO, 2))
        both = F.struct(
            _position(get(TWO, 1), unit).alias("a"), _position(get(TWO, 3), F.when(get(TWO, 4) == "", unit).otherwise(get(TWO, 4))).alias("b")
        )
        one = _position(get(ONE, 1), get(ONE, 2))
        return F.struct(F.when(t.rlike(TWO), both).alias("both"), F.when(t.rlike(ONE), one).alias("one"))

    parts = F.transform(F.coalesce(texts, F.array().cast("array<string>")), read)
    pair = lambda a, b: F.struct(a["value"].alias("start"), b["value"].alias("end"), a["in_seconds"].alias("in_seconds"))
    whole = F.transform(F.filter(parts, lambda p: p["both"].isNotNull()), lambda p: pair(p["both"]["a"], p["both"]["b"]))
    bounds = (F.size(parts) == 2) & F.get(parts, F.lit(0))["one"].isNotNull() & F.get(parts, F.lit(1))["one"].isNotNull()
    split = F.array(pair(F.get(parts, F.lit(0))["one"], F.get(parts, F.lit(1))["one"]))
    return F.filter(
        F.when(bounds, split).otherwise(whole), lambda p: p["start"].isNotNull() & p["end"].isNotNull() & p["in_seconds"].isNotNull()
    )


def video_positions(events: DataFrame, videos: DataFrame, scale: int = 120) -> DataFrame:
    """``(video_id, start, end)`` in ``scale``-ths of the video, from event rows with written intervals.

    Of rows with the same video and event the one received last counts (ties: larger ``row_id``); rows without event id
    count each for itself; rows without video id are left out. Clock positions and seconds are divided by ``duration_s``;
    without a known positive duration they are unreadable. Bounds are rounded to the nearest whole number.
    """
    latest = (
        events.where("video_id is not null")
        .withColumn("own", F.when(F.col("event_id").isNull(), F.col("row_id")))
        .groupBy("video_id", "event_id", "own")
        .agg(F.max(F.struct("received_at", "row_id", "video_location_precise")).alias("row"))
    )
    read = (
        latest.select("video_id", F.explode(read_intervals(F.col("row.video_location_precise"))).alias("i"))
        .select("video_id", "i.*")
        .distinct()
    )
    length = videos.where("duration_s > 0").select("video_id", "duration_s").groupBy("video_id").agg(F.max("duration_s").alias("duration_s"))
    at = lambda c: F.floor(F.when(F.col("in_seconds"), F.col(c) / F.col("duration_s")).otherwise(F.col(c)) * scale + 0.5).cast("int")
    return read.join(length, "video_id", "left").select("video_id", at("start").alias("start"), at("end").alias("end"))
