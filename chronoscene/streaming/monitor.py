"""Streaming counterparts: windowed counts with a watermark, and an online monitor of event chains."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoscene.storage import shared_dir


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The event table as an unbounded source of files."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/events.parquet*")


def windowed_counts(stream: DataFrame, window: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """``(start, event_type, n, total)`` per window; later events than ``lateness`` are dropped, closed windows are final."""
    timed = stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", lateness)
    counts = timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


MATCH = "video_id long, t1 long, t2 long"


def chain_monitor(stream: DataFrame, first: str, second: str, lateness: str = "1 day", kept_days: int = 3650) -> DataFrame:
    """``(video_id, t1, t2)``: for each ``second`` event the first ``first`` event before it, as soon as both are seen.

    State per video: the earliest time of ``first``. Times are microseconds. Late ``first`` events count from then on. The
    state of a video is dropped once the watermark, ``lateness`` behind the latest event, is ``kept_days`` past it.
    """
    keep = kept_days * 86_400_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begin = state.get[0] if state.exists else None
        later = []
        for rows in batches:
            own = rows.loc[rows["event_type"] == first, "t"]
            if len(own):
                begin = int(own.min()) if begin is None else min(begin, int(own.min()))
            later.append(rows.loc[rows["event_type"] == second, "t"].to_numpy())
        if begin is not None:
            state.update((begin,))
            state.setTimeoutTimestamp(max(begin // 1000 + keep, state.getCurrentWatermarkMs() + 1))
        times = np.sort(np.concatenate(later)) if later else np.zeros(0, np.int64)
        hits = times[times > (begin if begin is not None else 1 << 62)]
        yield pd.DataFrame({"video_id": [key[0]] * len(hits), "t1": [begin or 0] * len(hits), "t2": hits.tolist()}, dtype="int64")

    timed = stream.where(F.col("event_type").isin(first, second)).select(F.col("user_id").alias("video_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    timed = timed.withWatermark("ts", lateness).withColumn("t", F.unix_micros("ts"))
    return timed.groupBy("video_id").applyInPandasWithState(step, MATCH, "begin long", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame) -> DataFrame:
    """Runs a streaming query over all that is there and returns what it wrote in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    out = drained(windowed_counts(event_stream(spark, d)))
    return out.select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_chain_monitor(spark: SparkSession, d: str) -> DataFrame:
    return drained(chain_monitor(event_stream(spark, d), "click", "purchase"))


QUERIES = {"stream_windowed_counts": stream_windowed_counts, "stream_chain_monitor": stream_chain_monitor}
ORACLES = {
    "stream_windowed_counts": "select ts::date as day, event_type, count(*) as n, round(sum(value), 4) as total from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 1 day group by 1, 2",
    "stream_chain_monitor": "with f as (select user_id, min(epoch_us(ts)) as t1 from events where event_type = 'click' group by 1) select user_id as video_id, t1, epoch_us(ts) as t2 from events join f using (user_id) where event_type = 'purchase' and epoch_us(ts) > t1",
}
