"""Scene-graph construction: pairs, interval joins, sampling, top-k per frame, gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoscene.operators.rangescan import prefix_sum, running_best


def object_pairs(objects: DataFrame) -> DataFrame:
    """Ordered pairs of different objects of a frame: ``(video_id, fid, o1, o2)`` of distinct ``(video_id, fid, oid)``."""
    o = objects.select("video_id", "fid", "oid").distinct()
    return o.withColumnRenamed("oid", "o1").join(o.withColumnRenamed("oid", "o2"), ["video_id", "fid"]).where("o1 <> o2")


def pairs_of_interest(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs that a list ``(o1, o2)`` names."""
    return pairs.join(wanted.distinct(), ["o1", "o2"], "left_semi")


def kept_relations(relations: DataFrame, kept: DataFrame) -> DataFrame:
    """Relations both of whose objects survive in their frame."""
    k = kept.select("video_id", "fid", "oid").distinct()
    return relations.join(k.withColumnRenamed("oid", "o1"), ["video_id", "fid", "o1"], "left_semi").join(k.withColumnRenamed("oid", "o2"), ["video_id", "fid", "o2"], "left_semi")


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark prunes each map task to ``k`` rows per key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def top_so_far(df: DataFrame, key: str, frame: str, score: str, k: int) -> DataFrame:
    """``(key, frame_no, frame, rank)``: at each frame the ``k`` rows of highest score among all up to it, as often as the frame has rows.

    Each frame is cut to its ``k`` best rows first; a scan then carries the best ones along the frames. Equal scores: the
    earlier frame first.
    """
    row = F.struct((-F.col(score)).alias("s"), F.col(frame).alias("f"))
    per = df.groupBy(key, frame).agg(F.slice(F.array_sort(F.collect_list(row)), 1, k).alias("own"), F.count("*").alias("n"))
    seen = running_best(per.withColumn("_key", F.col(key).cast("string")), "_key", [frame], "own", k, "best", inclusive=True)
    again = F.flatten(F.transform("best", lambda x: F.array_repeat(x["f"], F.col("n").cast("int"))))
    return seen.select(key, F.col(frame).alias("frame_no"), F.posexplode(F.slice(again, 1, k)).alias("rank", "_f")).select(key, "frame_no", F.col("_f").alias(frame), (F.col("rank") + 1).alias("rank"))


def frame_sample(frames: DataFrame, keep: str, most: int) -> DataFrame:
    """``(video_id, fid, new_fid)`` of distinct frames sampled by position.

    ``stride``: every ceil(n / most)-th. ``range``: every max(1, n // most)-th, at most ``most``. ``linspace``: ``most``
    evenly spread positions including both ends.
    """
    f = frames.select("video_id", "fid").distinct()
    w = Window.partitionBy("video_id")
    f = f.withColumn("i", F.row_number().over(w.orderBy("fid")) - 1).withColumn("n", F.count("*").over(w))
    if keep == "stride":
        step = F.ceil(F.col("n") / most)
        out = f.where(F.col("i") % step == 0).withColumn("new_fid", F.floor(F.col("i") / step))
    elif keep == "range":
        step = F.greatest(F.floor(F.col("n") / most), F.lit(1))
        out = f.where((F.col("i") % step == 0) & (F.col("i") / step < most)).withColumn("new_fid", F.floor(F.col("i") / step))
    else:
        at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.struct(j.alias("j"), F.floor(j * (F.col("n") - 1) / max(most - 1, 1)).alias("at")))
        hits = F.filter(at, lambda s: s["at"] == F.col("i"))
        out = f.withColumn("hit", F.explode(hits)).withColumn("new_fid", F.col("hit.j"))
    return out.select("video_id", "fid", F.col("new_fid").cast("int").alias("new_fid"))


def gap_fill(frames: DataFrame, gap: int) -> DataFrame:
    """Frames with one inserted every ``gap`` where two neighbours are further apart; a lone frame stays."""
    f = frames.select("video_id", "fid").distinct()
    f = f.withColumn("next", F.lead("fid").over(Window.partitionBy("video_id").orderBy("fid")))
    steps = F.when(F.col("next") - F.col("fid") > gap, F.sequence(F.col("fid"), F.col("next") - 1, F.lit(gap))).otherwise(F.array("fid"))
    return f.select("video_id", F.explode(steps).alias("fid")).distinct()


def days_of_interval(df: DataFrame, begin: Column, end: Column, low: str, high: str) -> DataFrame:
    """A row per day frame in ``[begin, end)`` within ``[low, high]``; an equi-expansion in place of a range join."""
    first, last = F.greatest(begin, F.lit(low).cast("date")), F.least(F.date_sub(end, 1), F.lit(high).cast("date"))
    return df.where(first <= last).withColumn("day", F.explode(F.sequence(first, last)))


def overlap_days(df: DataFrame, s1: Column, e1: Column, s2: Column, e2: Column) -> DataFrame:
    """A row per day of the intersection of two half-open date intervals; empty intersections give none."""
    first, end = F.greatest(s1, s2), F.least(e1, e2)
    return df.where(first < end).withColumn("day", F.explode(F.sequence(first, F.date_sub(end, 1))))


def sampled_others(df: DataFrame, key: str, own: str, words: DataFrame, word: str, n: int, seed: int) -> DataFrame:
    """``(key, others)``: up to ``n`` words per row that its list ``own`` lacks, all different.

    The distinct words are numbered in a seeded order. A row looks up as many neighbouring numbers as it may need, from a
    seeded start on, in that table, so no row ever meets the whole list.
    """
    numbered = words.select(F.col(word).alias("_w"), F.lit("").alias("_all"), F.lit(1).alias("_one"), F.xxhash64(F.lit(seed), word).alias("_h"))
    numbered = prefix_sum(numbered, "_all", ["_h", "_w"], "_one", "_b", "_at").select("_w", "_at")
    total = words.agg(F.count("*").alias("_n"))
    rows = df.select(key, own).crossJoin(total).withColumn("_start", F.when(F.col("_n") > 0, F.pmod(F.xxhash64(F.lit(seed), key), F.col("_n"))))
    last = F.least(F.lit(n) + F.size(own), F.col("_n").cast("int")) - 1
    looked = rows.where("_n > 0").select(key, own, F.col("_start"), F.col("_n"), F.explode(F.sequence(F.lit(0), last)).alias("_i")).withColumn("_at", (F.col("_start") + F.col("_i")) % F.col("_n"))
    free = looked.join(numbered, "_at").where(~F.coalesce(F.array_contains(own, F.col("_w")), F.lit(False)))
    some = free.groupBy(key).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_w"))), lambda x: x["_w"]), 1, n).alias("others"))
    return df.select(key).join(some, key, "left").select(key, F.coalesce("others", F.array().cast("array<string>")).alias("others"))
