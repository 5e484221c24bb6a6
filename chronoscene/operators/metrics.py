"""Precision, recall and losses as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ranked_hits(ranked: DataFrame, ks: list[int], group: list[str]) -> DataFrame:
    """``(k, precision, recall)``: macro averages over items of ``ranked (item, rank, match)``, 0 without items.

    An item's precision at k is 1/k and its recall 1 if a match is among its first k predictions. ``group`` names further
    columns by which the averages are taken.
    """
    per = ranked.crossJoin(F.broadcast(ranked.sparkSession.createDataFrame([(k,) for k in ks], "k int")))
    hits = per.groupBy(*group, "item", "k").agg(F.max(((F.col("rank") <= F.col("k")) & F.col("match")).cast("int")).alias("hit"))
    return hits.groupBy(*group, "k").agg(F.coalesce(F.avg(F.col("hit") / F.col("k")), F.lit(0.0)).alias("precision"), F.coalesce(F.avg("hit"), F.lit(0.0)).alias("recall"))


def classification_report(df: DataFrame, group: str, truth: Column, predicted: Column) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 and share of rows per group; a division by zero gives 0."""
    counts = df.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"), F.count_if(truth == predicted).alias("right"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    total = counts.agg(F.sum("n").alias("total"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = counts.crossJoin(F.broadcast(total)).select(group, "n", ratio(F.col("right"), F.col("n")).alias("accuracy"), p.alias("precision"), r.alias("recall"), (F.col("n") / F.col("total")).alias("share"))
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def cross_entropy(p: Column, y: Column) -> Column:
    """Binary cross-entropy with logarithms not below -100."""
    log = lambda x: F.when(x > 0, F.greatest(F.ln(x), F.lit(-100.0))).otherwise(-100.0)
    return -(y * log(p) + (1 - y) * log(1 - p))


def logit(p: Column) -> Column:
    """Logarithm of the odds; null for 0 and 1."""
    return F.when((p > 0) & (p < 1), F.ln(p / (1 - p)))


def coarse_weight(label: str, fid: Column, n: Column, part: float = 0.3) -> Column:
    """Triangular weight of frame ``fid`` for an event that lies early, mid or late in a video of ``n`` frames.

    With L = ceil(part * n) frames to favour, the weight changes by 1 / L per frame: early falls up to frame L, late rises
    from frame n - L, mid peaks at ceil(n / 2) and reaches ceil(L / 2) frames to either side; elsewhere it is 0.
    """
    size = F.ceil(n * part)
    if label == "early":
        weight = F.when(fid <= size, size - fid + 1)
    elif label == "late":
        weight = F.when(fid >= n - size, fid - (n - size) + 1)
    else:
        half = F.ceil(size / 2)
        off = F.abs(F.ceil(n / 2) - fid)
        weight = F.when(off <= half, half - off + 1)
    return F.coalesce(weight / size, F.lit(0.0))


def fine_weight(fid: Column, n: Column, start: Column, end: Column) -> Column:
    """Weight of a frame for an event in the fraction [start, end] of the video: falls with the distance from its middle."""
    return F.greatest(F.lit(0.0), 1 - F.abs(fid / n - (start + end) / 2) / (end - start + 0.5))
