"""Scoring algebra over embedding columns: similarity, softmax, pooling, candidate pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoscene.storage import materialized


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(x: Column, over: list[str]) -> Column:
    """Share of exp(x) in its group, from the largest on so that nothing overflows."""
    w = Window.partitionBy(*over)
    e = F.exp(x - F.max(x).over(w))
    return e / F.sum(e).over(w)


def label_means(embeddings: DataFrame) -> DataFrame:
    """``(label, feature)``: mean vector per label, dimension by dimension with map-side partial sums."""
    dims = embeddings.select("label", F.posexplode("embedding").alias("dim", "v"))
    means = dims.groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "m")))
    return means.groupBy("label").agg(F.transform(ordered, lambda s: s["m"]).alias("feature"))


def keyword_similarity(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, label, keyword, sim)``: cosine of each vector with each label's mean; the labels are the keyword list.

    The means are written once, so Spark knows their true size and broadcasts them only under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    means = materialized(label_means(embeddings).select(F.col("label").alias("keyword"), "feature", norm(F.col("feature")).alias("n2")))
    rows = embeddings.select("vec_id", "label", "embedding", norm(F.col("embedding")).alias("n1"))
    return rows.crossJoin(means).select("vec_id", "label", "keyword", (dot(F.col("embedding"), F.col("feature")) / (F.col("n1") * F.col("n2"))).alias("sim"))


def exact_mean(p: Column, digits: int = 6) -> Column:
    """Mean of decimals with ``digits`` places, summed as whole numbers: the same bits in any order of rows."""
    unit = 10.0**digits
    return F.sum(F.round(p * unit).cast("long")) / F.count(p) / unit


def mean_pool(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(exact_mean(F.col("prob")).alias("prob"))


def last_pool(df: DataFrame, keys: list[str], time: str = "fid") -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by("prob", time).alias("prob"))


def pruned_pairs(candidates: DataFrame, wanted: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs whose objects are candidates of the names that some wanted relation links.

    ``candidates (video_id, name, oid)``, ``wanted (predicate, from_name, to_name)``, ``pairs (video_id, fid, o1, o2)``.
    """
    source = candidates.select("video_id", F.col("name").alias("from_name"), F.col("oid").alias("o1"))
    target = candidates.select("video_id", F.col("name").alias("to_name"), F.col("oid").alias("o2"))
    allowed = source.join(wanted, "from_name").join(target, ["video_id", "to_name"]).select("video_id", "predicate", "o1", "o2").distinct()
    return pairs.join(allowed, ["video_id", "o1", "o2"]).select("video_id", "fid", "predicate", "o1", "o2").distinct()
