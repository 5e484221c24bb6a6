"""Canonical scene-graph tables over the project's source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoscene.storage import table

EPOCH = "2024-01-01"


def unary_atoms(spark: SparkSession, d: str) -> DataFrame:
    """``(video_id, fid, oid, predicate, prob)`` from the event stream: one fact per key, its most likely sighting."""
    e = table(spark, d, "events").select("user_id", "ts", "event_type", "value", "props")
    prob = F.round(F.col("value") / (F.col("value") + 100), 6)
    return (
        e.select(
            F.col("user_id").alias("video_id"), F.date_diff(F.to_date("ts"), F.lit(EPOCH).cast("date")).alias("fid"),
            (F.get_json_object("props", "$.k").cast("int") % 8).alias("oid"), F.col("event_type").alias("predicate"), prob.alias("p"),
        ).groupBy("video_id", "fid", "oid", "predicate").agg(F.max("p").alias("prob"))
    )


def binary_atoms(unary: DataFrame) -> DataFrame:
    """``(video_id, fid, predicate, o1, o2, prob)``: ordered pairs of different objects of a frame."""
    left = unary.select("video_id", "fid", "predicate", F.col("oid").alias("o1"), F.col("prob").alias("p1"))
    right = unary.groupBy("video_id", "fid", F.col("oid").alias("o2")).agg(F.max("prob").alias("p2"))
    return left.join(right, ["video_id", "fid"]).where("o1 <> o2").select("video_id", "fid", "predicate", "o1", "o2", F.round(F.col("p1") * F.col("p2"), 6).alias("prob"))


def names(unary: DataFrame) -> DataFrame:
    """``(video_id, oid, cid, prob)``: category of each object; categories are negative, as constants are."""
    return unary.groupBy("video_id", "oid").agg(F.round(F.avg("prob"), 6).alias("prob")).select("video_id", "oid", (-1 - F.col("oid") % 3).alias("cid"), "prob")


def objects(unary: DataFrame) -> DataFrame:
    return unary.select("video_id", "oid").distinct()


def time_domain(unary: DataFrame, include_last_frame: bool = False) -> DataFrame:
    """``(video_id, t)`` with t from 0 up to the last frame, by default without it."""
    top = unary.groupBy("video_id").agg(F.max("fid").alias("m"))
    last = F.col("m") if include_last_frame else F.col("m") - 1
    return top.where(last >= 0).select("video_id", F.explode(F.sequence(F.lit(0), last)).alias("t"))


def relations(spark: SparkSession, d: str) -> DataFrame:
    """Relation intervals of orders and line items: ``(video_id, oid, fid, area, begin_date, end_date)``."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("begin_date"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", F.to_date("l_shipdate").alias("end_date"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("video_id"), F.col("l_suppkey").alias("oid"), (F.col("l_linenumber") - 1).alias("fid"),
        (F.col("l_quantity") * F.col("l_extendedprice")).alias("area"), "begin_date", "end_date",
    )
