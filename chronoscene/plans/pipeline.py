"""Queries of the data-pipeline operators in the core: intervals, drifting schemas, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoscene.operators.drift import consistent_table, schema_changes
from chronoscene.operators.intervals import periods_and_gaps, video_positions
from chronoscene.operators.nested import flat_table
from chronoscene.storage import materialized, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    at = video_positions(table(spark, d, "timestamp_descriptions"), table(spark, d, "videos"))
    out = periods_and_gaps(at, "video_id", "start", "end")
    return out.select(F.col("entity").alias("video_id"), "kind", F.col("start").cast("int").alias("start_120"), F.col("end").cast("int").alias("end_120"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(table(spark, d, "caption_exports").select("feed_id", "file_no", "file_id", "line_no", "record"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("file_id", "change_kind", "old_name", "new_name")


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "caption_exports")
    out = consistent_table(lines, materialized(_changes(spark, d)), ["line_id", "file_id", "feed_id", "file_no", "line_no"])
    return out.toDF(*[c.replace(" ", "_") if c.replace(" ", "_") not in out.columns else c for c in out.columns])


def _flat(level: str):  # noqa: ANN202
    return lambda spark, d: flat_table(table(spark, d, "caption_batches").select("batch_id", "received_at", "payload"), level)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _flat("arguments")(spark, d).select("batch_id", "video_id", "event_id", "clause_no", "predicate", "arg_no", "arg")


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_table": p3_table,
    "p4_found": p4_found,
    "p4_captions": _flat("captions"),
    "p4_events": _flat("events"),
    "p4_clauses": _flat("clauses"),
}
