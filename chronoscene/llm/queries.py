"""Queries of the operators for language-model training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoscene.llm import keywords, mixing, packing, pairs, stuffing, tokens, topn
from chronoscene.storage import materialized, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = table(spark, d, "vocabulary")
    elements = keywords.keyword_elements(table(spark, d, "batched_gpt_specs"), vocabulary)
    meant = keywords.map_values(elements, vocabulary)
    return elements.join(meant, ["kind", "value"]).select("spec_id", "field", "pos", "term_id")


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values without an entry, with the number of elements that hold them."""
    vocabulary = table(spark, d, "vocabulary")
    elements = keywords.keyword_elements(table(spark, d, "batched_gpt_specs"), vocabulary)
    counts = elements.groupBy("kind", "value").agg(F.count("*").alias("n_elements"))
    return counts.join(keywords.map_values(elements, vocabulary).where("term_id = -1"), ["kind", "value"]).drop("term_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    largest = topn.top_n(topn.boxes(table(spark, d, "frame_annotations")), ["video_id", "gt_label"], ["neg_area", "fid", "gt_instance_id", "pos"], 8)
    return largest.select("video_id", "gt_label", F.col("fid").cast("int").alias("fid"), "gt_instance_id")


P5_SQL = """
with p as (select video_id, fid, generate_subscripts(gt_bboxes, 1) as i, gt_labels, gt_instance_ids, gt_bboxes from frame_annotations),
b as (select distinct video_id, gt_labels[i] as gt_label, fid, gt_instance_ids[i] as gt_instance_id, gt_bboxes[i] as b, i from p),
a as (select *, (b.x2 - b.x1)::bigint * (b.y2 - b.y1) as area from b
      where gt_label is not null and gt_instance_id is not null and b.x2 > b.x1 and b.y2 > b.y1),
r as (select *, row_number() over (partition by video_id, gt_label order by area desc, fid, gt_instance_id, i) as n from a)
select video_id, gt_label, fid, gt_instance_id from r where n <= 8
"""

def p6_found(spark: SparkSession, d: str) -> DataFrame:
    all_pairs, labelled = pairs.project_pairs(
        table(spark, d, "caption_descriptions").select("caption_id", "caption", "sequential_descriptions", "lang"),
        table(spark, d, "timestamp_descriptions").select("row_id", "decription", "programmatic"),
    )
    return pairs.defective_pairs(all_pairs, labelled)


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of all documents, computed once and written to the shared folder."""
    return materialized(tokens.sized(table(spark, d, "documents")))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sized(spark, d), table(spark, d, "pack_capacity"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_pack(spark, d), table(spark, d, "pack_capacity"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    docs, targets = _sized(spark, d), table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(docs, targets), docs, targets)


def p8_fitting_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the largest plans that keep all shares."""
    docs, targets = _sized(spark, d), table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(docs, targets, keep_shares=True), docs, targets, keep_shares=True)


def p7_sound(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: all tokens placed, no container too full, no smaller document split, no mixed languages."""
    sized, capacities = _sized(spark, d), table(spark, d, "pack_capacity")
    pieces = materialized(packing.pack(sized, capacities))
    return packing.soundness(pieces, sized, capacities)


def p8_sound(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any mix: no document more often than allowed, no source above its demand, one row per copy."""
    docs, targets = _sized(spark, d), table(spark, d, "mix_targets")
    return mixing.soundness(materialized(mixing.mix(docs, targets)), docs, targets)


P7_SOUND_SQL = "select pack_id, (select count(*) from documents where length(text) > 0) as documents, true as complete, true as within, true as whole, true as one_language from pack_capacity where capacity_tokens > 0"
P8_SOUND_SQL = "select plan_id, true as repeats_kept, true as demand_kept, true as copies_counted from (select distinct plan_id from mix_targets)"


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(materialized(stuffing.segments(table(spark, d, "documents"))))


QUERIES = {"p9_found": p9_found, "p5_found": p5_found, "p6_found": p6_found, "p7_pack": p7_pack, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_fitting_shares": p8_fitting_shares, "p7_sound": p7_sound, "p8_sound": p8_sound, "p1_found": p1_found, "p1_unmatched": p1_unmatched}
ORACLES: dict[str, str] = {"p5_found": P5_SQL, "p7_sound": P7_SOUND_SQL, "p8_sound": P8_SOUND_SQL}
