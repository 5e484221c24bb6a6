"""Queries of frame scans, mask coverage, detection merging and program facts, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from chronoscene.functions import geometry as geo
from chronoscene.operators.coverage import covered, covered_parts, summed
from chronoscene.plans import stsl
from chronoscene.plans.graph_queries import _A, _W, BOXES, boxes
from chronoscene.storage import partitions_for, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FR = "with fr as (select distinct a.video_id, fid, fps, duration_s from frame_annotations a join videos v on a.video_id = v.video_id)"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos").select("video_id", "fps", "duration_s")
    return table(spark, d, "frame_annotations").select("video_id", "fid").distinct().join(v, "video_id")


@query(FR + " select video_id, fid, fid // (fps // 2) as new_fid from fr where fps >= 2 and fid % (fps // 2) = 0")
def frames_at_rate(spark: SparkSession, d: str) -> DataFrame:
    """Frames at two per second, numbered anew; videos with a lower rate give none."""
    f = _frames(spark, d).where("fps >= 2").withColumn("stride", F.floor(F.col("fps") / 2).cast("int"))
    return f.where("fid % stride = 0").select("video_id", "fid", F.floor(F.col("fid") / F.col("stride")).alias("new_fid"))


@query(FR + " select video_id, fid, fid / fps as seconds from fr where fps > 0 and fid >= 2 * fps and fid < 6 * fps and (fid - 2 * fps) % 3 = 0")
def frames_in_window(spark: SparkSession, d: str) -> DataFrame:
    """Every third frame of the seconds from 2 up to 6."""
    f = _frames(spark, d).where("fps > 0 and fid >= 2 * fps and fid < 6 * fps and (fid - 2 * fps) % 3 = 0")
    return f.select("video_id", "fid", (F.col("fid") / F.col("fps")).alias("seconds"))


@query("select distinct a.video_id, a.fid from frame_annotations a where exists (select 1 from caption_descriptions c where c.video_id = a.video_id and c.caption_id % 40 = a.fid)")
def frames_of_list(spark: SparkSession, d: str) -> DataFrame:
    """Frames that a table of frame numbers names."""
    wanted = table(spark, d, "caption_descriptions").select("video_id", (F.col("caption_id") % 40).alias("fid"))
    return table(spark, d, "frame_annotations").select("video_id", "fid").distinct().join(wanted, ["video_id", "fid"], "left_semi")


COVER = BOXES + """, rows as (select video_id, y, x1, x2 from (select video_id, x1, x2, unnest(generate_series(y1, y2)) as y from r)), px as (select distinct video_id, y, unnest(generate_series(x1, x2)) as x from rows),
c as (select video_id, count(*) as area from px group by 1)"""


@query(COVER + " select video_id, area, round(1 - area / (300.0 * 150), 6)::double as uncovered from c")
def mask_union_area(spark: SparkSession, d: str) -> DataFrame:
    c = covered(boxes(spark, d))
    return c.select("video_id", "area", F.round(1 - F.col("area") / (300.0 * 150), 6).alias("uncovered"))


@query(COVER + ", g as (select video_id // 100 as seg, video_id as fid, round(1 - area / 45000.0, 6)::double as u from c), b as (select seg, arg_min(u, fid) as base from g group by 1) select seg, min(fid) as fid from g join b using (seg) where u > base + 0.01 group by 1")
def first_uncovered_frame(spark: SparkSession, d: str) -> DataFrame:
    """Where a propagation pass must start again: the first frame less covered than the segment's first one by over 0.01."""
    g = mask_union_area(spark, d).select(F.floor(F.col("video_id") / 100).alias("seg"), F.col("video_id").alias("fid"), F.col("uncovered").alias("u"))
    base = F.first("u").over(Window.partitionBy("seg").orderBy("fid"))
    return g.withColumn("base", base).where(F.col("u") > F.col("base") + 0.01).groupBy("seg").agg(F.min("fid").alias("fid"))


@query(COVER.replace("with ", "with recursive ", 1) + ", g as (select video_id // 100 as seg, video_id as fid, round(1 - area / 45000.0, 6)::double as u from c), p as (select seg, 0 as pass_no, min(fid) as fid, arg_min(u, fid) as u from g group by 1 union all (select p.seg, p.pass_no + 1, min(g.fid), arg_min(g.u, g.fid) from p join g on g.seg = p.seg and g.fid > p.fid and g.u > p.u + 0.01 group by p.seg, p.pass_no)) select seg, pass_no, fid from p")
def propagation_passes(spark: SparkSession, d: str) -> DataFrame:
    """All starts of a segment's propagation until its frames are covered as well as at the last one."""
    from chronoscene.operators.tracking import restart_frames

    # Bands are summed and segments followed in one order of the frames, so what the blocks give is shuffled once.
    seg = F.floor(F.col("fid") / 100)
    parts = covered_parts(boxes(spark, d)).where("video_id is not null").withColumnRenamed("video_id", "fid")
    c = summed(parts.repartition(partitions_for(spark), seg).sortWithinPartitions("fid"), "fid")
    return restart_frames(c.select(seg.alias("seg"), "fid", F.round(1 - F.col("area") / (300.0 * 150), 6).alias("u")), "seg", "fid", "u", ordered=True)


def merged(known: DataFrame, new: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Boxes of ``known`` and those of ``new`` that overlap none of them by more than ``threshold``; above it a box is already present."""
    k = known.select(F.col("video_id").alias("v"), F.col("b").alias("q"))
    fresh = new.join(k, (F.col("video_id") == F.col("v")) & (geo.iou(F.col("b"), F.col("q")) > threshold), "left_anti")
    return known.select("video_id", "id").union(fresh.select("video_id", "id")).distinct()


@query(BOXES + f", k as (select * from r where id <= 2), n as (select * from r where id > 2) select distinct video_id, id from k union select distinct a.video_id, a.id from n a where not exists (select 1 from k b where a.video_id = b.video_id and {_W} * 1.0 / ({_A('a')} + {_A('b')} - {_W}) > 0.3)")
def merge_annotated_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Annotated boxes and those detections that overlap none of them by more than the 0.3 of its oracle; see ``merge_present_boxes``."""
    r = boxes(spark, d)
    return merged(r.where("id <= 2"), r.where("id > 2"), 0.3)


@query(BOXES + f", k as (select * from r where id <= 2), n as (select * from r where id > 2) select distinct video_id, id from k union select distinct a.video_id, a.id from n a where not exists (select 1 from k b where a.video_id = b.video_id and {_W} * 1.0 / ({_A('a')} + {_A('b')} - {_W}) > 0.7)")
def merge_present_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Annotated boxes and all detections but those already present, which overlap an annotated box by more than 0.7."""
    r = boxes(spark, d)
    return merged(r.where("id <= 2"), r.where("id > 2"))


@query("select video_id, i // 2 as batch, string_agg(caption_id::varchar, ',' order by i) as ids from (select video_id, caption_id, row_number() over (partition by video_id order by caption_id) - 1 as i from caption_descriptions where video_id is not null) group by 1, 2 having count(*) = 2")
def batches_drop_last(spark: SparkSession, d: str) -> DataFrame:
    """Batches of two captions of a video in order; an incomplete last one is left out."""
    c = table(spark, d, "caption_descriptions").where("video_id is not null").select("video_id", "caption_id")
    c = c.withColumn("i", F.row_number().over(Window.partitionBy("video_id").orderBy("caption_id")) - 1).withColumn("batch", F.floor(F.col("i") / 2))
    ids = F.transform(F.array_sort(F.collect_list("caption_id")), lambda x: x.cast("string"))
    return c.groupBy("video_id", "batch").agg(F.array_join(ids, ",").alias("ids"), F.count("*").alias("n")).where("n = 2").drop("n")


@query("select video_id from (select video_id, row_number() over (order by md5(video_id), video_id) as r, count(*) over () as n from videos) where r <= floor(0.3 * n)")
def percent_limit(spark: SparkSession, d: str) -> DataFrame:
    """Three tenths of the videos in a fixed random order; the feature itself is a sample, its ranks come from a range sort."""
    from chronoscene.operators.rangescan import prefix_sum

    v = table(spark, d, "videos").select("video_id", F.md5("video_id").alias("h"), F.lit("").alias("all"), F.lit(1).alias("one"))
    ranked = prefix_sum(v, "all", ["h", "video_id"], "one", "_b", "rank")
    n = v.agg(F.count("*").alias("n"))
    return ranked.crossJoin(F.broadcast(n)).where(F.col("rank") < F.floor(F.col("n") * 0.3)).select("video_id")


@query(FR + ", nu as (select video_id, fid, row_number() over (partition by video_id order by fid) - 1 as i from fr) select video_id, fid, i - 3 as new_fid from nu where i >= 3 and i < 8")
def frames_slice(spark: SparkSession, d: str) -> DataFrame:
    """The frames from the fourth to the eighth of each video, numbered anew."""
    w = Window.partitionBy("video_id").orderBy("fid")
    f = _frames(spark, d).select("video_id", "fid").withColumn("i", F.row_number().over(w) - 1)
    return f.where("i >= 3 and i < 8").select("video_id", "fid", (F.col("i") - 3).alias("new_fid"))


def fact_rows(formula: object) -> list[tuple[int, int | None, str, str]]:
    """(id, parent, construct, text) of each node of a formula, numbered in reading order from 1."""
    out: list[tuple[int, int | None, str, str]] = []

    def add(node: object, parent: int | None) -> None:
        number = len(out) + 1
        out.append((number, parent, type(node).__name__, stsl.show(node)))
        for child in vars(node).values():
            if not isinstance(child, (str, int, stsl.Var, stsl.Const)):
                add(child, number)

    add(formula, None)
    return out


@query()
def spec_fact_rows(spark: SparkSession, d: str) -> DataFrame:
    """Edge table of the compiled programs of all events."""
    from collections.abc import Iterator

    import pandas as pd

    from chronoscene.plans.program import compiled_programs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, p in zip(b["row_id"], b["prog"], strict=True) for r in fact_rows(stsl.parse(p))]
            yield pd.DataFrame(rows, columns=["row_id", "id", "parent", "construct", "text"]).astype({"parent": "Int32"})

    progs = compiled_programs(table(spark, d, "timestamp_descriptions"), "row_id", "programmatic").where("prog is not null")
    return progs.select("row_id", "prog").mapInPandas(run, "row_id long, id int, parent int, construct string, text string")
