"""Queries of scene-graph construction, scoring, metrics, losses, geometry and proofs, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from chronoscene.functions import geometry as geo
from chronoscene.operators import graph, metrics, scoring
from chronoscene.operators.rangescan import prefix_sum
from chronoscene.plans.stsl_queries import FACTS
from chronoscene.sources import adapters
from chronoscene.storage import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a function of (spark, sf_dir) under its name, with its oracle."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def facts(body: str) -> str:
    return f"with {FACTS} {body}"


U = adapters.unary_atoms
REL = """with r as (select l_orderkey as video_id, l_suppkey as oid, l_linenumber - 1 as fid, l_quantity * l_extendedprice as area, o_orderdate::date as begin_date, l_shipdate::date as end_date
from lineitem join orders on l_orderkey = o_orderkey)"""


# --- construction -------------------------------------------------------------------------------------------------


@query(facts("select video_id, t from tm"))
def sg_time_domain(spark: SparkSession, d: str) -> DataFrame:
    return adapters.time_domain(U(spark, d))


@query(facts("select distinct x.video_id, x.fid, x.oid as o1, y.oid as o2 from u x join u y on x.video_id = y.video_id and x.fid = y.fid and x.oid <> y.oid"))
def sg_object_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.object_pairs(U(spark, d))


@query(facts("select distinct x.video_id, x.fid, x.oid as o1, y.oid as o2 from u x join u y on x.video_id = y.video_id and x.fid = y.fid where (x.oid, y.oid) in ((1, 2), (2, 1), (3, 5), (4, 6))"))
def sg_pairs_of_interest(spark: SparkSession, d: str) -> DataFrame:
    return graph.pairs_of_interest(graph.object_pairs(U(spark, d)), spark.createDataFrame([(1, 2), (2, 1), (3, 5), (4, 6)], "o1 int, o2 int"))


@query(REL + " select * from (select video_id, fid // 3 as frame, oid, fid, row_number() over (partition by video_id, fid // 3 order by area desc, fid) as rank from r) where rank <= 2")
def sg_topk_objects_per_frame(spark: SparkSession, d: str) -> DataFrame:
    r = adapters.relations(spark, d).withColumn("frame", F.floor(F.col("fid") / 3))
    return graph.top_per(r, ["video_id", "frame"], [F.desc("area"), F.asc("fid")], 2).select("video_id", "frame", "oid", "fid", "rank")


@query(REL + " select * from (select f.video_id, f.fid as frame, r.fid, row_number() over (partition by f.video_id, f.fid order by r.area desc, r.fid) as rank from r f join r on r.video_id = f.video_id and r.fid <= f.fid) where rank <= 3")
def sg_topk_cumulative(spark: SparkSession, d: str) -> DataFrame:
    r = adapters.relations(spark, d).select("video_id", "fid", "area")
    return graph.top_so_far(r, "video_id", "fid", "area", 3).select("video_id", F.col("frame_no").alias("frame"), "fid", "rank")


@query(REL + ", days as (select unnest(generate_series(date '1995-03-01', date '1995-03-31', interval 1 day))::date as day) select video_id, oid, fid, day from r join days on day >= begin_date and day < end_date")
def sg_interval_join(spark: SparkSession, d: str) -> DataFrame:
    r = adapters.relations(spark, d)
    return graph.days_of_interval(r, F.col("begin_date"), F.col("end_date"), "1995-03-01", "1995-03-31").select("video_id", "oid", "fid", "day")


@query(REL + ", days as (select *, unnest(generate_series(0, 6)) as n from r) select video_id, oid, fid, begin_date + (30 + n)::int as day from days where begin_date + (30 + n)::int < end_date")
def sg_interval_overlap_expand(spark: SparkSession, d: str) -> DataFrame:
    r = adapters.relations(spark, d)
    return graph.overlap_days(r, F.col("begin_date"), F.col("end_date"), F.date_add("begin_date", 30), F.date_add("begin_date", 37)).select("video_id", "oid", "fid", "day")


FRAMES = ", fr as (select distinct video_id, fid from u), nu as (select *, row_number() over (partition by video_id order by fid) - 1 as i, count(*) over (partition by video_id) as n from fr)"


@query(facts(FRAMES + " select video_id, fid, i // ceil(n / 5.0)::int as new_fid from nu where i % ceil(n / 5.0)::int = 0"))
def sg_stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return graph.frame_sample(U(spark, d), "stride", 5)


@query(facts(FRAMES + " select video_id, fid, i // greatest(1, n // 5) as new_fid from nu where i % greatest(1, n // 5) = 0 and i // greatest(1, n // 5) < 5"))
def sg_range_sample(spark: SparkSession, d: str) -> DataFrame:
    return graph.frame_sample(U(spark, d), "range", 5)


@query(facts(FRAMES + " select video_id, fid, j as new_fid from nu join (select unnest(range(0, 4)) as j) on i = (j * (n - 1)) // 3"))
def sg_linspace_sample(spark: SparkSession, d: str) -> DataFrame:
    return graph.frame_sample(U(spark, d), "linspace", 4)


@query(facts(", k as (select video_id, fid, oid from (select *, row_number() over (partition by video_id, fid order by p desc, oid) as n from (select video_id, fid, oid, max(prob) as p from u group by 1, 2, 3)) where n <= 2) "
             "select b.video_id, b.fid, predicate, o1, o2 from b where exists (select 1 from k where k.video_id = b.video_id and k.fid = b.fid and k.oid = o1) and exists (select 1 from k where k.video_id = b.video_id and k.fid = b.fid and k.oid = o2)"))
def sg_relation_semi_join(spark: SparkSession, d: str) -> DataFrame:
    u = U(spark, d)
    best = u.groupBy("video_id", "fid", "oid").agg(F.max("prob").alias("p"))
    kept = graph.top_per(best, ["video_id", "fid"], [F.desc("p"), F.asc("oid")], 2)
    return graph.kept_relations(adapters.binary_atoms(u), kept).select("video_id", "fid", "predicate", "o1", "o2")


@query(facts(FRAMES + ", nx as (select *, lead(fid) over (partition by video_id order by fid) as nf from fr) select video_id, fid from fr union select video_id, unnest(range(fid, nf, 3)) from nx where nf - fid > 3"))
def sg_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return graph.gap_fill(U(spark, d), 3)


@query(facts(FRAMES + ", c as (select video_id, count(*) as frames from fr group by 1) select video_id, frames, coalesce(sum(frames) over (order by video_id rows between unbounded preceding and 1 preceding), 0)::bigint as first_frame from c"))
def sg_frame_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of the videos in the concatenation of all frames; the one global order is cut into ranges, not sent to one task."""
    return _splits(spark, d).select("video_id", "frames", "first_frame")


def _splits(spark: SparkSession, d: str) -> DataFrame:
    counts = U(spark, d).groupBy("video_id").agg(F.count_distinct("fid").alias("frames")).withColumn("all", F.lit(""))
    return prefix_sum(counts, "all", ["video_id"], "frames", "first_frame")


@query(facts(FRAMES + ", c as (select video_id, count(*) as frames from fr group by 1), o as (select video_id, sum(frames) over (order by video_id) as last from c) select video_id, (last - coalesce(lag(last) over (order by video_id), 0))::bigint as frames from o"))
def sg_frame_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the videos from the split offsets alone: each split less the one ranked before it."""
    splits = _splits(spark, d).select("video_id", "rank", (F.col("first_frame") + F.col("frames")).alias("last"))
    before = splits.select((F.col("rank") + 1).alias("rank"), F.col("last").alias("prior"))
    return splits.join(before, "rank", "left").select("video_id", (F.col("last") - F.coalesce("prior", F.lit(0))).alias("frames"))


@query(facts(", c as (select video_id, fid, count(distinct oid) as n from u group by 1, 2) select video_id, fid, n from (select *, row_number() over (partition by video_id order by n desc, fid) as k from c) where k = 1"))
def sg_densest_frame(spark: SparkSession, d: str) -> DataFrame:
    c = U(spark, d).groupBy("video_id", "fid").agg(F.count_distinct("oid").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "fid"))
    return c.groupBy("video_id").agg(best.alias("b")).select("video_id", "b.fid", (-F.col("b.m")).alias("n"))


@query(facts(", c as (select video_id, fid, count(distinct oid) as n from u group by 1, 2), o as (select distinct video_id, oid, fid from u) select video_id, oid, fid, k from (select o.*, row_number() over (partition by video_id, oid order by n desc, fid) as k from o join c using (video_id, fid)) where k <= 2"))
def sg_densest_frames_per_object(spark: SparkSession, d: str) -> DataFrame:
    u = U(spark, d).select("video_id", "fid", "oid").distinct()
    dense = u.groupBy("video_id", "fid").agg(F.count("*").alias("n"))
    return graph.top_per(u.join(dense, ["video_id", "fid"]), ["video_id", "oid"], [F.desc("n"), F.asc("fid")], 2, "k").select("video_id", "oid", "fid", "k")


@query(facts(", m as (select video_id, oid, predicate, fid from u where predicate = 'click'), f as (select video_id, oid, fid from u where predicate = 'view') "
             "select video_id, oid, fid, near from (select f.*, m.fid as near, row_number() over (partition by f.video_id, f.oid, f.fid order by abs(m.fid - f.fid), m.fid) as k from f join m on f.video_id = m.video_id and f.oid = m.oid) where k = 1"))
def sg_nearest_frame(spark: SparkSession, d: str) -> DataFrame:
    """As-of join to the nearest stored frame of a track, before or after, without a join: last and next known frame in order."""
    u = U(spark, d).where(F.col("predicate").isin("click", "view")).groupBy("video_id", "oid", "fid").agg(
        F.bool_or(F.col("predicate") == "click").alias("stored"), F.bool_or(F.col("predicate") == "view").alias("asked")
    )
    w = Window.partitionBy("video_id", "oid").orderBy("fid")
    at = F.when(F.col("stored"), F.col("fid"))
    u = u.withColumn("a", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    near = F.when(F.col("b").isNull() | (F.col("fid") - F.col("a") <= F.col("b") - F.col("fid")), F.col("a")).otherwise(F.col("b"))
    return u.where("asked").withColumn("near", near).where("near is not null").select("video_id", "oid", "fid", "near")


# --- scoring ------------------------------------------------------------------------------------------------------

SIM = """with dm as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings),
mean as (select label as keyword, i, avg(v) as m from dm group by 1, 2), n2 as (select keyword, sqrt(sum(m * m)) as n from mean group by 1), n1 as (select vec_id, sqrt(sum(v * v)) as n from dm group by 1),
dt as (select vec_id, label, keyword, sum(v * m) as s from dm join mean using (i) group by 1, 2, 3), sim as (select dt.vec_id, label, dt.keyword, s / (n1.n * n2.n) as sim from dt join n1 using (vec_id) join n2 using (keyword))"""


def _sim(spark: SparkSession, d: str) -> DataFrame:
    return scoring.keyword_similarity(table(spark, d, "embeddings").select("vec_id", "label", "embedding"))


@query(SIM + " select vec_id, keyword, round(sim, 6) as sim from sim")
def score_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _sim(spark, d).select("vec_id", "keyword", F.round("sim", 6).alias("sim"))


@query(SIM + " select vec_id, keyword, round(exp(10 * sim) / sum(exp(10 * sim)) over (partition by vec_id), 6) as prob from sim")
def score_softmax(spark: SparkSession, d: str) -> DataFrame:
    s = _sim(spark, d)
    return s.select("vec_id", "keyword", F.round(scoring.softmax(10 * F.col("sim"), ["vec_id"]), 6).alias("prob"))


@query(SIM + " select vec_id, keyword, round(1 / (1 + exp(-10 * sim)), 6) as prob from sim")
def score_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    return _sim(spark, d).select("vec_id", "keyword", F.round(scoring.sigmoid(10 * F.col("sim")), 6).alias("prob"))


@query(facts("select video_id, oid, predicate, sum(round(prob * 1000000)::bigint) / count(*) / 1000000.0::double as prob from u group by 1, 2, 3"))
def score_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    return scoring.mean_pool(U(spark, d), ["video_id", "oid", "predicate"])


@query(facts("select video_id, oid, predicate, arg_max(prob, fid) as prob from u group by 1, 2, 3"))
def score_last_pool(spark: SparkSession, d: str) -> DataFrame:
    return scoring.last_pool(U(spark, d), ["video_id", "oid", "predicate"])


TOP3 = ", pool as (select video_id, oid, predicate as name, sum(round(prob * 1000000)::bigint) / count(*) / 1000000.0::double as prob from u group by 1, 2, 3), top3 as (select * from (select *, row_number() over (partition by video_id, name order by prob desc, oid desc) as rank from pool) where rank <= 3)"


def _top3(spark: SparkSession, d: str) -> DataFrame:
    pool = scoring.mean_pool(U(spark, d), ["video_id", "oid", "predicate"]).withColumnRenamed("predicate", "name")
    return graph.top_per(pool, ["video_id", "name"], [F.desc("prob"), F.desc("oid")], 3)


@query(facts(TOP3 + " select video_id, name, oid, prob, rank from top3"))
def score_topk_category(spark: SparkSession, d: str) -> DataFrame:
    return _top3(spark, d).select("video_id", "name", "oid", "prob", "rank")


@query(facts(TOP3 + ", w as (select * from (values ('holds', 'click', 'view'), ('near', 'view', 'purchase')) x(predicate, from_name, to_name)), pr as (select distinct x.video_id, x.fid, x.oid as o1, y.oid as o2 from u x join u y on x.video_id = y.video_id and x.fid = y.fid and x.oid <> y.oid) "
             "select distinct pr.video_id, pr.fid, w.predicate, o1, o2 from w join top3 a on a.name = from_name join top3 b on b.name = to_name and a.video_id = b.video_id join pr on pr.video_id = a.video_id and o1 = a.oid and o2 = b.oid"))
def score_pruned_pairs(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("holds", "click", "view"), ("near", "view", "purchase")], "predicate string, from_name string, to_name string")
    return scoring.pruned_pairs(_top3(spark, d).select("video_id", "name", "oid"), wanted, graph.object_pairs(U(spark, d)))


@query(facts(TOP3 + " select video_id, name, string_agg(printf('%.2f', prob) || '::' || oid, chr(10) order by rank) as line from top3 group by 1, 2"))
def score_topk_format(spark: SparkSession, d: str) -> DataFrame:
    t = _top3(spark, d).withColumn("s", F.format_string("%.2f::%s", "prob", F.col("oid").cast("string")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"]), "\n")
    return t.groupBy("video_id", "name").agg(lines.alias("line"))


# --- metrics ------------------------------------------------------------------------------------------------------


@query(SIM + ", rk as (select *, row_number() over (partition by vec_id order by round(sim, 9) desc, keyword desc) as rank from sim), h as (select vec_id, k, max((rank <= k and keyword = label)::int) as hit from rk, (values (1), (5), (10)) x(k) group by 1, 2) select k, round(avg(hit / k), 6) as precision, round(avg(hit), 6) as recall from h group by 1")
def metric_precision_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("vec_id").orderBy(F.desc(F.round("sim", 9)), F.desc("keyword"))
    r = _sim(spark, d).select(F.col("vec_id").alias("item"), F.row_number().over(w).alias("rank"), (F.col("keyword") == F.col("label")).alias("match"))
    m = metrics.ranked_hits(r, [1, 5, 10], [])
    return m.select("k", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""with fa as (select distinct video_id, fid, gt_labels, gt_instance_ids from frame_annotations), el as (select video_id, fid, i, gt_labels[i] as label, gt_instance_ids[i] as oid from (select *, generate_subscripts(gt_instance_ids, 1) as i from fa))
select video_id, fid, oid, arg_max(label, i) as label from el where oid is not null and label is not null group by 1, 2, 3""")
def metric_gt_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """One label per object of a frame: the last one in the order of the annotation."""
    f = table(spark, d, "frame_annotations").select("video_id", "fid", "gt_labels", "gt_instance_ids").distinct()
    at = f.select("video_id", "fid", "gt_labels", F.posexplode("gt_instance_ids").alias("i", "oid")).withColumn("label", F.get("gt_labels", F.col("i")))
    return at.where("oid is not null and label is not null").groupBy("video_id", "fid", "oid").agg(F.max_by("label", "i").alias("label"))


@query("""with t as (select coalesce(lang, 'none') as lang, n_chars > 900 as gt, length(coalesce(text, '')) > 900 and source is not null as pred from documents),
c as (select lang, count(*) as n, count(*) filter (gt and pred) as tp, count(*) filter (not gt and pred) as fp, count(*) filter (gt and not pred) as fn, count(*) filter (gt = pred) as ok from t group by 1),
m as (select lang, n, ok / n as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall, n / sum(n) over () as share from c)
select lang, n, round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall, round(share, 6) as share, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) as f1 from m""")
def metric_prf1_by_predicate(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), (F.col("n_chars") > 900).alias("gt"), ((F.length(F.coalesce("text", F.lit(""))) > 900) & F.col("source").isNotNull()).alias("pred")).where("gt is not null")
    m = metrics.classification_report(t, "lang", F.col("gt"), F.col("pred"))
    return m.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "share", "f1")])


@query(SIM + ", rk as (select *, row_number() over (partition by vec_id order by round(sim, 9) desc, keyword desc) as rank from sim) select vec_id, case when max((rank = 1 and keyword = label)::int) = 1 then 'top1' when max((rank <= 3 and keyword = label)::int) = 1 then 'topk' else 'wrong' end as color from rk group by 1")
def metric_correctness_color(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("vec_id").orderBy(F.desc(F.round("sim", 9)), F.desc("keyword"))
    r = _sim(spark, d).withColumn("rank", F.row_number().over(w)).where("keyword = label")
    return r.select("vec_id", F.when(F.col("rank") == 1, "top1").when(F.col("rank") <= 3, "topk").otherwise("wrong").alias("color"))


@query(REL + """, s as (select video_id, fid, oid, datediff('day', date '1992-01-01', begin_date) as s1, datediff('day', date '1992-01-01', end_date) as e1, datediff('day', date '1992-01-01', begin_date) + 15 as s2 from r),
i as (select *, greatest(least(e1, s2 + 40) - greatest(s1, s2), 0) as i from s) select video_id, fid, oid, round(case when greatest(e1 - s1, 0) + 40 - i > 0 then i / (greatest(e1 - s1, 0) + 40 - i) else 0 end, 6) as iou from i""")
def metric_span_iou(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.date_diff(F.col(c), F.lit("1992-01-01").cast("date"))
    r = adapters.relations(spark, d).select("video_id", "fid", "oid", day("begin_date").alias("s1"), day("end_date").alias("e1"))
    return r.select("video_id", "fid", "oid", F.round(geo.span_iou(F.col("s1"), F.col("e1"), F.col("s1") + 15, F.col("s1") + 55), 6).alias("iou"))


@query(facts("select predicate || ', ' || printf('%.4f', count(*) / sum(count(*)) over ()) || ', ' || printf('%.4f', avg(prob)) as line from u group by predicate"))
def report_format(spark: SparkSession, d: str) -> DataFrame:
    c = U(spark, d).groupBy("predicate").agg(F.count("*").alias("n"), F.avg("prob").alias("p"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select(F.format_string("%s, %.4f, %.4f", "predicate", F.col("n") / F.col("total"), "p").alias("line"))


@query(facts("select video_id, fid, predicate, prob, sum(round(prob * 1000000)::bigint) over w / count(*) over w / 1000000.0::double as running from u where predicate = 'click' window w as (partition by video_id order by fid, predicate, oid rows unbounded preceding)"))
def metric_running_mean(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("fid", "predicate", "oid").rowsBetween(Window.unboundedPreceding, 0)
    return U(spark, d).where("predicate = 'click'").select("video_id", "fid", "predicate", "prob", (F.sum(F.round(F.col("prob") * 1e6).cast("long")).over(w) / F.count("*").over(w) / 1e6).alias("running"))


# --- losses -------------------------------------------------------------------------------------------------------

LOSS = "-greatest(case when prob > 0 then ln(prob) else -100 end, -100)"


def _video_frames(spark: SparkSession, d: str) -> DataFrame:
    u = U(spark, d)
    n = u.groupBy("video_id").agg((F.max("fid") + 1).alias("n"))
    return u.join(n, "video_id")


@query(facts(f""", c as (select u.*, mx.m + 1 as n, ceil((mx.m + 1) * 0.3) as l from u join mx using (video_id)),
w as (select video_id, predicate, {LOSS} as loss, case predicate when 'view' then case when fid <= l then (l - fid + 1) / l else 0 end when 'purchase' then case when fid >= n - l then (fid - (n - l) + 1) / l else 0 end
  when 'click' then case when abs(ceil(n / 2.0) - fid) <= ceil(l / 2) then (ceil(l / 2) - abs(ceil(n / 2.0) - fid) + 1) / l else 0 end end as weight from c where predicate in ('view', 'click', 'purchase')),
e as (select video_id, predicate, sum(weight * loss) / sum(weight) as loss from w where weight > 0 group by 1, 2) select video_id, round(avg(loss), 6) as loss from e group by 1"""))
def loss_coarse(spark: SparkSession, d: str) -> DataFrame:
    c = _video_frames(spark, d)
    where = {"view": "early", "click": "mid", "purchase": "late"}
    weight = F.coalesce(*[F.when(F.col("predicate") == p, metrics.coarse_weight(label, F.col("fid"), F.col("n"))) for p, label in where.items()])
    w = c.withColumn("weight", weight).where("weight > 0").withColumn("loss", metrics.cross_entropy(F.col("prob"), F.lit(1.0)))
    events = w.groupBy("video_id", "predicate").agg((F.sum(F.col("weight") * F.col("loss")) / F.sum("weight")).alias("loss"))
    return events.groupBy("video_id").agg(F.round(F.avg("loss"), 6).alias("loss"))


@query(facts(f""", p as (select * from (values ('view', 0.0, 0.25), ('click', 0.25, 0.75), ('purchase', 0.75, 1.0)) x(predicate, s, e)),
w as (select video_id, predicate, {LOSS} as loss, greatest(0, 1 - abs(fid / (mx.m + 1) - (s + e) / 2) / (e - s + 0.5)) as weight from u join mx using (video_id) join p using (predicate)),
e as (select video_id, predicate, sum(weight * loss) / sum(weight) as loss from w where weight > 0 group by 1, 2) select video_id, round(avg(loss), 6) as loss from e group by 1"""))
def loss_fine(spark: SparkSession, d: str) -> DataFrame:
    c = _video_frames(spark, d)
    periods = spark.createDataFrame([("view", 0.0, 0.25), ("click", 0.25, 0.75), ("purchase", 0.75, 1.0)], "predicate string, s double, e double")
    w = c.join(periods, "predicate").withColumn("weight", metrics.fine_weight(F.col("fid"), F.col("n"), F.col("s"), F.col("e"))).where("weight > 0")
    w = w.withColumn("loss", metrics.cross_entropy(F.col("prob"), F.lit(1.0)))
    events = w.groupBy("video_id", "predicate").agg((F.sum(F.col("weight") * F.col("loss")) / F.sum("weight")).alias("loss"))
    return events.groupBy("video_id").agg(F.round(F.avg("loss"), 6).alias("loss"))


NEG = "case when 1 - prob > 0 then -greatest(ln(1 - prob), -100) else 100 end"


@query(facts(f"select video_id, round(sum({NEG}), 6) as loss from u where predicate in ('error', 'signup') group by 1"))
def loss_negative_keywords(spark: SparkSession, d: str) -> DataFrame:
    negatives = spark.createDataFrame([("error",), ("signup",)], "predicate string")
    u = U(spark, d).join(negatives, "predicate", "left_semi")
    return u.groupBy("video_id").agg(F.round(F.sum(metrics.cross_entropy(F.col("prob"), F.lit(0.0))), 6).alias("loss"))


@query(facts(f"select video_id, round(sum(w * loss), 6) as loss from (select video_id, 1.0 as w, avg({LOSS}) as loss from u where predicate = 'click' group by 1 union all select video_id, 0.1, avg({NEG}) from u where predicate = 'error' group by 1) group by 1"))
def loss_combined(spark: SparkSession, d: str) -> DataFrame:
    u = U(spark, d)
    part = lambda p, y, w: u.where(F.col("predicate") == p).groupBy("video_id").agg((w * F.avg(metrics.cross_entropy(F.col("prob"), F.lit(y)))).alias("loss"))
    return part("click", 1.0, F.lit(1.0)).unionAll(part("error", 0.0, F.lit(0.1))).groupBy("video_id").agg(F.round(F.sum("loss"), 6).alias("loss"))


# --- geometry -----------------------------------------------------------------------------------------------------

BOXES = """with r as (select l_orderkey as video_id, l_linenumber as id, (l_partkey % 200)::int as x1, (l_suppkey % 100)::int as y1, (l_partkey % 200 + 20 + l_linenumber * 7)::int as x2, (l_suppkey % 100 + 15 + (l_orderkey % 30))::int as y2, l_extendedprice as score from lineitem)"""
_W = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1, 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1, 0)"
_A = lambda x: f"(({x}.x2 - {x}.x1 + 1) * ({x}.y2 - {x}.y1 + 1))"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """``(video_id, id, b, score)`` derived from line items."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x, y = (F.col("l_partkey") % 200).cast("int"), (F.col("l_suppkey") % 100).cast("int")
    b = geo.box(x, y, (x + 20 + F.col("l_linenumber") * 7).cast("int"), (y + 15 + F.col("l_orderkey") % 30).cast("int"))
    return li.select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("id"), b.alias("b"), F.col("l_extendedprice").alias("score"))


def _box_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = boxes(spark, d)
    left = r.select("video_id", F.col("id").alias("i"), F.col("b").alias("p"), F.col("score").alias("si"))
    return left.join(r.select("video_id", F.col("id").alias("j"), F.col("b").alias("q"), F.col("score").alias("sj")), "video_id").where("i < j")


@query(BOXES + f" select a.video_id, a.id as i, b.id as j, round({_W} / ({_A('a')} + {_A('b')} - {_W}), 6) as iou from r a join r b on a.video_id = b.video_id and a.id < b.id where {_W} > 0")
def geom_bbox_iou(spark: SparkSession, d: str) -> DataFrame:
    v = geo.iou(F.col("p"), F.col("q"))
    return _box_pairs(spark, d).select("video_id", "i", "j", F.round(v, 6).alias("iou")).where("iou > 0")


@query(BOXES + " select video_id, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from r group by 1")
def geom_bbox_hull(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("video_id", "b.*").groupBy("video_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


@query(BOXES + " select video_id, id, least(greatest(x1 - 50, 0), 150) as x1, least(greatest(y1 - 50, 0), 80) as y1, least(greatest(x2 - 50, 0), 150) as x2, least(greatest(y2 - 50, 0), 80) as y2 from r")
def geom_clamp(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("b")
    c = lambda f, top: geo.clamp(b[f] - 50, F.lit(top)).alias(f)
    return boxes(spark, d).select("video_id", "id", c("x1", 150), c("y1", 80), c("x2", 150), c("y2", 80))


@query(BOXES + " select video_id, id, least(x1, 180) as x1, least(y1, 90) as y1, least(x1 + (x2 - x1), 180) as x2, least(y1 + (y2 - y1), 90) as y2 from r")
def geom_convert_xywh(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("b")
    v = geo.from_xywh(b["x1"], b["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"], F.lit(180), F.lit(90))
    return boxes(spark, d).select("video_id", "id", F.inline(F.array(v)))


@query(BOXES + " select video_id, id, floor(x1 / 1.5)::int as x1, floor(y1 / 0.5)::int as y1, floor(x2 / 1.5)::int as x2, floor(y2 / 0.5)::int as y2 from r")
def geom_resize(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("video_id", "id", F.inline(F.array(geo.resized(F.col("b"), F.lit(1.5), F.lit(0.5)))))


@query(BOXES + " select video_id, id, greatest(x1 - (x2 - x1) * 0.25, 0)::double as x, greatest(y1 - (y2 - y1) * 0.25, 0)::double as y, least((x2 - x1) * 1.5, 220 - greatest(x1 - (x2 - x1) * 0.25, 0))::double as w, least((y2 - y1) * 1.5, 120 - greatest(y1 - (y2 - y1) * 0.25, 0))::double as h from r")
def geom_enlarge(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("b")
    return boxes(spark, d).select("video_id", "id", F.inline(F.array(geo.enlarged(b["x1"], b["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"], 1.5, F.lit(220.0), F.lit(120.0)))))


@query(BOXES + """, k as (select video_id, id, unnest([1, 2, 3, 4]) as c, unnest([x1, x2, x1, x2]) as x, unnest([y1, y1, y2, y2]) as y from r)
select video_id, i, j, round(sqrt(d), 6) as distance, ca as corner_a, cb as corner_b from (select a.video_id, a.id as i, b.id as j, a.c as ca, b.c as cb, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d, row_number() over (partition by a.video_id, a.id, b.id order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), a.c, b.c) as n
from k a join k b on a.video_id = b.video_id and a.id < b.id) where n = 1""")
def geom_nearest_corner(spark: SparkSession, d: str) -> DataFrame:
    c = _box_pairs(spark, d).groupBy("video_id", "i", "j").agg(F.min(geo.nearest_corners(F.col("p"), F.col("q"))).alias("c"))
    return c.select("video_id", "i", "j", F.round("c.distance", 6).alias("distance"), "c.corner_a", "c.corner_b")


@query(BOXES + " select video_id, id, (least(x2, 199) - least(x1, 199) + 1)::bigint * (least(y2, 99) - least(y1, 99) + 1) as area, least(x1, 199) as x, least(y1, 99) as y, least(x2, 199) - least(x1, 199) + 1 as w, least(y2, 99) - least(y1, 99) + 1 as h from r")
def geom_mask_runs(spark: SparkSession, d: str) -> DataFrame:
    """Box to run-length mask and back: area and bounding box of the mask."""
    m = boxes(spark, d).withColumn("m", geo.box_runs(F.col("b"), F.lit(200), F.lit(100)))
    return m.select("video_id", "id", geo.runs_area(F.col("m")).alias("area"), F.inline(F.array(geo.runs_xywh(F.col("m")))))


def mask_nms(items: DataFrame, iou_threshold: float = 0.7, score_threshold: float = 0.1, inner_threshold: float = 0.2, image: tuple[str, ...] = ("video_id", "fid")) -> DataFrame:
    """Non-maximum suppression of ``items (image, id, b, score)`` per image, set-based: ``(image, id)`` kept.

    Ranks follow the score (ties: id). A mask goes if a better one overlaps it above ``iou_threshold``; if it or its
    counterpart lies mostly (85 %) inside the other, which it fills by less than half, with 1 - product above
    1 - ``inner_threshold`` (the lower direction only for the neighbour ranked right after); or if its score is low. Where
    a criterion leaves nothing of an image, its three best masks pass that criterion.
    """
    w = Window.partitionBy(*image)
    r = items.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), F.asc("id"))))
    a = r.select(*image, F.col("n").alias("i"), F.col("b").alias("p"))
    b = r.select(*image, F.col("n").alias("j"), F.col("b").alias("q"))
    pair = a.join(b, list(image)).where("i < j")
    both = geo.iou(F.col("p"), F.col("q"))
    inter = both / (1 + both) * (geo.area(F.col("p")) + geo.area(F.col("q")))
    in_i, in_j = inter / geo.area(F.col("p")), inter / geo.area(F.col("q"))
    inner = 1 - in_i * in_j
    pair = pair.select(*image, "i", "j", both.alias("iou"), F.when((in_i < 0.5) & (in_j >= 0.85), inner).otherwise(0.0).alias("up"), F.when((in_i >= 0.85) & (in_j < 0.5), inner).otherwise(0.0).alias("low"))
    worse = pair.groupBy(*image, F.col("j").alias("n")).agg(F.max("iou").alias("iou"), F.max("up").alias("up"))
    # Entry (j, i) counts for mask i; of the upper triangle only the first superdiagonal is left, which holds the upper entries.
    lower = pair.groupBy(*image, F.col("i").alias("n")).agg(F.max("low").alias("low"))
    super_diagonal = pair.where("j = i + 1").select(*image, F.col("j").alias("n"), F.col("up").alias("next_up"))
    full = r.join(worse, [*image, "n"], "left").join(lower, [*image, "n"], "left").join(super_diagonal, [*image, "n"], "left").na.fill(0.0, ["iou", "up", "low", "next_up"])
    full = full.select(*image, "id", "n", (F.col("iou") <= iou_threshold).alias("k0"), (F.col("score") > score_threshold).alias("k1"), (F.col("up") <= 1 - inner_threshold).alias("k2"), (F.greatest("low", "next_up") <= 1 - inner_threshold).alias("k3"))
    for k in ("k1", "k2", "k3"):
        full = full.withColumn(k, F.col(k) | (~F.bool_or(k).over(w) & (F.col("n") <= 3)))
    return full.where("k0 and k1 and k2 and k3").select(*image, "id")


@query(BOXES + f""", s as (select *, row_number() over (partition by video_id order by score desc, id) as n, score / 60000 as conf from r),
p as (select a.video_id, a.n as i, b.n as j, {_W} as o, {_A('a')} as sa, {_A('b')} as sb from s a join s b on a.video_id = b.video_id and a.n < b.n),
q as (select *, o / (sa + sb - o) as iou, case when o / sa < 0.5 and o / sb >= 0.85 then 1 - o / sa * (o / sb) else 0 end as up, case when o / sa >= 0.85 and o / sb < 0.5 then 1 - o / sa * (o / sb) else 0 end as low from p),
k as (select s.video_id, s.id, s.n, coalesce((select max(iou) from q where q.video_id = s.video_id and j = s.n), 0) <= 0.7 as k0, conf > 0.5 as k1, coalesce((select max(up) from q where q.video_id = s.video_id and j = s.n), 0) <= 0.8 as k2,
  greatest(coalesce((select max(low) from q where q.video_id = s.video_id and i = s.n), 0), coalesce((select max(up) from q where q.video_id = s.video_id and j = s.n and i = s.n - 1), 0)) <= 0.8 as k3 from s),
f as (select *, bool_or(k1) over w as a1, bool_or(k2) over w as a2, bool_or(k3) over w as a3 from k window w as (partition by video_id))
select video_id, id from f where k0 and (k1 or (not a1 and n <= 3)) and (k2 or (not a2 and n <= 3)) and (k3 or (not a3 and n <= 3))""")
def geom_mask_nms(spark: SparkSession, d: str) -> DataFrame:
    """Here an order stands for an image."""
    return mask_nms(boxes(spark, d).withColumn("score", F.col("score") / 60000), score_threshold=0.5, image=("video_id",))


def masks_update(masks: DataFrame, **limits: float) -> DataFrame:
    """``(image, id)`` of the masks kept of ``(image, id, b, stability, predicted_iou)``: suppression by the product of the two."""
    return mask_nms(masks.withColumn("score", F.col("stability") * F.col("predicted_iou")), **limits)


FRAME_MASKS = """with fa as (select distinct video_id, fid, gt_bboxes from frame_annotations), el as (select video_id, fid, i - 1 as id, gt_bboxes[i] as b from (select *, generate_subscripts(gt_bboxes, 1) as i from fa)),
r as (select video_id, fid, id, b.x1 as x1, b.y1 as y1, b.x2 as x2, b.y2 as y2, (10 - id % 5) / 10 * ((b.x1 + b.y1) % 10) / 10 as score from el where b.x2 > b.x1 and b.y2 > b.y1)"""


@query(FRAME_MASKS + f""", s as (select *, row_number() over (partition by video_id, fid order by score desc, id) as n, score as conf from r),
p as (select a.video_id, a.fid, a.n as i, b.n as j, {_W} as o, {_A('a')} as sa, {_A('b')} as sb from s a join s b on a.video_id = b.video_id and a.fid = b.fid and a.n < b.n),
q as (select *, o / (sa + sb - o) as iou, case when o / sa < 0.5 and o / sb >= 0.85 then 1 - o / sa * (o / sb) else 0 end as up, case when o / sa >= 0.85 and o / sb < 0.5 then 1 - o / sa * (o / sb) else 0 end as low from p),
k as (select s.video_id, s.fid, s.id, s.n, coalesce((select max(iou) from q where q.video_id = s.video_id and q.fid = s.fid and j = s.n), 0) <= 0.7 as k0, conf > 0.1 as k1, coalesce((select max(up) from q where q.video_id = s.video_id and q.fid = s.fid and j = s.n), 0) <= 0.8 as k2,
  greatest(coalesce((select max(low) from q where q.video_id = s.video_id and q.fid = s.fid and i = s.n), 0), coalesce((select max(up) from q where q.video_id = s.video_id and q.fid = s.fid and j = s.n and i = s.n - 1), 0)) <= 0.8 as k3 from s),
f as (select *, bool_or(k1) over w as a1, bool_or(k2) over w as a2, bool_or(k3) over w as a3 from k window w as (partition by video_id, fid))
select video_id, fid, id from f where k0 and (k1 or (not a1 and n <= 3)) and (k2 or (not a2 and n <= 3)) and (k3 or (not a3 and n <= 3))""")
def mask_update_frames(spark: SparkSession, d: str) -> DataFrame:
    """Masks of each frame of each video that survive suppression within their frame."""
    f = table(spark, d, "frame_annotations").select("video_id", "fid", "gt_bboxes").distinct().select("video_id", "fid", F.posexplode("gt_bboxes").alias("id", "b")).where("b.x2 > b.x1 and b.y2 > b.y1")
    scored = f.withColumn("stability", (10 - F.col("id") % 5) / 10).withColumn("predicted_iou", ((F.col("b.x1") + F.col("b.y1")) % 10) / 10)
    return masks_update(scored)


@query("""select video_id, fid, i, x1, y1, x2, y2 from (select video_id, fid, generate_subscripts(gt_bboxes, 1) - 1 as i, unnest(gt_bboxes).x1 as x1, unnest(gt_bboxes).y1 as y1, unnest(gt_bboxes).x2 as x2, unnest(gt_bboxes).y2 as y2 from (select distinct video_id, fid, gt_bboxes from frame_annotations)) where x2 > x1 and y2 > y1""")
def filter_degenerate_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Annotated boxes with area, of each frame once; frames without such boxes drop out."""
    f = table(spark, d, "frame_annotations").select("video_id", "fid", "gt_bboxes").distinct()
    return f.select("video_id", "fid", F.posexplode("gt_bboxes").alias("i", "b")).where("b.x2 > b.x1 and b.y2 > b.y1").select("video_id", "fid", "i", "b.*")


# --- proofs -------------------------------------------------------------------------------------------------------


@query(facts("""select a.video_id, round(max(a.prob * b.prob), 6) as prob from u a join u b on a.video_id = b.video_id and a.fid < b.fid join mx on mx.video_id = a.video_id where a.predicate = 'click' and b.predicate = 'purchase' and b.fid < m group by 1"""))
def prob_best_proof(spark: SparkSession, d: str) -> DataFrame:
    """Best proof of click then purchase: per frame the best fact, then the best of all later frames by a suffix maximum."""
    u = U(spark, d)
    top = u.groupBy("video_id").agg(F.max("fid").alias("m"))
    f = u.join(top, "video_id").where("fid < m").groupBy("video_id", "fid").agg(F.max(F.when(F.col("predicate") == "click", F.col("prob"))).alias("a"), F.max(F.when(F.col("predicate") == "purchase", F.col("prob"))).alias("b"))
    later = F.max("b").over(Window.partitionBy("video_id").orderBy("fid").rowsBetween(1, Window.unboundedFollowing))
    return f.withColumn("p", F.col("a") * later).groupBy("video_id").agg(F.round(F.max("p"), 6).alias("prob")).where("prob is not null")


@query()
def prob_topk_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Probability of click then purchase from the three most likely proofs (``chronoscene.operators.proofs``)."""
    from chronoscene.operators.proofs import chain_proofs

    return chain_proofs(U(spark, d), "click", "purchase", 3).select("video_id", F.round("prob", 6).alias("prob"))


@query()
def track_iou(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of annotated boxes by overlap with the nearest known box (``chronoscene.operators.tracking``)."""
    from chronoscene.operators.tracking import track_boxes

    return track_boxes(table(spark, d, "frame_annotations").select("video_id", "fid", "gt_bboxes"))
