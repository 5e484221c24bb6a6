"""Queries of text and program normalization, keyword statistics, lookups and reports, with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronoscene.functions import text
from chronoscene.operators import graph, scoring
from chronoscene.plans.graph_queries import SIM, U, facts
from chronoscene.sources import adapters, readers
from chronoscene.storage import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- text ---------------------------------------------------------------------------------------------------------


@query(r"select doc_id, md5(replace(replace(replace(regexp_replace(text, '\([0-9a-zA-Z,\- ]+\)', '', 'g'), '  ', ' '), ' .', '.'), ' ,', ',')) as clean from documents where text is not null")
def text_clean_caption(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.md5(text.clean_caption(F.col("text"))).alias("clean"))


@query("select caption_id, trim(translate(caption, ',''_-', '    ')) as plain from caption_descriptions where caption is not null")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "caption_descriptions").where("caption is not null").select("caption_id", F.trim(text.normalize_text(F.col("caption"))).alias("plain"))


@query("select p_partkey, translate(p_name || '_' || p_type || '/' || p_brand, '_/', '  ') as label from part")
def text_clean_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.clean_label(F.concat("p_name", F.lit("_"), "p_type", F.lit("/"), "p_brand")).alias("label"))


@query("select caption_id, array_to_string(list_filter(string_split(translate(caption, '-,._''', '     '), ' '), lambda w: not regexp_matches(w, '^\\?.$') and not regexp_matches(w, '^[A-Z]$')), '_') as kw from caption_descriptions where caption is not null")
def text_keyword_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "caption_descriptions").where("caption is not null").select("caption_id", text.without_variables(F.col("caption")).alias("kw"))


RANGES = ["3-7", "5", "-4", "6-", "12-30"]
_RANGE_ROWS = ", ".join(f"({i}, '{r}')" for i, r in enumerate(RANGES))


@query(f"""with x(i, r) as (values {_RANGE_ROWS}) select n_nationkey, r, case when not contains(r, '-') then r::int when split_part(r, '-', 1) = '' then 0 else split_part(r, '-', 1)::int end as "start",
case when not contains(r, '-') then r::int + 1 when split_part(r, '-', 2) = '' then 10000 else split_part(r, '-', 2)::int end as "end" from nation join x on n_nationkey % 5 = i""")
def text_parse_time_range(spark: SparkSession, d: str) -> DataFrame:
    r = F.get(F.array(*map(F.lit, RANGES)), F.col("n_nationkey") % 5)
    return table(spark, d, "nation").select("n_nationkey", r.alias("r")).select("n_nationkey", "r", F.inline(F.array(text.time_range(F.col("r")))))


PERIODS = """with t as (select row_id, generate_subscripts(video_location_precise, 1) - 1 as pos, unnest(video_location_precise) as p from timestamp_descriptions), a as (select row_id, pos, string_split(translate(p, '[]'' ', ''), ',') as a from t),
f as (select row_id, pos, list_transform(a, lambda x: case when regexp_full_match(x, '\\d+') then x::double when regexp_full_match(x, '\\d+/0*[1-9]\\d*') then split_part(x, '/', 1)::int / split_part(x, '/', 2)::int end) as f from a),
v as (select row_id, pos, case when len(f) = 2 and f[1] is not null and f[2] is not null then f end as f from f)"""


@query(PERIODS + ", p as (select row_id, min(pos) as pos from v where f is not null group by 1) select t.row_id, round(f[1], 6) as \"start\", round((f[1] + f[2]) / 2, 6) as mid, round(f[2], 6) as \"end\" from timestamp_descriptions t left join p on p.row_id = t.row_id left join v on v.row_id = p.row_id and v.pos = p.pos")
def text_parse_period(spark: SparkSession, d: str) -> DataFrame:
    """The first readable period of every row, nulls where it has none."""
    t = table(spark, d, "timestamp_descriptions").select("row_id", "video_location_precise")
    values = F.filter(F.transform("video_location_precise", whole_period), lambda v: v.isNotNull())
    return t.select("row_id", F.get(values, F.lit(0)).alias("v")).select("row_id", *[F.round(f"v.{c}", 6).alias(c) for c in ("start", "mid", "end")])


@query(PERIODS + """ select row_id, pos::int as pos, round(f[1], 6) as "start", round((f[1] + f[2]) / 2, 6) as mid, round(f[2], 6) as "end" from v""")
def text_parse_periods(spark: SparkSession, d: str) -> DataFrame:
    """Every element of every row with its position from 0; nulls where it is null or no pair of fractions or whole numbers."""
    return parsed_periods(table(spark, d, "timestamp_descriptions"))


def whole_period(p: Column) -> Column:
    """The period of a text of two readable parts, else null."""
    v = text.period(p)
    return F.when((F.size(F.split(p, ",")) == 2) & v["mid"].isNotNull(), v)


def parsed_periods(rows: DataFrame) -> DataFrame:
    """``(row_id, pos, start, mid, end)`` of ``(row_id, video_location_precise)``."""
    t = rows.select("row_id", F.posexplode("video_location_precise").alias("pos", "p"))
    return t.select("row_id", "pos", whole_period(F.col("p")).alias("v")).select("row_id", "pos", *[F.round(f"v.{c}", 6).alias(c) for c in ("start", "mid", "end")])


@query("""with c as (select row_id, i, unnest(programmatic) as c from (select row_id, programmatic, 0 as i from timestamp_descriptions) where programmatic is not null), j as (select row_id, string_agg(c, ' and ' order by c) as p from c where c is not null group by 1),
l as (select row_id, list_filter(regexp_split_to_array(p, ' or | and |^or\\(|^and\\(|;'), lambda x: x <> '') as a from j),
w as (select row_id, a, len(a) > 1 and starts_with(a[1], '(') and ends_with(a[-1], ')') as w from l),
s as (select row_id, unnest(case when w then list_transform(a, lambda x, i: case when i = 1 then x[2:] when i = len(a) then x[:-2] else x end) else a end) as clause from w) select row_id, clause, count(*) as n from s group by 1, 2""")
def text_split_program(spark: SparkSession, d: str) -> DataFrame:
    """Clauses joined by ``and`` and split again, as programs that stick together are."""
    t = table(spark, d, "timestamp_descriptions").where("programmatic is not null")
    joined = t.select("row_id", F.array_join(F.array_sort(F.filter("programmatic", lambda c: c.isNotNull())), " and ").alias("p"))
    return joined.select("row_id", F.explode(text.split_logic(F.col("p"))).alias("clause")).groupBy("row_id", "clause").agg(F.count("*").alias("n"))


@query("""with j as (select row_id, array_to_string(list_filter(programmatic, lambda c: c is not null), ',') as p from timestamp_descriptions where programmatic is not null),
s as (select row_id, string_split(p, '),') as a from j where p <> '') select row_id, i, case when i < len(a) then a[i] || ')' else a[i] end as clause from (select row_id, a, generate_subscripts(a, 1) as i from s)""")
def text_split_commas(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "timestamp_descriptions").where("programmatic is not null")
    j = t.select("row_id", F.array_join("programmatic", ",").alias("p")).where("p <> ''")
    return j.select("row_id", F.posexplode(text.split_commas(F.col("p"))).alias("i", "clause")).select("row_id", (F.col("i") + 1).alias("i"), "clause")


@query("select n_regionkey, lower(string_agg(n_name, '. ' order by n_name)) || '.' as prompt from nation group by 1")
def text_class_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(text.class_prompt(F.array_sort(F.collect_list("n_name"))).alias("prompt"))


@query("select video_id, 'masks/' || video_id || '/' || case when n_frames <= 10000 then lpad((n_frames - 1)::varchar, 4, '0') else (n_frames - 1)::varchar end || '.png' as path from videos where n_frames >= 1")
def text_frame_path(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos").where("n_frames >= 1")
    return v.select("video_id", text.frame_path(F.concat(F.lit("masks/"), "video_id"), F.col("n_frames") - 1).alias("path"))


@query("select video_id, case when fps > 0 then n_frames / fps else 0 end::double as seconds, duration_s * fps as last_frame from videos")
def video_duration(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos")
    return v.select("video_id", F.when(F.col("fps") > 0, F.col("n_frames") / F.col("fps")).otherwise(0.0).alias("seconds"), (F.col("duration_s") * F.col("fps")).alias("last_frame"))


@query("select video_id, n as segment, s as \"start\", least(s + 10, duration_s) as \"end\" from (select video_id, duration_s, unnest(range(0, duration_s, 10)) as s, unnest(range(0, (duration_s + 9) // 10)) as n from videos where duration_s > 0)")
def video_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of ten seconds, the last one as long as is left."""
    v = table(spark, d, "videos").where("duration_s > 0").select("video_id", "duration_s", F.posexplode(F.sequence(F.lit(0), F.col("duration_s") - 1, F.lit(10))).alias("segment", "start"))
    return v.select("video_id", "segment", "start", F.least(F.col("start") + 10, F.col("duration_s")).alias("end"))


# --- keywords -----------------------------------------------------------------------------------------------------

KW = "kw as (select spec_id, unnest(unary_kws) as k from batched_gpt_specs), cl as (select spec_id, translate(k, '-,._', '    ') as k from kw where k is not null and not starts_with(k, '''') and len(string_split(translate(k, '-,._', '    '), ' ')) < 4), df as (select k, count(*) as n from cl where k not in ('unknown', 'none') and not list_has_any(string_split(k, ' '), ['todo', 'still']) group by 1 having count(*) > 2)"


def _frequency(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "batched_gpt_specs").select(F.explode(text.kept_keywords(F.coalesce("unary_kws", F.array().cast("array<string>")))).alias("k"))
    s = s.where(text.kept_by_stop_words(F.col("k"), ["todo", "still"], ["unknown", "none"]))
    return s.groupBy("k").agg(F.count("*").alias("n")).where("n > 2")


@query(f"with {KW} select k, n from df")
def kw_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _frequency(spark, d)


@query(f"with {KW} select k, n from (select *, row_number() over (order by n desc, k desc) as r from df) where r > 5")
def kw_drop_top_n(spark: SparkSession, d: str) -> DataFrame:
    """All but the five most frequent; these five are a top-k report, found without sorting the rest."""
    f = _frequency(spark, d)
    top = f.orderBy(F.desc("n"), F.desc("k")).limit(5)
    return f.join(top.select("k"), "k", "left_anti")


@query(SIM + ", q as (select mean.keyword, m, i from mean), c as (select a.keyword as x, b.keyword as y, sum(a.m * b.m) as s from q a join q b using (i) where a.keyword <> b.keyword group by 1, 2), z as (select x, y, s / (p.n * r.n) as sim from c join n2 p on p.keyword = x join n2 r on r.keyword = y) select x as keyword, round(max(sim), 6) as most_alike from z group by 1 having max(sim) <= 0.3")
def kw_negative_by_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Labels without another one above the similarity threshold; the list is compared with itself, not with the corpus."""
    m = scoring.label_means(table(spark, d, "embeddings").select("label", "embedding"))
    a, b = m.toDF("keyword", "f"), m.toDF("other", "g")
    z = a.join(b, F.col("keyword") != F.col("other")).withColumn("sim", scoring.cosine(F.col("f"), F.col("g")))
    return z.groupBy("keyword").agg(F.max("sim").alias("s")).where("s <= 0.3").select("keyword", F.round("s", 6).alias("most_alike"))


@query("select spec_id, list_sort(list_distinct(list_filter(unary_kws, lambda x: x is not null and not coalesce(list_contains(binary_kws, x), false)))) as only_unary from batched_gpt_specs where unary_kws is not null")
def kw_set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of the first list that the second lacks, each once; null elements are left out, a null second list is empty."""
    s = table(spark, d, "batched_gpt_specs").where("unary_kws is not null")
    return s.select("spec_id", F.array_sort(F.array_except(F.array_compact("unary_kws"), F.coalesce("binary_kws", F.array().cast("array<string>")))).alias("only_unary"))


@query("select spec_id, list_sort(list_distinct(list_filter(list_concat(coalesce(unary_kws, []::varchar[]), coalesce(consts, []::varchar[])), lambda x: x is not null))) as kws from batched_gpt_specs")
def kw_keyword_union(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("unary_kws", none), F.coalesce("consts", none))
    return table(spark, d, "batched_gpt_specs").select("spec_id", F.array_sort(F.filter(both, lambda x: x.isNotNull())).alias("kws"))


@query("select spec_id, case when len(coalesce(unary_kws, [])) > 0 then unary_kws else ['$$$'] end as kws from batched_gpt_specs")
def kw_filled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "batched_gpt_specs").select("spec_id", text.filled_keywords(F.col("unary_kws")).alias("kws"))


@query()
def kw_sample_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Up to five keywords of the vocabulary per spec that the spec doesn't hold, in a seeded order."""
    words = table(spark, d, "vocabulary").where("kind = 'unary' and term is not null").select("term").distinct()
    s = table(spark, d, "batched_gpt_specs").select("spec_id", F.coalesce("unary_kws", F.array().cast("array<string>")).alias("own"))
    return graph.sampled_others(s, "spec_id", "own", words, "term", 5, 7).withColumnRenamed("others", "negatives")


@query("""with w as (select distinct term from vocabulary where kind = 'unary' and term is not null), n as (select spec_id, (select count(*) from w where not coalesce(list_contains(s.unary_kws, term), false)) as free from batched_gpt_specs s)
select spec_id, least(free, 5)::int as n, least(free, 5)::int as different, true as foreign_words from n""")
def kw_negatives_sound(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of sampled negatives: five, or as many as there are, all different, none of the spec's own."""
    own = table(spark, d, "batched_gpt_specs").select("spec_id", F.coalesce("unary_kws", F.array().cast("array<string>")).alias("own"))
    n = kw_sample_negatives(spark, d).join(own, "spec_id")
    return n.select("spec_id", F.size("negatives").alias("n"), F.size(F.array_distinct("negatives")).alias("different"), (~F.coalesce(F.arrays_overlap("negatives", "own"), F.lit(False))).alias("foreign_words"))


@query("select count(*) as n, count(*) as partners, 0::bigint as itself from batched_gpt_specs where (select count(*) from batched_gpt_specs) > 1")
def kw_negative_spec_sound(spark: SparkSession, d: str) -> DataFrame:
    """Every spec has a partner, every spec is one, none is its own."""
    s = kw_negative_spec(spark, d)
    return s.agg(F.count("*").alias("n"), F.count_distinct("negative_id").alias("partners"), F.count_if(F.col("spec_id") == F.col("negative_id")).alias("itself"))


@query()
def kw_negative_spec(spark: SparkSession, d: str) -> DataFrame:
    """A random other spec per spec: the next one in seeded order, the first for the last; ranks come from a range sort."""
    from chronoscene.operators.rangescan import prefix_sum

    s = table(spark, d, "batched_gpt_specs").select("spec_id", F.xxhash64(F.lit(11), "spec_id").alias("h"), F.lit("").alias("all"), F.lit(1).alias("one"))
    r = prefix_sum(s, "all", ["h", "spec_id"], "one", "_b", "rank").select("spec_id", "rank")
    n = r.agg((F.max("rank") + 1).alias("n"))
    shifted = r.crossJoin(F.broadcast(n)).select(F.col("spec_id").alias("negative_id"), F.pmod(F.col("rank") - 1, "n").alias("rank"))
    return r.join(shifted, "rank").where("spec_id <> negative_id").select("spec_id", "negative_id")


# --- JSON, programs, lookups, reports -----------------------------------------------------------------------------


@query("select event_id, regexp_extract(props, '[0-9]+')::int as k, ts::date as day from events")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_date("ts").alias("day"))


@query("select line_id, list_sort(list_distinct(list_transform(json_keys(record), lambda k: lower(replace(replace(k, ' ', '_'), '-', '_'))))) as keys from caption_exports where json_valid(record)")
def json_key_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "caption_exports").select("line_id", F.from_json("record", "map<string,string>", {"mode": "PERMISSIVE"}).alias("m"), F.json_object_keys("record").alias("keys"), F.try_parse_json("record").alias("v"))
    return t.where("v is not null").select("line_id", F.array_sort(F.array_distinct(F.transform("keys", lambda k: F.lower(F.translate(k, " -", "__"))))).alias("keys"))


@query()
def program_compile(spark: SparkSession, d: str) -> DataFrame:
    from chronoscene.plans.program import compiled_programs

    return compiled_programs(table(spark, d, "timestamp_descriptions"), "row_id", "programmatic")


@query()
def program_windows(spark: SparkSession, d: str) -> DataFrame:
    from chronoscene.plans.program import windowed_programs

    return windowed_programs(table(spark, d, "timestamp_descriptions").select("video_id", "event_id", "programmatic"))


@query("select c_custkey, coalesce(case when s_name like '%1' then s_name end, case when n_name like 'N%' or length(n_name) > 6 then n_name end, c_mktsegment) as name from customer left join supplier on s_suppkey = c_custkey left join nation on n_nationkey = c_nationkey")
def lookup_coalesce_chain(spark: SparkSession, d: str) -> DataFrame:
    """First of three lookups that has the key."""
    c, s, n = (table(spark, d, t) for t in ("customer", "supplier", "nation"))
    s = s.where("s_name like '%1'").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    n = n.where("n_name like 'N%' or length(n_name) > 6").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return c.join(s, "c_custkey", "left").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce("s_name", "n_name", "c_mktsegment").alias("name"))


@query("select reason, count(*) as n from (select case when v.video_id is null then 'no video' when caption is null then 'no caption' when sequential_descriptions is null then 'no answer' when v.data_source is null then 'no source' else 'kept' end as reason from caption_descriptions c left join videos v on v.video_id = c.video_id) group by 1")
def missing_reason_count(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos").select("video_id", F.lit(True).alias("known"), F.col("data_source").alias("src"))
    c = table(spark, d, "caption_descriptions").select("video_id", "caption", "sequential_descriptions").join(v, "video_id", "left")
    reason = (
        F.when(F.col("known").isNull(), "no video").when(F.col("caption").isNull(), "no caption").when(F.col("sequential_descriptions").isNull(), "no answer")
        .when(F.col("src").isNull(), "no source").otherwise("kept")
    )
    return c.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("select video_id, caption_id, prog from (select c.video_id, c.caption_id, s.prog, row_number() over (partition by c.caption_id order by s.compiled_at desc, s.spec_id desc) as n from caption_descriptions c join batched_gpt_specs s on s.video_id = c.video_id where s.compiled_at is not null) where n = 1")
def join_caption_spec(spark: SparkSession, d: str) -> DataFrame:
    """Captions with the spec compiled last for the same video; the specs are reduced to one per video before the join."""
    s = table(spark, d, "batched_gpt_specs").where("video_id is not null and compiled_at is not null")
    last = s.groupBy("video_id").agg(F.max(F.struct("compiled_at", "spec_id", "prog")).alias("s"))
    return table(spark, d, "caption_descriptions").select("video_id", "caption_id").join(last, "video_id").select("video_id", "caption_id", "s.prog")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def skip_done_anti(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity >= 49)")
def sample_semi(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(wanted, "o_orderkey", "left_semi")


@query(facts("select video_id, 'rel sg_unary_atom = {' || string_agg(printf('%.6f', prob) || '::(\"' || predicate || '\",' || fid || ',' || oid || ')', ', ' order by predicate, fid, oid) || '}' as line from u group by 1"))
def datalog_fact_text(spark: SparkSession, d: str) -> DataFrame:
    return readers.datalog_facts(U(spark, d), "video_id", "sg_unary_atom", ["predicate", "fid", "oid"], "prob")


@query(facts("select video_id, predicate, list_sort(list(distinct oid)) as oids from u group by 1, 2"))
def group_object_lists(spark: SparkSession, d: str) -> DataFrame:
    return U(spark, d).groupBy("video_id", "predicate").agg(F.array_sort(F.collect_set("oid")).alias("oids"))


@query(facts("select coalesce(x.video_id, y.video_id) as video_id, coalesce(x.oid, y.oid) as oid, coalesce(y.p, x.p) as prob from (select video_id, oid, max(prob) as p from u where predicate = 'view' group by 1, 2) x full join (select video_id, oid, max(prob) as p from u where predicate = 'click' group by 1, 2) y on x.video_id = y.video_id and x.oid = y.oid"))
def merge_right_wins(spark: SparkSession, d: str) -> DataFrame:
    """Outer merge of two keyed tables in which the right value wins."""
    side = lambda p, c: U(spark, d).where(F.col("predicate") == p).groupBy("video_id", "oid").agg(F.max("prob").alias(c))
    return side("view", "l").join(side("click", "r"), ["video_id", "oid"], "full").select("video_id", "oid", F.coalesce("r", "l").alias("prob"))


@query(facts("select video_id, n, count(*) as combinations from (select video_id, count(distinct oid) as n from obj group by 1), range(0, 3) a(i), range(0, 2) b(j) group by 1, 2"))
def parameter_grid(spark: SparkSession, d: str) -> DataFrame:
    """Objects per video under each of 3 x 2 parameter settings, from nested arrays instead of a cross join."""
    o = adapters.objects(U(spark, d)).groupBy("video_id").agg(F.count("*").alias("n"))
    grid = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(1)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    return o.withColumn("g", F.explode(grid)).groupBy("video_id", "n").agg(F.count("*").alias("combinations"))


@query(facts(", k as (select video_id, oid, row_number() over (partition by video_id order by oid) - 1 as i from obj) select a.video_id, a.oid as first, b.oid as second from k a join k b on a.video_id = b.video_id and a.i < b.i"))
def ordered_combinations(spark: SparkSession, d: str) -> DataFrame:
    o = U(spark, d).groupBy("video_id").agg(F.array_sort(F.collect_set("oid")).alias("o"))
    pairs = F.flatten(F.transform("o", lambda x, i: F.transform(F.slice(F.col("o"), i + 2, F.size("o")), lambda y: F.struct(x.alias("first"), y.alias("second")))))
    return o.select("video_id", F.inline(pairs))


@query(facts("select predicate, fid, oid, video_id from (select *, row_number() over (partition by predicate order by prob desc, video_id, fid, oid) as n from u) where n <= 5"))
def top_facts_per_predicate(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("prob"), F.asc("video_id"), F.asc("fid"), F.asc("oid")]
    return graph.top_per(U(spark, d), ["predicate"], order, 5).select("predicate", "fid", "oid", "video_id")
