"""Queries of data-set preparation: filters, keyed and fuzzy joins, merges of collections, masks, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoscene.functions import geometry as geo, text
from chronoscene.operators import dataset, metrics, scoring
from chronoscene.plans.graph_queries import _A, _W, BOXES, SIM, U, boxes, facts
from chronoscene.storage import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ELEMENTS = """with fa as (select distinct video_id, fid, gt_labels, gt_instance_ids, gt_bboxes from frame_annotations),
el as (select video_id, fid, i - 1 as pos, gt_labels[i] as label, gt_instance_ids[i] as oid, gt_bboxes[i] as b from (select *, generate_subscripts(gt_bboxes, 1) as i from fa))"""


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return dataset.elements(table(spark, d, "frame_annotations"))


# --- filters ------------------------------------------------------------------------------------------------------


@query("select video_id, row_id from timestamp_descriptions where video_id in (select video_id from (select video_id, arg_min(coalesce(duration = 'short', false), row_id) as keep from timestamp_descriptions group by 1) where keep)")
def filter_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the videos whose first row belongs to the phase."""
    t = table(spark, d, "timestamp_descriptions").select("video_id", "row_id", "duration")
    return dataset.split_filter(t, "video_id", ["row_id"], F.col("duration") == "short").select("video_id", "row_id")


@query(ELEMENTS + " select video_id, fid, pos from el join videos using (video_id) where b.x2 > 0 and b.y2 > 0 and b.x1 < width and b.y1 < height")
def filter_visible(spark: SparkSession, d: str) -> DataFrame:
    """Elements whose box shows in the frame; where the frame's size is unknown none is known to."""
    v = table(spark, d, "videos").select("video_id", "width", "height")
    return _elements(spark, d).join(v, "video_id").where(geo.inside(F.col("b"), F.col("width"), F.col("height"))).select("video_id", "fid", "pos")


PEOPLE = ["toddler", "drummer", "policeman", "scarecrow"]
_PEOPLE = ", ".join(f"'{p}'" for p in PEOPLE)


@query(ELEMENTS + f", m as (select *, coalesce(not (b.x2 > b.x1 and b.y2 > b.y1), true) as bad, coalesce(label in ({_PEOPLE}), false) as person from el), w as (select *, bool_or(bad and person) over (partition by video_id, fid) as fatal from m) select video_id, fid, pos from w where not bad and not fatal")
def filter_person_boxes(spark: SparkSession, d: str) -> DataFrame:
    """A person's box without area drops its whole frame, an object's only itself."""
    b = F.col("b")
    broken = ~((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
    return dataset.whole_frames(_elements(spark, d), broken, F.col("label").isin(*PEOPLE)).select("video_id", "fid", "pos")


@query(ELEMENTS + " select video_id, fid, pos from el join videos using (video_id) where (b.x2 - b.x1)::bigint * (b.y2 - b.y1) * 1000 >= width::bigint * height")
def filter_min_area(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of at least a thousandth of the frame."""
    v = table(spark, d, "videos").select("video_id", "width", "height")
    b = F.col("b")
    area = (b["x2"] - b["x1"]).cast("long") * (b["y2"] - b["y1"])
    return _elements(spark, d).join(v, "video_id").where(area * 1000 >= F.col("width").cast("long") * F.col("height")).select("video_id", "fid", "pos")


@query(ELEMENTS + ", m as (select video_id, fid, pos, b from el where b.x2 > b.x1 and b.y2 > b.y1) select video_id, fid, list(b.x1 order by pos) as x1, list(b.y2 - 1 order by pos) as y2 from m group by 1, 2")
def filter_empty_masks(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the masks of a frame in their order; masks without pixels are left out, frames without others too."""
    return dataset.mask_boxes(table(spark, d, "frame_annotations"))


@query(ELEMENTS + " select distinct video_id, fid from el where b is not null and video_id in (select video_id from videos where fps > 0 and n_frames > 0)")
def filter_valid(spark: SparkSession, d: str) -> DataFrame:
    """Frames with a box, of videos that can be read."""
    v = table(spark, d, "videos").where("fps > 0 and n_frames > 0").select("video_id")
    return _elements(spark, d).where("b is not null").select("video_id", "fid").distinct().join(v, "video_id", "left_semi")


CORRUPTED = ["-01", "_05", "ab"]


@query("select video_id from videos where " + " and ".join(f"not contains(video_id, '{c}')" for c in CORRUPTED))
def filter_corrupted(spark: SparkSession, d: str) -> DataFrame:
    return dataset.without_substrings(table(spark, d, "videos").select("video_id"), "video_id", CORRUPTED)


@query("select distinct video_id, fid from frame_annotations where gt_instance_ids[1] % 2 = 0")
def filter_keyframes(spark: SparkSession, d: str) -> DataFrame:
    """Frames whose first element is no generated one (here: has an even id)."""
    f = table(spark, d, "frame_annotations").select("video_id", "fid", F.get("gt_instance_ids", F.lit(0)).alias("first"))
    return f.where("first % 2 = 0").select("video_id", "fid").distinct()


@query("select caption_id from caption_descriptions where length(caption) = strlen(caption) or (lang = 'en' and length(caption) >= 0.8 * strlen(caption))")
def filter_english(spark: SparkSession, d: str) -> DataFrame:
    """Captions in plain letters, and those said to be English with at most a fifth of other bytes."""
    c = table(spark, d, "caption_descriptions").where("caption is not null")
    return c.where(text.is_ascii(F.col("caption")) | F.coalesce((F.col("lang") == "en") & (F.length("caption") >= 0.8 * F.octet_length("caption")), F.lit(False))).select("caption_id")


@query("select video_id, list(t order by t) as times from (select distinct video_id, coalesce(event_id, -1) as t from timestamp_descriptions) where t <> -1 group by 1")
def filter_valid_times(spark: SparkSession, d: str) -> DataFrame:
    """Times of a video in order without the -1 that stands for none."""
    t = table(spark, d, "timestamp_descriptions").select("video_id", F.coalesce("event_id", F.lit(-1)).alias("t")).where("t <> -1")
    return t.groupBy("video_id").agg(F.array_sort(F.collect_set("t")).alias("times"))


@query("select vec_id, list_max(embedding)::double as best from embeddings where list_max(embedding) > 0.3")
def filter_detections(spark: SparkSession, d: str) -> DataFrame:
    """Detections whose highest logit exceeds the threshold."""
    e = table(spark, d, "embeddings").select("vec_id", F.array_max("embedding").cast("double").alias("best"))
    return e.where("best > cast(0.3 as float)")


@query("with r as (select video_id, row_number() over (order by video_id) - 1 as r, count(*) over () as n from videos), x as (select video_id, r from r union all select video_id, n + r from r where r < (4 - n % 4) % 4) select video_id, (r % 4)::int as shard from x")
def frame_shards(spark: SparkSession, d: str) -> DataFrame:
    """Videos dealt to four workers of equal load."""
    return dataset.sharded(table(spark, d, "videos").select("video_id"), "video_id", 4)


# --- joins --------------------------------------------------------------------------------------------------------

CLEAN = r"trim(replace(replace(replace(regexp_replace(caption, '\([0-9a-zA-Z,\- ]+\)', '', 'g'), '  ', ' '), ' .', '.'), ' ,', ','))"


@query(f"with c as (select caption_id, {CLEAN} as k from caption_descriptions where caption is not null), s as (select k, min(caption_id) as cached from c group by 1) select caption_id, cached from c join s using (k)")
def join_clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Captions with the first caption whose cleaned text is the same, as a cache of answers by text."""
    c = table(spark, d, "caption_descriptions").where("caption is not null").select("caption_id", text.clean_caption(F.col("caption"), trim=True).alias("k"))
    return c.join(c.groupBy("k").agg(F.min("caption_id").alias("cached")), "k").select("caption_id", "cached")


COLOURS = ["blanket", "bicycle", "basket", "ladder", "lantern", "mirror", "tripod"]
_COLOURS = ", ".join(f"({i}, '{c}')" for i, c in enumerate(COLOURS))


@query(f"with c(i, c) as (values {_COLOURS}), v as (select distinct unnest(consts) as value from batched_gpt_specs) select value, arg_min(c, levenshtein(p, c) * 100 + i) as nearest, min(levenshtein(p, c))::int as edits from (select value, regexp_replace(value, '[^\\x00-\\x7F]', '?', 'g') as p from v where value is not null), c group by 1")
def join_nearest_text(spark: SparkSession, d: str) -> DataFrame:
    """Each keyword with the nearest entry of a given list."""
    v = table(spark, d, "batched_gpt_specs").select(F.explode("consts").alias("value"))
    return dataset.nearest_text(v, "value", COLOURS)


@query()
def join_best_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The same by the share of matching blocks."""
    v = table(spark, d, "batched_gpt_specs").select(F.explode("consts").alias("value")).where("value is not null").distinct()
    return v.select("value", F.get(F.array(*map(F.lit, COLOURS)), dataset.best_by_ratio(F.col("value"), COLOURS)).alias("nearest"))


@query("with c as (select spec_id, generate_subscripts(consts, 1) as i, unnest(consts) as c from batched_gpt_specs), a as (select spec_id, a, max(i) as i from (select spec_id, i, unnest([c, lower(c), upper(c)]) as a from c where c is not null) group by 1, 2) select spec_id, term_id, (-i)::int as const_id from a join vocabulary on a = term where kind = 'entity'")
def join_const_ids(spark: SparkSession, d: str) -> DataFrame:
    """Categories with the number of the constant they name, as written or in lower or upper case; of equal constants the last."""
    c = table(spark, d, "batched_gpt_specs").select("spec_id", F.posexplode("consts").alias("i", "c")).where("c is not null")
    a = c.select("spec_id", "i", F.explode(F.array("c", F.lower("c"), F.upper("c"))).alias("term")).groupBy("spec_id", "term").agg(F.max("i").alias("i"))
    names = table(spark, d, "vocabulary").where("kind = 'entity'").select("term", "term_id")
    return a.join(names, "term").select("spec_id", "term_id", (-1 - F.col("i")).alias("const_id"))


@query("with n as (select c.video_id, unnest(consts) as noun from caption_descriptions c join batched_gpt_specs s on c.caption_id = s.spec_id) select video_id, list(distinct noun order by noun) as nouns from n where noun is not null group by 1")
def join_question_nouns(spark: SparkSession, d: str) -> DataFrame:
    """Nouns of a video by the key that its questions share with the noun lists."""
    n = table(spark, d, "batched_gpt_specs").select(F.col("spec_id").alias("caption_id"), F.explode("consts").alias("noun")).where("noun is not null")
    return table(spark, d, "caption_descriptions").select("caption_id", "video_id").join(n, "caption_id").groupBy("video_id").agg(F.array_sort(F.collect_set("noun")).alias("nouns"))


@query("""with l as (select file_id, line_no, min(record) as r from caption_exports where file_id is not null and line_no is not null and json_valid(record) and json_type(record) = 'OBJECT' group by 1, 2), p as (select a.file_id, a.line_no, a.r as a, b.r as b from l a join l b on a.file_id = b.file_id and b.line_no = a.line_no + 1)
select file_id, line_no, list_sort(list_distinct(list_concat(json_keys(a), json_keys(b)))) as keys, case when list_contains(json_keys(b), 'video_id') then b ->> '$.video_id' else a ->> '$.video_id' end as video_id from p""")
def json_deep_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each record of a file merged with the next one, which wins."""
    x = table(spark, d, "caption_exports").where("file_id is not null and line_no is not null").where(F.schema_of_variant(F.try_parse_json("record")).startswith("OBJECT"))
    lines = x.groupBy("file_id", "line_no").agg(F.min("record").alias("a"))
    after = lines.select("file_id", (F.col("line_no") - 1).alias("line_no"), F.col("a").alias("b"))
    m = lines.join(after, ["file_id", "line_no"]).select("file_id", "line_no", dataset.merged_json(F.col("a"), F.col("b")).alias("m"))
    return m.select("file_id", "line_no", F.array_sort(F.json_object_keys("m")).alias("keys"), F.get_json_object("m", "$.video_id").alias("video_id"))


@query("select line_id, list_sort(list_distinct(list_transform(json_keys(record), lambda k: case k when 'video location' then 'video_location' when 'videoLocation' then 'video_location' when 'clip' then 'video_id' else k end))) as keys from caption_exports where json_valid(record) and json_type(record) = 'OBJECT'")
def json_rename_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys renamed by a lookup at every level."""
    x = table(spark, d, "caption_exports").where(F.schema_of_variant(F.try_parse_json("record")).startswith("OBJECT"))
    renamed = dataset.renamed_keys(F.col("record"), {"video location": "video_location", "videoLocation": "video_location", "clip": "video_id"})
    return x.select("line_id", F.array_sort(F.array_distinct(F.json_object_keys(renamed))).alias("keys"))


@query("with f as (select distinct video_id, fid from frame_annotations where video_id is not null), t as (select distinct video_id, event_id, event_id * 7 - 9 as s from timestamp_descriptions where event_id is not null) select f.video_id, f.fid, event_id from f join t on f.video_id = t.video_id and fid >= s and fid < s + 20")
def join_frames_in_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Frames in the intervals of the events of their video."""
    f = table(spark, d, "frame_annotations").select("video_id", "fid").distinct()
    t = table(spark, d, "timestamp_descriptions").where("event_id is not null").select("video_id", "event_id").distinct()
    t = t.withColumn("s", F.col("event_id") * 7 - 9).withColumn("e", F.col("s") + 20)
    return dataset.points_in_intervals(f, t, "video_id", "fid", "s", "e", 64).select("video_id", "fid", "event_id")


@query("with p as (select spec_id, lower(u.predicate) as p, u.args as a from (select spec_id, unnest(tuples) as u from batched_gpt_specs) where len(u.args) = 2), g as (select spec_id, lower(u.predicate) as p from (select spec_id, unnest(binary_predicates) as u from batched_gpt_specs)) select spec_id, p as predicate, bool_or(exists (select 1 from g where g.spec_id = p.spec_id and g.p = p.p)) as found from p where p is not null group by 1, 2")
def metric_relation_match(spark: SparkSession, d: str) -> DataFrame:
    """Predicted relations that the true ones hold, whatever their case."""
    s = table(spark, d, "batched_gpt_specs")
    p = s.select("spec_id", F.explode("tuples").alias("u")).where("size(u.args) = 2").select("spec_id", F.lower("u.predicate").alias("predicate")).where("predicate is not null").distinct()
    g = s.select("spec_id", F.explode("binary_predicates").alias("u")).select("spec_id", F.lower("u.predicate").alias("predicate"), F.lit(True).alias("found")).distinct()
    return p.join(g, ["spec_id", "predicate"], "left").select("spec_id", "predicate", F.coalesce("found", F.lit(False)).alias("found"))


# --- collections --------------------------------------------------------------------------------------------------


@query(ELEMENTS + " select distinct video_id, oid, label from el where oid is not null and label is not null")
def truth_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d).where("oid is not null and label is not null").select("video_id", "oid", "label").distinct()


@query("select video_id, md5(string_agg(s, '|' order by caption_id, i)) as joined, count(*) as n from (select video_id, caption_id, generate_subscripts(sequential_descriptions, 1) as i, unnest(sequential_descriptions) as s from caption_descriptions) where s is not null group by 1")
def list_concatenation(spark: SparkSession, d: str) -> DataFrame:
    """Lists of a key one after the other."""
    c = table(spark, d, "caption_descriptions").select("video_id", "caption_id", F.posexplode("sequential_descriptions").alias("i", "s")).where("s is not null")
    s = F.transform(F.array_sort(F.collect_list(F.struct("caption_id", "i", "s"))), lambda x: x["s"])
    return c.groupBy("video_id").agg(F.md5(F.array_join(s, "|")).alias("joined"), F.count("*").alias("n"))


@query(ELEMENTS + ", c as (select video_id, oid, label, count(*) as n, min(fid * 100000 + pos) as f from el where oid is not null and label is not null group by 1, 2, 3) select video_id, oid, label, n from (select *, row_number() over (partition by video_id, oid order by n desc, f) as k from c) where k = 1")
def majority_label(spark: SparkSession, d: str) -> DataFrame:
    """The label most often given to an object, of equals the first seen."""
    return dataset.mode(_elements(spark, d).where("oid is not null"), ["video_id", "oid"], "label", ["fid", "pos"])


@query("with c as (select video_id, fid, max(coalesce(len(gt_bboxes), 0)) as n, bool_or(coalesce(annotator = 'manual', false)) as m from frame_annotations group by 1, 2) select video_id, fid, n from (select *, row_number() over (partition by video_id order by m desc, n desc, fid) as k from c) where k = 1")
def densest_annotated_frame(spark: SparkSession, d: str) -> DataFrame:
    """The frame with the most boxes, annotated by hand if there is such a frame; of equals the first."""
    f = table(spark, d, "frame_annotations").select("video_id", "fid", "gt_bboxes", "annotator")
    c = f.groupBy("video_id", "fid").agg(F.max(F.coalesce(F.array_size("gt_bboxes"), F.lit(0))).alias("n"), F.bool_or(F.coalesce(F.col("annotator") == "manual", F.lit(False))).alias("m"))
    best = F.min(F.struct((~F.col("m")).alias("m"), (-F.col("n")).alias("n"), "fid"))
    return c.groupBy("video_id").agg(best.alias("b")).select("video_id", "b.fid", (-F.col("b.n")).cast("long").alias("n"))


@query("select feed_id, file_name from (select feed_id, file_name, row_number() over (partition by feed_id order by regexp_extract(file_name, '(\\d+)\\D*$', 1)::bigint desc, file_name desc) as k from (select distinct feed_id, file_name from caption_exports where regexp_matches(file_name, '\\d'))) where k = 1")
def latest_file(spark: SparkSession, d: str) -> DataFrame:
    """The file with the highest number in its name, as for saved models."""
    f = table(spark, d, "caption_exports").where(F.col("file_name").rlike(r"\d")).select("feed_id", "file_name", F.regexp_extract("file_name", r"(\d+)\D*$", 1).cast("long").alias("n"))
    return f.groupBy("feed_id").agg(F.max_by("file_name", F.struct("n", "file_name")).alias("file_name"))


@query("select spec_id, list_filter(unary_kws, lambda x: not coalesce(list_contains(binary_kws, x), false)) as kept from batched_gpt_specs where unary_kws is not null")
def kw_ordered_difference(spark: SparkSession, d: str) -> DataFrame:
    """Keywords that the second list lacks, in their order and as often as they occur; nulls stay."""
    s = table(spark, d, "batched_gpt_specs").where("unary_kws is not null")
    return s.select("spec_id", F.filter("unary_kws", lambda x: ~F.coalesce(F.array_contains("binary_kws", x), F.lit(False))).alias("kept"))


@query("with a as (select video_id, list(caption_id order by caption_id) as captions from caption_descriptions where video_id is not null group by 1), b as (select video_id, list(spec_id order by spec_id) as specs from batched_gpt_specs where video_id is not null group by 1) select coalesce(a.video_id, b.video_id) as video_id, coalesce(captions, []) as captions, coalesce(specs, []) as specs from a full join b on a.video_id = b.video_id")
def key_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Captions and specs of each video; a missing list is empty."""
    lists = lambda t, c, n: table(spark, d, t).where("video_id is not null").groupBy("video_id").agg(F.array_sort(F.collect_list(c)).alias(n))
    return dataset.aligned_keys(lists("caption_descriptions", "caption_id", "captions"), lists("batched_gpt_specs", "spec_id", "specs"), "video_id")


VARS = "with e as (select video_id, spec_id, unnest(map_keys(var_map)) as k, unnest(map_values(var_map)) as v from batched_gpt_specs where video_id is not null)"


@query(VARS + " select video_id, k, v from (select *, row_number() over (partition by video_id, k order by spec_id desc) as n from e) where n = 1")
def map_merge(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "batched_gpt_specs").where("video_id is not null").select("video_id", "spec_id", "var_map")
    return dataset.merged_maps(s, "video_id", "var_map", ["spec_id"])


@query(VARS + " select video_id, k, row_number() over (partition by video_id, k order by spec_id) - 1 as place, v from e")
def list_map_append(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "batched_gpt_specs").where("video_id is not null").select("video_id", "spec_id", "var_map")
    return dataset.appended_lists(s, "video_id", "var_map", ["spec_id"])


@query("select spec_id, pos, case u.predicate when 'holding' then 'hold' when 'A' then '?a' when 'B' then '?b' else u.predicate end as predicate, list_transform(u.args, lambda a: case a when 'A' then '?a' when 'B' then '?b' when 'holding' then 'hold' else a end) as args from (select spec_id, generate_subscripts(tuples, 1) - 1 as pos, unnest(tuples) as u from batched_gpt_specs)")
def nested_substitution(spark: SparkSession, d: str) -> DataFrame:
    """Texts replaced by a lookup wherever they stand in a nested value."""
    s = table(spark, d, "batched_gpt_specs").select("spec_id", "tuples")
    values = F.create_map(*[F.lit(x) for p in (("holding", "hold"), ("A", "?a"), ("B", "?b")) for x in p])
    new = dataset.substituted(F.col("tuples"), s.schema["tuples"].dataType, values)
    return s.select("spec_id", F.posexplode(new).alias("pos", "u")).select("spec_id", "pos", "u.predicate", "u.args")


@query("select spec_id, consts[3] as third from batched_gpt_specs")
def list_element(spark: SparkSession, d: str) -> DataFrame:
    """An element by its place, null outside of the list."""
    return table(spark, d, "batched_gpt_specs").select("spec_id", F.get("consts", F.lit(2)).alias("third"))


# --- texts --------------------------------------------------------------------------------------------------------


@query("select distinct video_id, fid, fid + 1 as number from frame_annotations where video_id is not null")
def text_frame_key(spark: SparkSession, d: str) -> DataFrame:
    """Composite frame keys split into video and frame, and image files numbered from 1."""
    f = table(spark, d, "frame_annotations").where("video_id is not null").select("video_id", "fid").distinct()
    k = f.select(F.concat("video_id", F.lit("/"), F.lpad(F.col("fid").cast("string"), 6, "0"), F.lit(".png")).alias("key"))
    return k.select(text.split_frame_key(F.col("key")).alias("k"), (text.file_frame(F.col("key")) + 2).alias("number")).select(F.col("k.video").alias("video_id"), "k.fid", "number")


@query("select spec_id, i, list_transform(u.args, lambda a: case when regexp_full_match(a, '[A-Z]') then lower(a) else a end) as lower_args, list_transform(u.args, lambda a: coalesce(case when regexp_full_match(a, '[A-Z]') then var_map['?' || lower(a)] end, a)) as nouns from (select spec_id, var_map, generate_subscripts(tuples, 1) as i, unnest(tuples) as u from batched_gpt_specs where tuples is not null) where list_count(u.args) = len(u.args)")
def program_inline_names(spark: SparkSession, d: str) -> DataFrame:
    """Variables of clauses in lower case, and replaced by their nouns."""
    s = table(spark, d, "batched_gpt_specs").select("spec_id", "var_map", F.posexplode("tuples").alias("i", "u")).where(F.forall("u.args", lambda a: a.isNotNull()))
    return s.select("spec_id", (F.col("i") + 1).alias("i"), text.lower_variables(F.col("u.args")).alias("lower_args"), text.inline_names(F.col("u.args"), F.col("var_map")).alias("nouns"))


@query("select spec_id, args[i] as first, args[j] as second from (select spec_id, args, generate_subscripts(args, 1) as i from batched_gpt_specs), range(1, 30) x(j) where i <> j and j <= len(args)")
def program_ordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All ordered pairs of the arguments."""
    return table(spark, d, "batched_gpt_specs").select("spec_id", F.inline(text.ordered_pairs(F.col("args"))))


@query("select spec_id, a as arg, case when regexp_full_match(a, '[A-Z]') then ascii(a) - 64 else -nullif(list_position(consts, a), 0) end::int as term_id from (select spec_id, consts, unnest(list_concat(coalesce(args, []), coalesce(consts, []))) as a from batched_gpt_specs) where a is not null and not (length(a) = 2 and a[1] = '?')")
def program_term_ids(spark: SparkSession, d: str) -> DataFrame:
    """Variables by their letter, constants by their place in the list."""
    none = F.array().cast("array<string>")
    s = table(spark, d, "batched_gpt_specs").select("spec_id", F.coalesce("consts", none).alias("consts"), F.explode(F.concat(F.coalesce("args", none), F.coalesce("consts", none))).alias("arg"))
    return s.where("arg is not null and not (length(arg) = 2 and left(arg, 1) = '?')").select("spec_id", "arg", text.term_id(F.col("arg"), F.col("consts")).cast("int").alias("term_id"))


@query("select caption_id, list_filter(string_split(translate(caption, '-,._''', '     '), ' '), lambda w: regexp_full_match(w, '\\?.') or regexp_full_match(w, '[A-Z]')) as missing from caption_descriptions where caption is not null")
def text_missing_variables(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "caption_descriptions").where("caption is not null").select("caption_id", text.missing_variables(F.col("caption")).alias("missing"))


SPANS = ["3-7", "12-30", "0-0"]
_SPAN_ROWS = ", ".join(f"({i}, '{r}')" for i, r in enumerate(SPANS))


@query(f"""with x(i, r) as (values {_SPAN_ROWS}) select n_nationkey, split_part(r, '-', 1)::int as "start", split_part(r, '-', 2)::int + 1 as "end" from nation join x on n_nationkey % 3 = i""")
def text_inclusive_range(spark: SparkSession, d: str) -> DataFrame:
    r = F.get(F.array(*map(F.lit, SPANS)), F.col("n_nationkey") % 3)
    return table(spark, d, "nation").select("n_nationkey", F.inline(F.array(text.inclusive_range(r))))


@query("select n_regionkey, 'Context.' || chr(10) || 'Captions:' || chr(10) || string_agg(i || '. video id: ' || n_nationkey || ' caption: ' || n_name, chr(10) order by i) as prompt from (select *, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as i from nation) group by 1")
def text_wrapped_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: F.struct(s["n_nationkey"].cast("string").alias("video_id"), s["n_name"].alias("caption")))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(rows.alias("c")).select("n_regionkey", text.wrapped_prompt("Context.", "Captions:", F.col("c")).alias("prompt"))


@query("select row_id, least(greatest(event_id * 7 - 10, 0) * fps, n_frames - 1)::bigint as first, greatest(least(greatest(event_id * 7 - 5, 0) * fps, n_frames - 1), least(greatest(event_id * 7 - 10, 0) * fps, n_frames - 1))::bigint as last from timestamp_descriptions join videos using (video_id) where event_id is not null")
def video_frame_span(spark: SparkSession, d: str) -> DataFrame:
    """First and last frame of spans of seconds, kept inside the video."""
    t = table(spark, d, "timestamp_descriptions").where("event_id is not null").select("row_id", "video_id", (F.col("event_id") * 7 - 10).alias("s"))
    v = table(spark, d, "videos").select("video_id", "fps", "n_frames")
    span = text.frame_span(F.col("s"), F.col("s") + 5, F.col("fps"), F.col("n_frames"))
    return t.join(v, "video_id").select("row_id", span.alias("f")).select("row_id", F.col("f.first").cast("long").alias("first"), F.col("f.last").cast("long").alias("last"))


@query("select row_id, floor((extract(minute from timestamp_descriptions.created_at) * 60 + extract(second from timestamp_descriptions.created_at)) * fps)::bigint as frame from timestamp_descriptions join videos using (video_id) where timestamp_descriptions.created_at is not null")
def video_timestamp_frame(spark: SparkSession, d: str) -> DataFrame:
    """Frame number of a clock position within the hour."""
    t = table(spark, d, "timestamp_descriptions").where("created_at is not null").select("row_id", "video_id", (F.minute("created_at") * 60 + F.second("created_at")).alias("s"))
    return t.join(table(spark, d, "videos").select("video_id", "fps"), "video_id").select("row_id", F.floor(F.col("s") * F.col("fps")).alias("frame"))


@query("select spec_id, list_filter(list_transform(windowed_prog, lambda w: w.prog), lambda p, i: windowed_prog[i].win.end_no - windowed_prog[i].win.start_no >= windowed_prog[1].win.end_no - windowed_prog[1].win.start_no) as progs from batched_gpt_specs where windowed_prog is not null")
def program_full_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a program that are as long as its first one."""
    size = lambda w: w["win"]["end_no"] - w["win"]["start_no"]
    s = table(spark, d, "batched_gpt_specs").where("windowed_prog is not null")
    full = F.filter("windowed_prog", lambda w: size(w) >= size(F.get("windowed_prog", F.lit(0))))
    return s.select("spec_id", F.transform(full, lambda w: w["prog"]).alias("progs"))


# --- scores and masks ---------------------------------------------------------------------------------------------


@query(SIM + " select vec_id, keyword, round(sim * exp(2.5), 5) as score from sim")
def score_scaled_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Similarity times the exponential of the model's scale."""
    s = scoring.keyword_similarity(table(spark, d, "embeddings").select("vec_id", "label", "embedding"))
    return s.select("vec_id", "keyword", F.round(F.col("sim") * F.exp(F.lit(2.5)), 5).alias("score"))


@query(facts("select video_id, fid, oid, predicate, case when prob > 0 and prob < 1 then round(ln(prob / (1 - prob)), 6) end as logit from u"))
def score_logit(spark: SparkSession, d: str) -> DataFrame:
    return U(spark, d).select("video_id", "fid", "oid", "predicate", F.round(metrics.logit(F.col("prob")), 6).alias("logit"))


@query("select vec_id, len(embedding) * 4 as bytes from embeddings")
def vector_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of a vector of 32-bit numbers."""
    return table(spark, d, "embeddings").select("vec_id", (F.size("embedding") * 4).cast("long").alias("bytes"))


@query("select l_orderkey, l_linenumber, round(case when l_quantity + l_linenumber <> 0 then 2 * abs(l_quantity - l_linenumber) / (l_quantity + l_linenumber) else 0 end, 6)::double as difference, case when greatest(l_linenumber, 3) < least(l_linenumber + 4, l_quantity) then greatest(l_linenumber, 3) else -1 end::double as first from lineitem")
def geom_relative_difference(spark: SparkSession, d: str) -> DataFrame:
    """Relative difference of two sizes and the start of the overlap of two spans."""
    li = table(spark, d, "lineitem")
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    span = geo.overlap(n, n + 4, F.lit(3.0), q)
    return li.select("l_orderkey", "l_linenumber", F.round(geo.relative_difference(q, n), 6).alias("difference"), span["start"].cast("double").alias("first"))


ONE_BOX = BOXES.replace("with r as", "with all_r as") + ", r as (select video_id, id, x1, y1, x2, y2 from (select *, row_number() over (partition by video_id, id order by score desc, x1, y1, x2, y2) as n from all_r) where n = 1)"


def _masks(spark: SparkSession, d: str) -> DataFrame:
    """``(video_id, id, m)``: the mask of the best box of each id."""
    one = boxes(spark, d).groupBy("video_id", "id").agg(F.min_by("b", F.struct(-F.col("score"), "b")).alias("b"))
    return one.select("video_id", "id", geo.box_runs(F.col("b"), F.lit(10_000), F.lit(10_000)).alias("m"))


@query(ONE_BOX + f" select a.video_id, a.id as i, b.id as j, round({_W} / ({_A('a')} + {_A('b')} - {_W}), 6) as iou from r a join r b on a.video_id = b.video_id where a.id % 2 = 1 and b.id % 2 = 0 and {_W} > 0")
def mask_iou_join(spark: SparkSession, d: str) -> DataFrame:
    """Masks of prompts against predicted masks of the same frame."""
    m = _masks(spark, d)
    return dataset.mask_iou(m.where("id % 2 = 1"), m.where("id % 2 = 0"), ["video_id"]).select("video_id", "i", "j", F.round("iou", 6).alias("iou"))


_CUT = lambda *x: (
    f"(greatest(least({', '.join(f'{t}.x2' for t in x)}) - greatest({', '.join(f'{t}.x1' for t in x)}) + 1, 0) * greatest(least({', '.join(f'{t}.y2' for t in x)}) - greatest({', '.join(f'{t}.y1' for t in x)}) + 1, 0))"
)


@query(ONE_BOX + f""", k1 as (select * from r where id = 1), k2 as (select * from r where id = 2), n as (select * from r where id > 2),
o as (select n.video_id, n.id, {_A('n')} as size, case when a.id is null then 0 else {_CUT('n', 'a')} end + case when b.id is null then 0 else {_CUT('n', 'b')} end - case when a.id is null or b.id is null then 0 else {_CUT('n', 'a', 'b')} end as old from n left join k1 a on a.video_id = n.video_id left join k2 b on b.video_id = n.video_id)
select video_id, id from o where size > 1000 and 1 - old / size > 0.5""")
def mask_new_objects(spark: SparkSession, d: str) -> DataFrame:
    """Found masks most of which the known ones don't cover."""
    m = _masks(spark, d)
    return dataset.new_masks(m.where("id <= 2"), m.where("id > 2"), ["video_id"], least_area=1000)


@query(BOXES + " select video_id, id, 5 as pixels, true as inside from r")
def mask_sampled_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Five seeded pixels of each box, and whether all lie in it."""
    b = F.col("b")
    p = boxes(spark, d).withColumn("p", dataset.sampled_pixels(b, 5, 42, F.col("video_id"), F.col("id")))
    ok = F.forall("p", lambda q: (q["x"] >= b["x1"]) & (q["x"] <= b["x2"]) & (q["y"] >= b["y1"]) & (q["y"] <= b["y2"]))
    return p.select("video_id", "id", F.size("p").alias("pixels"), ok.alias("inside"))


@query("select l_orderkey as video_id, l_linenumber as id, l_linenumber - 1 as fid, l_suppkey as oid, case when l_quantity >= 5 and l_linenumber * 7 + 20 >= 5 then true else false end as kept from lineitem where l_quantity >= 5")
def track_reformat(spark: SparkSession, d: str) -> DataFrame:
    """Tracks as frame rows; boxes with a side under 5 are left out."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    side = F.least(F.col("l_quantity"), F.col("l_linenumber") * 7 + 20) >= 5
    return li.where(side).select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("id"), (F.col("l_linenumber") - 1).alias("fid"), F.col("l_suppkey").alias("oid"), side.alias("kept"))


@query(facts("select video_id, fid, list(distinct oid order by oid) as oids from u group by 1, 2"))
def track_inversion(spark: SparkSession, d: str) -> DataFrame:
    """From frames per object to objects per frame."""
    per_object = U(spark, d).groupBy("video_id", "oid").agg(F.collect_set("fid").alias("fids"))
    frames = per_object.select("video_id", "oid", F.explode("fids").alias("fid"))
    return frames.groupBy("video_id", "fid").agg(F.array_sort(F.collect_set("oid")).alias("oids"))
