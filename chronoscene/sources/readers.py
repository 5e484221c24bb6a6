"""Readers of the input layouts to canonical tables, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T


def json_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None, whole_file: bool = False) -> DataFrame:
    """JSON lines, or with ``whole_file`` one JSON value per file; records that don't parse keep their text in ``_corrupt``."""
    reader = spark.read.option("multiLine", whole_file).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return (reader.schema(schema) if schema else reader).json(path)


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def json_maps(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """``(key, value)`` of lines that hold maps; of equal keys the one of the last line counts, bad lines are skipped."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    entries = lines.select("file", "line", F.explode(F.from_json("value", f"map<string,{value}>")))
    return entries.groupBy("key").agg(F.max_by("value", F.struct("file", "line")).alias("value"))


def vocabulary(spark: SparkSession, path: str, substitutes: dict[str, str] | None = None) -> DataFrame:
    """``(name)``, one per non-blank line, some replaced."""
    names = spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")
    if substitutes:
        table = F.create_map(*[F.lit(x) for pair in substitutes.items() for x in pair])
        names = names.select(F.coalesce(table[F.col("name")], F.col("name")).alias("name"))
    return names


def tab_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


def split_ids(spark: SparkSession, path: str, phase: str) -> DataFrame:
    """``(id)`` of the phase in a JSON file that maps phases to lists."""
    return spark.read.schema(f"`{phase}` array<string>").json(path, multiLine=True).select(F.explode(phase).alias("id"))


def files(spark: SparkSession, path: str, extension: str, recursive: bool = True) -> DataFrame:
    """``(path, name, prefix, number, length)`` of the files of a kind; ``prefix`` and ``number`` sort names naturally."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", f"*.{extension}")
    name = F.regexp_extract("path", rf"([^/]+)\.{extension}$", 1)
    number = F.nullif(F.regexp_extract(name, r"(\d+)$", 1), F.lit("")).cast("long")
    return reader.load(path).select("path", name.alias("name"), F.regexp_replace(name, r"\d+$", "").alias("prefix"), number.alias("number"), "length")


FRAME_BOX = "struct<tid:bigint,category:string>"
TRAJECTORY = "array<array<struct<tid:bigint,bbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>,generated:int>>>"
RELATION = "array<struct<subject_tid:bigint,object_tid:bigint,predicate:string,begin_fid:int,end_fid:int>>"
VIDEO_RELATION = f"video_id string, `subject/objects` array<{FRAME_BOX}>, trajectories {TRAJECTORY}, relation_instances {RELATION}"


def video_relations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Objects ``(video_id, fid, oid, category, box, generated)`` and relations ``(video_id, o1, o2, predicate, begin, end)``.

    One JSON per video; frames are places in ``trajectories``; intervals are half-open. Unknown categories are 'unknown'.
    """
    raw = spark.read.schema(VIDEO_RELATION).json(path, multiLine=True)
    names = F.map_from_entries(F.transform("subject/objects", lambda o: F.struct(o["tid"], o["category"])))
    frames = raw.select("video_id", names.alias("names"), F.posexplode("trajectories").alias("fid", "objs")).select("video_id", "names", "fid", F.explode("objs").alias("o"))
    objects = frames.select("video_id", "fid", F.col("o.tid").alias("oid"), F.coalesce(F.try_element_at("names", F.col("o.tid")), F.lit("unknown")).alias("category"), F.col("o.bbox").alias("box"), "o.generated")
    r = raw.select("video_id", F.explode("relation_instances").alias("r"))
    return objects, r.select("video_id", F.col("r.subject_tid").alias("o1"), F.col("r.object_tid").alias("o2"), "r.predicate", F.col("r.begin_fid").alias("begin"), F.col("r.end_fid").alias("end"))


FRAME_OBJECT = (
    "struct<class:string,visible:boolean,bbox:array<double>,attention_relationship:array<string>,spatial_relationship:array<string>,contacting_relationship:array<string>,metadata:struct<set:string>>"
)


def frame_objects(spark: SparkSession, path: str, phase: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Objects ``(video_id, fid, pos, category, x1, y1, x2, y2, visible)`` and relations ``(video_id, fid, pos, predicate)`` of a JSON
    map from ``VIDEO/FRAME.png`` to lists of objects with boxes (x, y, width, height).

    With ``phase`` only frames whose first object belongs to that set. Objects that aren't visible are left out, frames without
    objects too. Image numbers start at 1, frames at 0.
    """
    from chronoscene.functions.text import file_frame, split_frame_key

    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,array<{FRAME_OBJECT}>>")).alias("key", "objects"))
    if phase is not None:
        raw = raw.where(F.get("objects", F.lit(0))["metadata"]["set"] == phase)
    rows = raw.select(split_frame_key(F.col("key"))["video"].alias("video_id"), file_frame(F.col("key")).alias("fid"), F.posexplode("objects").alias("pos", "o")).where("o.visible")
    b = lambda i: F.get("o.bbox", F.lit(i))
    objects = rows.select("video_id", "fid", "pos", F.col("o.class").alias("category"), b(0).alias("x1"), b(1).alias("y1"), (b(0) + b(2)).alias("x2"), (b(1) + b(3)).alias("y2"), F.col("o.visible").alias("visible"))
    kinds = [F.coalesce(f"o.{k}_relationship", F.array().cast("array<string>")) for k in ("attention", "spatial", "contacting")]
    return objects, rows.select("video_id", "fid", "pos", F.explode(F.concat(*kinds)).alias("predicate"))


PANOPTIC = (
    "data array<struct<video_id:string,captions:array<struct<description:string,time:string>>,objects:array<struct<object_id:bigint,category:string>>,"
    "relations:array<array<string>>>>, split map<string,struct<train:array<string>,val:array<string>>>"
)


def panoptic_videos(spark: SparkSession, path: str, phase: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects ``(video_id, oid, category)``, relations ``(video_id, o1, o2, predicate, begin, end)`` and captions ``(video_id, start, end,
    caption)`` of the videos of a phase ('train' or 'val') in one JSON file.

    A relation is a list of subject, object, predicate and a list of half-open frame ranges; captions hold for ``a-b``.
    """
    from chronoscene.functions.text import clean_caption, time_range

    raw = spark.read.schema(PANOPTIC).json(path, multiLine=True)
    wanted = raw.select(F.explode(F.flatten(F.transform(F.map_values("split"), lambda s: s[phase]))).alias("video_id")).distinct()
    v = raw.select(F.inline("data")).join(wanted, "video_id", "left_semi")
    objects = v.select("video_id", F.explode("objects").alias("o")).select("video_id", F.col("o.object_id").alias("oid"), "o.category")
    r = v.select("video_id", F.explode("relations").alias("r")).select("video_id", *[F.get("r", F.lit(i)).alias(c) for i, c in enumerate(("o1", "o2", "predicate", "spans"))])
    spans = r.select("video_id", F.col("o1").cast("long").alias("o1"), F.col("o2").cast("long").alias("o2"), "predicate", F.explode(F.from_json("spans", "array<array<int>>")).alias("s"))
    relations = spans.select("video_id", "o1", "o2", "predicate", F.get("s", F.lit(0)).alias("begin"), F.get("s", F.lit(1)).alias("end"))
    captions = v.select("video_id", F.explode("captions").alias("c")).select("video_id", F.inline(F.array(time_range(F.col("c.time")))), clean_caption(F.col("c.description"), trim=True).alias("caption"))
    return objects, relations, captions


def caption_records(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """``(video_id, video, data_source, caption)`` of a JSON list of caption records, of the given sources only; the last row per video and source."""
    rows = spark.read.schema("id string, video string, data_source string, caption string").json(path, multiLine=True).withColumnRenamed("id", "video_id")
    rows = rows.where("video_id is not null").withColumn("_at", F.monotonically_increasing_id())
    if sources is not None:
        rows = rows.where(F.col("data_source").isin(*sources))
    return last_per_key(rows, ["video_id", "data_source"], [F.col("_at")]).drop("_at")


def settings(path: str, overrides: dict[str, object] | None = None) -> dict[str, object]:
    """Settings of a JSON file with those that are given and not None in their place; unknown names are refused."""
    import json

    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    given = {k: v for k, v in (overrides or {}).items() if v is not None}
    if unknown := given.keys() - found.keys():
        raise KeyError(f"unknown settings {sorted(unknown)}")
    return {**found, **given}


SPEC = (
    "video_id string, unary_kws array<string>, binary_kws array<string>, var_map map<string,string>, tuples array<struct<positive:boolean,predicate:string,args:array<string>>>, prog string,"
    " windowed_prog array<struct<window:struct<start:int,end:int>,prog:string>>, consts array<string>, binary_predicates array<struct<predicate:string,from:string,to:string>>, args array<string>, caption string,"
    " duration array<string>, `video location` array<string>, `duration precise` array<string>, `video location precise` array<string>"
)


def spec_records(spark: SparkSession, path: str) -> DataFrame:
    """Compiled spec records of JSON lines, the last one per video."""
    rows = spark.read.schema(SPEC).json(path).withColumn("_at", F.monotonically_increasing_id())
    return last_per_key(rows, ["video_id"], [F.col("_at")]).drop("_at")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """A small table of metrics as one JSON file; the rows are aggregates, one per metric and group."""
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_missing(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the table at ``path`` doesn't hold yet."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    (df.join(done, key, "left_anti") if done is not None else df).write.mode("append").parquet(path)


def datalog_facts(df: DataFrame, group: str, relation: str, values: list[str], prob: str | None = None) -> DataFrame:
    """``(group, line)``: ``rel name = {p::(…), …}`` per group, texts in quotes, facts in the order of their values."""
    shown = [F.concat(F.lit('"'), F.col(c), F.lit('"')) if df.schema[c].dataType == T.StringType() else F.col(c).cast("string") for c in values]
    fact = F.concat(F.lit("("), F.concat_ws(",", *shown), F.lit(")"))
    fact = F.concat(F.format_string("%.6f::", prob), fact) if prob else fact
    facts = F.transform(F.array_sort(F.collect_list(F.struct(*values, fact.alias("_fact")))), lambda s: s["_fact"])
    return df.groupBy(group).agg(F.concat(F.lit(f"rel {relation} = {{"), F.array_join(facts, ", "), F.lit("}")).alias("line"))
