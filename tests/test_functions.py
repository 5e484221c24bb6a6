from pyspark.sql import Row, functions as F

from chronoscene.functions import geometry as geo, text
from chronoscene.sources import readers


def one(spark, col, **values):
    return spark.createDataFrame([Row(**values)]).select(col.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.clean_caption(F.col("s")), s="A man (his left, 2nd) runs .  Then , stops") == "A man runs. Then, stops"
    assert one(spark, text.without_variables(F.col("s")), s="holding-A ?b the cup") == "holding_the_cup"
    assert one(spark, text.split_logic(F.col("s")), s="a(A) and b(B);c(C)") == ["a(A)", "b(B)", "c(C)"]
    assert one(spark, text.split_logic(F.col("s")), s="(a(A) or b(B))") == ["a(A)", "b(B)"]
    assert one(spark, text.split_commas(F.col("s")), s="a(A, B),b(B),c") == ["a(A, B)", "b(B)", "c"]
    for s, e in {"3-7": (3, 7), "5": (5, 6), "-4": (0, 4), "6-": (6, 10000), "x": (None, None)}.items():
        assert tuple(one(spark, text.time_range(F.col("s")), s=s)) == e
    assert tuple(one(spark, text.period(F.col("s")), s="['1/4', 3/4]")) == (0.25, 0.5, 0.75)
    assert one(spark, text.period(F.col("s")), s="whole")["mid"] is None
    assert one(spark, text.class_prompt(F.col("s")), s=["Cat", "dog "]) == "cat. dog."
    assert one(spark, text.kept_keywords(F.col("s")), s=["'s", "a-b c", "a b c d", None]) == ["a b c"]
    assert one(spark, text.filled_keywords(F.col("s")), s=["x"]) == ["x"]
    assert one(spark, text.variable_id(F.col("s")), s="?c") == 3


def test_geometry(spark):
    b = lambda *v: geo.box(*[F.lit(x) for x in v])
    assert one(spark, geo.iou(b(0, 0, 9, 9), b(9, 9, 18, 18)), s=1) == 1 / 199
    assert one(spark, geo.iou(b(0, 0, 9, 9), b(10, 10, 18, 18)), s=1) == 0
    assert one(spark, geo.span_iou(F.lit(0), F.lit(0), F.lit(3), F.lit(3)), s=1) == 0
    assert tuple(one(spark, geo.overlap(F.lit(0), F.lit(5), F.lit(3), F.lit(9)), s=1)) == (3, 5)
    assert tuple(one(spark, geo.overlap(F.lit(0), F.lit(3), F.lit(3), F.lit(9)), s=1)) == (-1, -1)
    runs = geo.box_runs(b(2, 3, 500, 4), F.lit(10), F.lit(8))
    assert one(spark, geo.runs_area(runs), s=1) == 16 and tuple(one(spark, geo.runs_xywh(runs), s=1)) == (2, 3, 8, 2)
    assert tuple(one(spark, geo.enlarged(F.lit(10.0), F.lit(10.0), F.lit(10.0), F.lit(10.0), 2.0, F.lit(22.0), F.lit(100.0)), s=1)) == (5, 5, 17, 20)


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "maps.jsonl").write_text('{"a": "1", "b": "2"}\nnot json\n{"a": "3"}\n')
    assert {(r.key, r.value) for r in readers.json_maps(spark, str(tmp_path / "maps.jsonl")).collect()} == {("a", "3"), ("b", "2")}
    (tmp_path / "names.txt").write_text("cat\n\nsofa\n")
    assert [r.name for r in readers.vocabulary(spark, str(tmp_path / "names.txt"), {"sofa": "couch"}).collect()] == ["cat", "couch"]
    (tmp_path / "v.json").write_text('{"video_id": "v", "subject/objects": [{"tid": 0, "category": "dog"}], "trajectories": [[{"tid": 0, "bbox": {"xmin": 1, "ymin": 2, "xmax": 3, "ymax": 4}, "generated": 0}, {"tid": 1, "bbox": null, "generated": 1}]], "relation_instances": [{"subject_tid": 0, "object_tid": 1, "predicate": "near", "begin_fid": 0, "end_fid": 1}]}')
    objects, relations = readers.video_relations(spark, str(tmp_path / "v.json"))
    assert {(r.fid, r.oid, r.category) for r in objects.collect()} == {(0, 0, "dog"), (0, 1, "unknown")} and relations.first().predicate == "near"
    (tmp_path / "split.json").write_text('{"train": ["x"], "val": ["y", "z"]}')
    assert [r.id for r in readers.split_ids(spark, str(tmp_path / "split.json"), "val").collect()] == ["y", "z"]
    (tmp_path / "f" / "sub").mkdir(parents=True)
    for n in ("a2", "a10"):
        (tmp_path / "f" / "sub" / f"{n}.png").write_bytes(b"x")
    assert [r.name for r in readers.files(spark, str(tmp_path / "f"), "png").orderBy("prefix", "number").collect()] == ["a2", "a10"]
    done = str(tmp_path / "done")
    readers.write_missing(spark.createDataFrame([(1,), (2,)], "k int"), done, "k")
    readers.write_missing(spark.createDataFrame([(2,), (3,)], "k int"), done, "k")
    assert sorted(r.k for r in spark.read.parquet(done).collect()) == [1, 2, 3]
    readers.write_json_lines(spark.createDataFrame([(1,)], "k int"), str(tmp_path / "out"))
    assert readers.json_records(spark, str(tmp_path / "out"), "k int, _corrupt string").first().k == 1
    (tmp_path / "t.tsv").write_text("key\tvid\na\tb\n")
    assert readers.tab_separated(spark, str(tmp_path / "t.tsv"), "key string, vid string").first().vid == "b"
    (tmp_path / "spec.jsonl").write_text('{"video_id": "v", "prog": "x"}\n{"video_id": "v", "prog": "y"}\n')
    assert [r.prog for r in readers.spec_records(spark, str(tmp_path / "spec.jsonl")).collect()] == ["y"]


def test_masks(spark):
    spans = lambda s: F.from_json(F.lit(s), "array<struct<a:bigint,b:bigint>>")
    assert one(spark, geo.union_length(spans('[{"a":5,"b":9},{"a":0,"b":2},{"a":2,"b":3},{"a":6,"b":7}]')), s=1) == 9
    assert one(spark, geo.union_length(spans("[]")), s=1) == 0
    image = [0, 1, 1, 2, 1, 1, 3, 2, 9, 0, 0, 2]
    runs = one(spark, geo.palette_runs(F.col("p"), 4, F.lit(3)), p=image)
    assert [tuple(r) for r in runs] == [(1, 0, 1, 2), (1, 1, 0, 2), (2, 0, 3, 1), (2, 1, 3, 1), (2, 2, 3, 1), (3, 1, 2, 1)]


def test_every_period_of_a_row_is_parsed(spark):
    from chronoscene.plans.text_queries import parsed_periods

    rows = [(1, ["[0, 1/4]", " [ 60/120 ,90/120] ", None, "n/a", "[1/2]", "[0, 1/2, 1]", "[1/0, 1]"]), (2, None), (3, [])]
    got = [tuple(r) for r in parsed_periods(spark.createDataFrame(rows, "row_id long, video_location_precise array<string>")).orderBy("pos").collect()]
    assert got == [(1, 0, 0.0, 0.125, 0.25), (1, 1, 0.5, 0.625, 0.75), *((1, i, None, None, None) for i in range(2, 7))]


def test_dataset_operators(spark):
    from pyspark.sql import functions as F

    from chronoscene.operators import dataset

    row = spark.createDataFrame([('{"a": {"b": 1, "c": [1]}, "d": 2}', '{"a": {"c": null, "e": 3}}'), (None, "{"), ("[1]", '{"x": 1}')], "l string, r string")
    assert [r.m for r in row.select(dataset.merged_json(F.col("l"), F.col("r")).alias("m")).collect()] == ['{"a": {"b": 1, "c": null, "e": 3}, "d": 2}', "{}", '{"x": 1}']
    assert [r.m for r in row.select(dataset.renamed_keys(F.col("l"), {"b": "z"}).alias("m")).collect()] == ['{"a": {"z": 1, "c": [1]}, "d": 2}', None, "[1]"]
    words = spark.createDataFrame([("ladr",), (None,), ("",)], "t string")
    assert [r.i for r in words.select(dataset.best_by_ratio(F.col("t"), ["mirror", "ladder", "ladders"]).alias("i")).collect()] == [1, None, 0]
    points = spark.createDataFrame([("v", -3), ("v", 5), ("w", 5), ("v", None)], "k string, p int")
    spans = spark.createDataFrame([("v", -10, 6, "long"), ("v", 5, 5, "empty"), ("v", 6, 9, "late"), ("v", None, 9, "open")], "k string, s int, e int, n string")
    assert sorted((r.p, r.n) for r in dataset.points_in_intervals(points, spans, "k", "p", "s", "e", 4).collect()) == [(-3, "long"), (5, "long")]
    assert dataset.sharded(words.where("false"), "t", 3).count() == 0
    frames = spark.createDataFrame([("v", 1, ["a"], None, [(0, 0, 1, 1), None], "x")] * 2, "video_id string, fid int, gt_labels array<string>, gt_instance_ids array<bigint>, gt_bboxes array<struct<x1:int,y1:int,x2:int,y2:int>>, id string")
    assert [(r.pos, r.label, r.oid, r.b is None) for r in dataset.elements(frames).orderBy("pos").collect()] == [(0, "a", None, False), (1, None, None, True)]


def test_frame_paths_of_any_length(spark):
    from pyspark.sql import functions as F

    from chronoscene.functions import text

    rows = spark.createDataFrame([(7,), (10000,), (123456,)], "n int").select(text.frame_path(F.lit("m"), F.col("n")).alias("p")).collect()
    assert [r.p for r in rows] == ["m/0007.png", "m/10000.png", "m/123456.png"]
