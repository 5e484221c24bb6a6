import random

import numpy as np
import pytest

from chronoscene.operators import dataset
from chronoscene.operators.coverage import areas, covered_parts, packed, unpacked
from chronoscene.plans import frame_queries
from chronoscene.plans.frame_queries import covered, merged

BOX = "video_id int, id int, b struct<x1:int,y1:int,x2:int,y2:int>"


def test_only_boxes_above_seven_tenths_are_already_present(spark):
    known = spark.createDataFrame([(1, 1, (0, 0, 9, 9))], BOX)
    new = spark.createDataFrame([(1, 3, (3, 0, 12, 9)), (1, 4, (1, 0, 10, 9)), (2, 5, (0, 0, 9, 9)), (1, 6, (50, 50, 59, 59))], BOX)
    assert sorted(map(tuple, merged(known, new).collect())) == [(1, 1), (1, 3), (1, 6), (2, 5)]


def shuffled(spark, df):
    """Result of ``df`` and the rows that its stages wrote for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    written = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, None))}
    before = set(written())
    rows = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return rows, sum(n for key, n in written().items() if key not in before)


def some_boxes(keys, n, rng):
    return [(k, i, (x := rng.randrange(-300, 300), y := rng.randrange(-300, 300), x + rng.randrange(-2, 60), y + rng.randrange(-2, 200))) for k in keys for i in range(n)]


def pixels(rows):
    out = {}
    for k, _, (x1, y1, x2, y2) in rows:
        out.setdefault(k, set()).update((x, y) for x in range(x1, x2 + 1) for y in range(y1, y2 + 1))
    return {k: len(v) for k, v in out.items() if v}


def test_covered_counts_pixels_and_shuffles_boxes_instead_of_rows(spark):
    rows = some_boxes(range(5), 30, random.Random(1))
    items = spark.createDataFrame(rows + rows[:7] + [(7, 1, None), (7, 2, (0, None, 3, 3)), (8, 1, (3, 3, 2, 9)), (9, 1, (4, 4, 4, 4))], BOX)
    got, moved = shuffled(spark, covered(items))
    assert {r.video_id: r.area for r in got} == pixels(rows) | {9: 1}
    assert moved < 1000


def lines(rng, n):
    """Line items of segments 0 to 2; see ``graph_queries.boxes``."""
    return [(k, i, rng.randrange(500), rng.randrange(500), 1.0) for k in range(0, 300, 2) for i in range(n)]


def uncovered(rows):
    boxes = [(k, i, (p % 200, s % 100, p % 200 + 20 + i * 7, s % 100 + 15 + k % 30)) for k, i, p, s, _ in rows]
    return {k: round(1 - n / 45000.0, 6) for k, n in pixels(boxes).items()}


@pytest.fixture
def items_dir(spark, tmp_path):
    rows = lines(random.Random(2), 4)
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path), rows


def test_first_uncovered_frame_reads_the_coverage_once(spark, items_dir):
    d, rows = items_dir
    u = uncovered(rows)
    want = {}
    for k in sorted(u):
        seg = k // 100
        base = u[min(x for x in u if x // 100 == seg)]
        if u[k] > base + 0.01:
            want.setdefault(seg, k)
    got, moved = shuffled(spark, frame_queries.first_uncovered_frame(spark, d))
    assert {r.seg: r.fid for r in got} == want
    assert moved < 4 * len(rows)


def test_mask_union_area_shuffles_boxes(spark, items_dir):
    d, rows = items_dir
    got, moved = shuffled(spark, frame_queries.mask_union_area(spark, d))
    assert {r.video_id: r.uncovered for r in got} == uncovered(rows)
    assert moved < 4 * len(rows)


def test_propagation_passes_shuffle_boxes(spark, items_dir):
    d, rows = items_dir
    u, want, last = uncovered(rows), [], {}
    for k in sorted(u):
        seg = k // 100
        if seg not in last or u[k] > last[seg][1] + 0.01:
            last[seg] = (last[seg][0] + 1 if seg in last else 0, u[k])
            want.append((seg, last[seg][0], k))
    got, moved = shuffled(spark, frame_queries.propagation_passes(spark, d))
    assert sorted(map(tuple, got)) == want
    assert moved < 4 * len(rows)


def many_items(spark, path):
    rows = lines(random.Random(3), 40)
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return rows


def test_mask_union_area_shuffles_blocks_of_boxes(spark, tmp_path):
    rows = many_items(spark, tmp_path)
    got, moved = shuffled(spark, frame_queries.mask_union_area(spark, str(tmp_path)))
    assert {r.video_id: r.uncovered for r in got} == uncovered(rows)
    assert moved < len(rows) / 4


def test_propagation_passes_shuffle_blocks_of_boxes_and_frames_once(spark, tmp_path):
    rows = many_items(spark, tmp_path)
    u, want, last = uncovered(rows), [], {}
    for k in sorted(u):
        seg = k // 100
        if seg not in last or u[k] > last[seg][1] + 0.01:
            last[seg] = (last[seg][0] + 1 if seg in last else 0, u[k])
            want.append((seg, last[seg][0], k))
    got, moved = shuffled(spark, frame_queries.propagation_passes(spark, str(tmp_path)))
    assert sorted(map(tuple, got)) == want
    assert moved < len(rows) / 4


def test_covered_of_null_keys_far_boxes_and_small_blocks(spark):
    rng, low, high = random.Random(4), -(1 << 31), (1 << 31) - 1
    rows = some_boxes([3, -5, None], 60, rng) + some_boxes([1 << 40], 300, rng) * 2
    far = [(8, 1, (low, -1, high, 2)), (8, 2, (0, 1, high, 1)), (9, 1, (5, low, 5, low + 200)), (9, 2, (5, high - 1, 6, high))]
    items = spark.createDataFrame(rows + far + [(7, 1, (3, 3, 2, 9)), (None, 1, None)], BOX.replace("video_id int", "video_id long"))
    want = pixels(rows) | {8: 4 << 32, 9: 201 + 4}
    for block in (1 << 20, 50):
        parts = covered_parts(items, block=block).collect()
        got = {}
        for r in parts:
            got[r.video_id] = got.get(r.video_id, 0) + r.n
        assert got == want
    assert covered(items.limit(0)).collect() == []


def test_blocks_are_restored_and_areas_do_not_depend_on_how_many_boxes_are_looked_at():
    rng = np.random.default_rng(5)
    columns = [rng.integers(-(1 << 63), 1 << 63, 500) >> rng.integers(0, 63, 500), rng.integers(0, 2, 500).astype(np.uint8)]
    columns += [rng.integers(-(1 << 31), 1 << 31, 500).astype(np.int32) for _ in range(4)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, unpacked(packed(columns)), strict=True))
    y = rng.integers(0, 100, 500).astype(np.int32)
    some = [rng.integers(0, 9, 500), columns[1], *[rng.integers(0, 100, 500).astype(np.int32) for _ in range(1)], y, rng.integers(0, 40, 500).astype(np.int32), np.minimum(rng.integers(0, 40, 500), 127 - y).astype(np.int32)]
    sums = [{(k, n): a for k, n, a in zip(*map(np.ndarray.tolist, areas(some, 128, most)), strict=True)} for most in (1, 100, 1 << 20)]
    boxes = [((k, n), 0, (a, b, a + w, b + h)) for k, n, a, b, w, h in zip(*map(np.ndarray.tolist, some), strict=True)]
    assert sums[0] == sums[1] == sums[2] == pixels(boxes)


def test_mask_boxes_follow_from_corners_and_shuffle_frames(spark):
    one = lambda *b: (list(map(str, range(len(b)))), list(range(len(b))), list(b))
    rows = [("v", 0, *one((0, 0, 5, 6), None, (3, 3, 3, 9), (2, 1, 4, 2)))] * 2
    rows += [("v", 1, *one((1, 5, 9, 5), (9, 0, 1, 7))), ("v", 2, None, None, None), ("v", 3, [], [], []), ("w", 0, *one((7, 0, 8, 1 << 30)))]
    rows += [("w", 1, ["a"], None, [(1, 1, 3, 3)]), ("w", 1, ["b"], None, [(1, 1, 3, 3), (0, 0, 2, 2)]), ("w", 2, [None], [None], [(None, 1, 3, 3)])]
    frames = spark.createDataFrame(rows, "video_id string, fid int, gt_labels array<string>, gt_instance_ids array<long>, gt_bboxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
    got, moved = shuffled(spark, dataset.mask_boxes(frames))
    assert {(r.video_id, r.fid): (r.x1, r.y2) for r in got} == {("v", 0): ([0, 2], [5, 1]), ("w", 0): ([7], [(1 << 30) - 1]), ("w", 1): ([1, 1, 0], [2, 2, 1])}
    assert moved <= len(rows)
