"""Boxes, spans and run-length masks as column expressions. Boxes are structs with x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def clamp(v: Column, top: Column) -> Column:
    """``v`` between 0 and ``top``, both allowed."""
    return F.least(F.greatest(v, F.lit(0)), top)


def floor_clamp(v: Column, top: Column) -> Column:
    return clamp(F.floor(v), top)


def from_xywh(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return box(clamp(x, width), clamp(y, height), clamp(x + w, width), clamp(y + h, height))


def resized(b: Column, ratio_x: Column, ratio_y: Column) -> Column:
    """The box in a frame whose sides are the given shares of the new ones: floor of the quotient."""
    at = lambda v, ratio: F.floor(v / ratio).cast("int")
    return box(at(b["x1"], ratio_x), at(b["y1"], ratio_y), at(b["x2"], ratio_x), at(b["y2"], ratio_y))


def enlarged(x: Column, y: Column, w: Column, h: Column, ratio: float, width: Column, height: Column) -> Column:
    """struct(x, y, w, h): the box with sides ``ratio`` times as long around its middle, cut at the frame."""
    left, top = F.greatest(x - w * (ratio - 1) / 2, F.lit(0.0)), F.greatest(y - h * (ratio - 1) / 2, F.lit(0.0))
    return F.struct(left.alias("x"), top.alias("y"), F.least(w * ratio, width - left).alias("w"), F.least(h * ratio, height - top).alias("h"))


def area(b: Column) -> Column:
    """Pixels of a box with inclusive ends."""
    return (b["x2"] - b["x1"] + 1) * (b["y2"] - b["y1"] + 1)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes with inclusive ends; boxes that touch share a line of pixels."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + 1, F.lit(0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + 1, F.lit(0))
    both = w * h
    return both / (area(a) + area(b) - both)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """struct(start, end) of the intersection of half-open spans, (-1, -1) if there is none."""
    s, e = F.greatest(s1, s2), F.least(e1, e2)
    return F.when(s < e, F.struct(s.alias("start"), e.alias("end"))).otherwise(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")))


def span_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of half-open spans of whole numbers, 0 if the union is empty."""
    both = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    union = F.greatest(e1 - s1, F.lit(0)) + F.greatest(e2 - s2, F.lit(0)) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def nearest_corners(a: Column, b: Column) -> Column:
    """struct(distance, corner_a, corner_b) of the closest pair of corners, numbered 1..4 in reading order."""
    corners = lambda x: [(x["x1"], x["y1"]), (x["x2"], x["y1"]), (x["x1"], x["y2"]), (x["x2"], x["y2"])]
    pairs = [
        F.struct(((ax - bx) * (ax - bx) + (ay - by) * (ay - by)).cast("double").alias("d"), F.lit(i + 1).alias("a"), F.lit(j + 1).alias("b"))
        for i, (ax, ay) in enumerate(corners(a)) for j, (bx, by) in enumerate(corners(b))
    ]
    best = F.array_min(F.array(*pairs))
    return F.struct(F.sqrt(best["d"]).alias("distance"), best["a"].alias("corner_a"), best["b"].alias("corner_b"))


def box_runs(b: Column, width: Column, height: Column) -> Column:
    """Mask of a box as array<struct<y, x, len>>: one run of pixels per row, ends inclusive and inside the frame."""
    x1, x2, y1, y2 = clamp(b["x1"], width - 1), clamp(b["x2"], width - 1), clamp(b["y1"], height - 1), clamp(b["y2"], height - 1)
    return F.transform(F.sequence(y1, F.greatest(y2, y1)), lambda y: F.struct(y.alias("y"), x1.alias("x"), (x2 - x1 + 1).alias("len")))


def runs_area(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda acc, r: acc + r["len"])


def runs_box(runs: Column) -> Column:
    """Inclusive bounding box of a mask, null for an empty one."""
    xs, ends, ys = F.transform(runs, lambda r: r["x"]), F.transform(runs, lambda r: r["x"] + r["len"] - 1), F.transform(runs, lambda r: r["y"])
    return F.when(F.size(runs) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(ends), F.array_max(ys)))


def runs_xywh(runs: Column) -> Column:
    b = runs_box(runs)
    return F.struct(b["x1"].alias("x"), b["y1"].alias("y"), (b["x2"] - b["x1"] + 1).alias("w"), (b["y2"] - b["y1"] + 1).alias("h"))


def relative_difference(a: Column, b: Column) -> Column:
    """Twice the difference over the sum, 0 for two zeros."""
    return F.when(a + b != 0, 2 * F.abs(a - b) / (a + b)).otherwise(0.0)


def union_length(spans: Column) -> Column:
    """Number of whole positions that inclusive spans array<struct<a, b>> cover together."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-(1 << 40)).alias("end"))
    step = lambda acc, s: F.struct(
        (acc["total"] + F.greatest(s["b"] - F.greatest(s["a"], acc["end"] + 1) + 1, F.lit(0))).cast("long").alias("total"), F.greatest(acc["end"], s["b"].cast("long")).alias("end")
    )
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["total"])


def palette_runs(pixels: Column, width: int, most: Column) -> Column:
    """array<struct<id, y, x, len>> of a flat palette image: one run per row and instance id from 1 to ``most``, 0 is background.

    One look at each pixel and its neighbours finds where runs open and close; the n-th opening goes with the n-th closing.
    """
    n = F.size(pixels)
    valid = lambda v: F.when((v > 0) & (v <= most), v)
    at = lambda i: valid(F.get(pixels, i.cast("int")))
    places = F.transform(pixels, lambda v, i: F.struct(valid(v).alias("id"), i.alias("i")))
    cells = F.filter(places, lambda c: c["id"].isNotNull())
    opens = F.filter(cells, lambda c: (c["i"] % width == 0) | ~c["id"].eqNullSafe(at(F.greatest(c["i"] - 1, F.lit(0)))))
    closes = F.filter(cells, lambda c: ((c["i"] + 1) % width == 0) | (c["i"] + 1 == n) | ~c["id"].eqNullSafe(at(c["i"] + 1)))
    runs = F.zip_with(opens, closes, lambda o, c: F.struct(o["id"].alias("id"), F.floor(o["i"] / width).cast("int").alias("y"), (o["i"] % width).alias("x"), (c["i"] - o["i"] + 1).alias("len")))
    return F.array_sort(runs)


def nonempty_boxes(masks: Column) -> Column:
    """Inclusive bounding boxes of a list of run-length masks; empty masks are left out."""
    return F.transform(F.filter(masks, lambda m: F.size(m) > 0), runs_box)


def inside(b: Column, width: Column, height: Column) -> Column:
    """Does the box show in a frame of that size."""
    return (b["x2"] > 0) & (b["y2"] > 0) & (b["x1"] < width) & (b["y1"] < height)
