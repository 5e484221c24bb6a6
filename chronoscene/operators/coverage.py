"""Area that boxes of a key cover together.

Boxes are shuffled as compressed blocks of columns, one per block of input and bucket of keys, so on disk a box takes a few
bytes instead of a row; areas are computed for all keys of a bucket at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoscene.operators.rangescan import runs
from chronoscene.storage import partitions_for

#: Columns of a block: key, is the key null, and the box with its sides less one instead of its right and lower end.
LAYOUT = (("key", np.int64), ("none", np.uint8), ("x1", np.int32), ("y1", np.int32), ("w", np.int32), ("h", np.int32))
KINDS = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
WIDTH = sum(np.dtype(t).itemsize for _, t in LAYOUT)


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of LAYOUT compressed, keys as differences, bytes of equal weight together."""
    n = len(columns[0])
    keys = np.diff(columns[0], prepend=np.int64(0))
    planes = [np.ascontiguousarray(c.astype(t, copy=False)).view(np.uint8).reshape(n, -1).T for c, (_, t) in zip([keys, *columns[1:]], LAYOUT, strict=True)]
    return n.to_bytes(4, "little") + pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(block: bytes) -> list[np.ndarray]:
    n, out, at = int.from_bytes(block[:4], "little"), [], 0
    planes = np.frombuffer(pa.decompress(block[4:], decompressed_size=n * WIDTH, codec="zstd"), np.uint8).reshape(WIDTH, n)
    for _, t in LAYOUT:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(planes[at : at + size].T).view(t).reshape(n))
        at += size
    return [np.cumsum(out[0]), *out[1:]]


def bucket_of(key: np.ndarray, band: np.ndarray, buckets: int) -> np.ndarray:
    h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + band.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)


def distinct(columns: list[np.ndarray]) -> list[np.ndarray]:
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return [c[order[new]] for c in columns]


def areas(columns: list[np.ndarray], height: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, is it null, area) of each key and band of ``height`` rows; every box lies in one band.

    All rows of pixels between neighbouring upper or lower edges have the same spans, so one of them is counted for all;
    ``most`` boxes, at least those of one such strip, are looked at together.
    """
    key, none, x1, y1, w, h = columns
    # Sides are stored modulo 2 to the 32nd.
    x1, y1 = x1.astype(np.int64), y1.astype(np.int64)
    end, y2 = x1 + w.view(np.uint32), y1 + h
    band = y1 // height
    order = np.lexsort((x1, band, key, none) if none.any() else (x1, band, key))
    key, none, band, x1, y1, end, y2 = (c[order] for c in (key, none, band, x1, y1, end, y2))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (band[1:] != band[:-1]) | (none[1:] != none[:-1])
    first = np.flatnonzero(new)
    size, group = np.diff(first, append=len(key)), np.cumsum(new) - 1
    area = np.zeros(len(first), np.int64)
    up, down = y1 - band * height, y2 - band * height
    edges = np.sort(np.concatenate([group * (height + 1) + up, group * (height + 1) + down + 1]))
    edges = edges[np.flatnonzero(np.diff(edges, prepend=-1))]
    owner, y = edges // (height + 1), edges % (height + 1)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    owner, y, tall = owner[inner], y[inner], y[inner + 1] - y[inner]
    ends = np.cumsum(size[owner])
    left, begin = x1.min(initial=0), 0
    span = int(end.max(initial=0) - left) + 2
    while begin < len(owner):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        o, n = owner[begin:stop], size[owner[begin:stop]]
        strip = np.repeat(np.arange(len(o)), n)
        box = np.arange(len(strip)) + np.repeat(first[o] - (np.cumsum(n) - n), n)
        line = y[begin:stop][strip]
        on = (up[box] <= line) & (down[box] >= line)
        box, strip = box[on], strip[on]
        a, b = x1[box] - left + strip * span, end[box] - left + 1 + strip * span
        reach = np.maximum.accumulate(b)
        a[1:] = np.maximum(a[1:], reach[:-1])
        # Sums of whole numbers under 2 to the 53rd, as an area in a band is, are exact.
        area[o[0] : o[-1] + 1] += np.bincount(o[strip] - o[0], np.maximum(b - a, 0) * tall[begin:stop][strip], o[-1] - o[0] + 1).astype(np.int64)
        begin = stop
    return key[first], none[first], area


def covered_parts(items: DataFrame, height: int = 128, block: int = 1 << 20) -> DataFrame:
    """``(video_id, n)``: pixels that the boxes of a key cover together in each band of ``height`` rows, a row per key and band.

    A box stands once in each band that it touches, cut to it, so the work for a key is spread and grows with the number of
    its boxes, not with its square. Keys are whole numbers or null, which is a key of its own, sides have 32 bits; reversed
    boxes and those with a null cover nothing. A task gathers ``block`` boxes before it sends them on; what reaches a bucket
    is rid of equal boxes whenever that many have come.
    """
    parts = partitions_for(items.sparkSession)
    buckets = max(512, 4 * parts)
    b, band = F.col("b"), lambda y: F.floor(y / height).cast("int")
    valid = items.select("video_id", "b").where((b["x1"] <= b["x2"]) & (b["y1"] <= b["y2"]))
    split = valid.withColumn("band", F.explode(F.sequence(band(b["y1"]), band(b["y2"]))))
    top = F.col("band").cast("long") * height
    side = lambda c, name: c.cast("int").alias(name)
    cut = split.select("video_id", side(b["x1"], "x1"), side(F.greatest(b["y1"], top), "y1"), side(b["x2"], "x2"), side(F.least(b["y2"], top + height - 1), "y2"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0

        def blocks() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            to = bucket_of(columns[0], columns[3] // height, buckets)
            order = np.argsort(columns[0], kind="stable")
            order = order[np.argsort(to[order], kind="stable")]
            to, columns = to[order], [c[order] for c in columns]
            cuts = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(to)]
            sent = [packed([c[i:j] for c in columns]) for i, j in zip(cuts, cuts[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(to[cuts[:-1]].astype(np.int32)), pa.array(sent, pa.binary())], ["bucket", "block"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("video_id")
            x1, y1, x2, y2 = (batch.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2"))
            held.append([key.fill_null(0).to_numpy().astype(np.int64), key.is_null().to_numpy(zero_copy_only=False).view(np.uint8), x1, y1, x2 - x1, y2 - y1])
            count += len(x1)
            if count >= block:
                yield blocks()
                held, count = [], 0
        if held:
            yield blocks()

    kind = items.schema["video_id"].dataType.simpleString()
    like = KINDS[kind]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, count, limit = None, [], 0, block

        def merged() -> list[np.ndarray]:
            return [np.concatenate(c) for c in zip(*held, strict=True)]

        def result() -> pa.RecordBatch:
            key, none, area = areas(merged(), height)
            return pa.RecordBatch.from_arrays([pa.array(key, mask=none.astype(bool)).cast(like), pa.array(area)], ["video_id", "n"])

        for batch in batches:
            for bucket, part in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if bucket != now and held:
                    yield result()
                    held, count, limit = [], 0, block
                now = bucket
                held.append(unpacked(part))
                count += len(held[-1][0])
                if count > limit:
                    held = [distinct(merged())]
                    count = len(held[0][0])
                    limit = max(block, 2 * count)
        if held:
            yield result()

    sent = cut.mapInArrow(send, "bucket int, block binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(measure, f"video_id {kind}, n long")


def summed(parts: DataFrame, key: str) -> DataFrame:
    """``(key, area)`` of parts ``(key, n)``, of which those of a key, which is no null, are neighbours in one partition; keeps the order."""
    kind = parts.schema[key].dataType.simpleString()
    like = KINDS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            k = np.concatenate([keys, batch.column(key).to_numpy().astype(np.int64)])
            n = np.concatenate([sums, batch.column("n").to_numpy()])
            if len(k):
                at = runs(k)
                k, n = k[at], np.add.reduceat(n, at)
                yield pa.RecordBatch.from_arrays([pa.array(k[:-1]).cast(like), pa.array(n[:-1])], [key, "area"])
                keys, sums = k[-1:], n[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(keys).cast(like), pa.array(sums)], [key, "area"])

    return parts.select(key, "n").mapInArrow(run, f"{key} {kind}, area long")


def covered(items: DataFrame, height: int = 128) -> DataFrame:
    """``(video_id, area)``: pixels that the boxes of a key cover together; reversed boxes and those with a null cover none."""
    return covered_parts(items, height).groupBy("video_id").agg(F.sum("n").alias("area"))
