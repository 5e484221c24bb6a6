"""Sequential tracking of boxes by overlap; the one operator here whose state runs along a video."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from chronoscene.storage import partitions_for


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, by shortest augmenting paths; every row or every column is used."""
    if cost.size == 0:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            now = c[i0 - 1, free - 1] - u[i0] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j0
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


class Tracker:
    """Known tracks with their last box; frames must come in order, so the nearest known box is the last one.

    Boxes that overlap by more than ``threshold`` have similar sides and corners, so tracks lie in cells by the powers of two of
    their sides and, in steps of these, by their upper left corner, and a box meets only the few cells that can hold such
    tracks. The assignment is that of all tracks and boxes by ``assign``, which is needed only where two boxes want one track.
    """

    #: Up to so many tracks are compared one by one. A cell's number is that of its column times LINE and that of its row.
    FEW, LINE = 24, 1 << 40

    def __init__(self, threshold: float = 0.5) -> None:
        self.threshold = max(threshold, 0.0)
        self.known: list[tuple] = []
        self.cells: dict[tuple, dict[int, dict[int, tuple]]] | None = None
        self.where: dict[int, tuple] = {}
        self.like: dict[tuple, list] = {}

    def put(self, i: int, old: tuple | None, new: tuple) -> None:
        """Moves track ``i`` to the cell of its new box; boxes without pixels overlap none and are in no cell."""
        if old is not None and (was := self.where.pop(i, None)):
            cell = was[0][was[1]]
            del cell[i]
            if not cell:
                del was[0][was[1]]
        x1, y1, x2, y2, size = new
        if x2 - x1 + 1 <= 0 or y2 - y1 + 1 <= 0:
            return
        kind = int(x2 - x1 + 1).bit_length(), int(y2 - y1 + 1).bit_length()
        if (cells := self.cells.get(kind)) is None:
            cells = self.cells[kind] = {}
            self.like.clear()
        at = int(x1 // (1 << kind[0])) * self.LINE + int(y1 // (1 << kind[1]))
        if at in cells:
            cells[at][i] = i, x1, y1, x2, y2, size
        else:
            cells[at] = {i: (i, x1, y1, x2, y2, size)}
        self.where[i] = cells, at

    def similar(self, kind: tuple) -> list:
        """(power across, power down, reach left, reach up, cells) of the kinds of tracks that boxes of a kind can match."""
        if kind not in self.like:
            t = self.threshold
            fits = lambda a, b: (1 << a) > t * ((1 << b) >> 1) and (1 << b) > t * ((1 << a) >> 1)
            reach = lambda p: int((1 - t) * (1 << p)) + 2
            self.like[kind] = [(w, h, reach(w), reach(h), cells) for (w, h), cells in self.cells.items() if fits(w, kind[0]) and fits(h, kind[1])]
        return self.like[kind]

    def rivals(self, box: tuple) -> list[tuple[float, int]]:
        """(overlap, track) of the tracks that overlap the box by more than the threshold."""
        x1, y1, x2, y2, size = box
        w, h, t = x2 - x1 + 1, y2 - y1 + 1, self.threshold
        if w <= 0 or h <= 0:
            return []
        if self.cells is None:
            groups = [[(i, *b) for i, b in enumerate(self.known)]]
        else:
            # A track that begins before the box by more than a share of its own side, or after it by more than that of the box's, can't match.
            groups, x0, y0, line = [], int(x1), int(y1), self.LINE
            x9, y9 = x0 + int((1 - t) * w) + 2, y0 + int((1 - t) * h) + 2
            for across, down, left, up, cells in self.similar((int(w).bit_length(), int(h).bit_length())):
                xa, xb, ya, yb = x0 - left >> across, (x9 >> across) + 1, y0 - up >> down, (y9 >> down) + 1
                if (xb - xa) * (yb - ya) > 100:
                    groups += [c.values() for c in cells.values()]
                    continue
                for x in range(xa * line, xb * line, line):
                    for at in range(x + ya, x + yb):
                        if at in cells:
                            groups.append(cells[at].values())
        out, least = [], size * t * 0.999
        most = size / t * 1.001 if t else float("inf")
        for group in groups:
            for i, a, b, c, d, n in group:
                if least < n < most:
                    across = (x2 if x2 < c else c) - (x1 if x1 > a else a) + 1
                    if across > 0:
                        down = (y2 if y2 < d else d) - (y1 if y1 > b else b) + 1
                        if down > 0:
                            both = across * down
                            iou = both / (size + n - both)
                            if iou > t:
                                out.append((iou, i))
        return out

    def add(self, boxes: np.ndarray) -> list[int]:
        """Track of each box of the next frame; boxes matched to none open new tracks."""
        return self.follow(boxes.tolist())

    def follow(self, boxes: list) -> list[int]:
        sized = [(x1, y1, x2, y2, (x2 - x1 + 1) * (y2 - y1 + 1)) for x1, y1, x2, y2 in boxes]
        known = self.known
        rivals = [self.rivals(b) for b in sized] if known else [[] for _ in sized]
        out, taken, clear = [], set(), True
        for r in rivals:
            if len(r) > 1:
                r.sort(reverse=True)
                clear = clear and r[0][0] > r[1][0]
            best = r[0][1] if r else -1
            if r:
                clear = clear and best not in taken
                taken.add(best)
            out.append(best)
        if not clear:
            out = self.settled(rivals)
        for j, b in enumerate(sized):
            i = out[j]
            if i < 0:
                i = out[j] = len(known)
                known.append(b)
                old = None
            else:
                old, known[i] = known[i], b
            if self.cells is not None:
                self.put(i, old, b)
        if self.cells is None and len(known) > self.FEW:
            self.cells = {}
            for i, b in enumerate(known):
                self.put(i, None, b)
        return out

    @staticmethod
    def settled(rivals: list[list[tuple[float, int]]]) -> list[int]:
        """Cheapest assignment where boxes want the same track or a box two tracks alike."""
        live = sorted({i for r in rivals for _, i in r})
        place = {i: n for n, i in enumerate(live)}
        cost = np.zeros((len(live), len(rivals)))
        for j, r in enumerate(rivals):
            for iou, i in r:
                cost[place[i], j] = -iou
        out = [-1] * len(rivals)
        for n, j in assign(cost):
            if cost[n, j] < 0:
                out[j] = live[n]
        return out


def restart_frames(frames: DataFrame, key: str, frame: str, share: str, rise: float = 0.01, ordered: bool = False) -> DataFrame:
    """``(key, pass_no, frame)``: where propagation starts, first at the first frame and then, again and again, at the first later
    frame whose uncovered ``share`` exceeds that of the last start by more than ``rise``.

    Each start depends on the one before, so a key is one sequence in one task; its rows stream through in order and only
    the last start is held. Rows with a null are left out; of equal frames the one with the smaller share comes first.
    ``ordered``: the rows of a key stand in one partition already, in that order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    lean = frames.select(key, frame, F.col(share).cast("double").alias("_u")).dropna()
    rows = lean if ordered else lean.repartition(partitions_for(frames.sparkSession), key).sortWithinPartitions(key, frame, "_u")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, base, number = None, 0.0, 0
        for b in batches:
            starts = []
            for k, f, u in zip(b[key], b[frame], b["_u"], strict=True):
                if now is None or k != now:
                    now, base, number = k, u, 0
                elif u > base + rise:
                    base, number = u, number + 1
                else:
                    continue
                starts.append((k, number, f))
            yield pd.DataFrame(starts, columns=[key, "pass_no", frame])

    return rows.mapInPandas(run, f"{key} {kinds[key]}, pass_no int, {frame} {kinds[frame]}")


def track_boxes(frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(video_id, fid, pos, track)`` of frames ``(video_id, fid, gt_bboxes)``; track numbers hold for the whole video.

    Frames sent again count once; null boxes are skipped; rows without video or frame are left out. The track of a box
    depends on all frames before it, so a video is one sequence in one task; videos are spread over tasks. Rows stream
    through in order, and only the last boxes of the open video's tracks are held.
    """
    lean = frames.where("video_id is not null and fid is not null and gt_bboxes is not null")
    lean = lean.repartition("video_id").groupBy("video_id", "fid").agg(F.min("gt_bboxes").alias("b"))
    ordered = lean.sortWithinPartitions("video_id", "fid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tracker = None, Tracker(threshold)
        for batch in batches:
            lists = batch.column("b")
            items, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            sides = items.flatten()  # null where the box or the side is
            whole = np.logical_and.reduce([~s.is_null().to_numpy(zero_copy_only=False) for s in sides]) if len(items) else np.zeros(0, bool)
            row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            pos = np.arange(len(row)) - np.concatenate([[0], ends])[row].astype(np.int64)
            row, pos = row[whole], pos[whole]
            boxes = list(zip(*[s.fill_null(0).to_numpy(zero_copy_only=False)[whole].tolist() for s in sides], strict=True))
            stops, tracks, begin = np.searchsorted(row, np.arange(len(ends)), "right").tolist(), [], 0
            for vid, stop in zip(batch.column("video_id").to_pylist(), stops, strict=True):
                if vid != key:
                    key, tracker = vid, Tracker(threshold)
                if stop > begin:
                    tracks += tracker.follow(boxes[begin:stop])
                    begin = stop
            yield pa.RecordBatch.from_arrays(
                [batch.column("video_id").take(pa.array(row)), batch.column("fid").take(pa.array(row)), pa.array(pos, pa.int32()), pa.array(tracks, pa.int32())], ["video_id", "fid", "pos", "track"]
            )

    return ordered.mapInArrow(run, "video_id string, fid int, pos int, track int")
