import random

import numpy as np
import pytest

from chronoscene.operators import tracking
from chronoscene.operators.tracking import Tracker, assign


def overlaps(a, b):
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.prod(np.maximum(high - low + 1, 0), axis=2)
    size = lambda x: np.prod(x[:, 2:] - x[:, :2] + 1, axis=1)
    union = size(a)[:, None] + size(b)[None, :] - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def of_all(frames, threshold):
    """Tracks by comparing every box with every track."""
    known, out = [], []
    for f in frames:
        mine = [-1] * len(f)
        if known and f:
            iou = overlaps(np.array(known, float), np.array(f, float))
            cost = np.where(iou > threshold, -iou, 0.0)
            live = np.flatnonzero(cost.min(axis=1) < 0)
            for i, j in assign(cost[live]):
                if cost[live[i], j] < 0:
                    mine[j] = int(live[i])
        for j, b in enumerate(f):
            if mine[j] < 0:
                mine[j] = len(known)
                known.append(b)
            known[mine[j]] = b
        out.append(mine)
    return out


def some_frames(rng, n, shift=0):
    box = lambda: (x := rng.randrange(-200, 900), y := rng.randrange(-200, 500), x + rng.randrange(-3, 2 ** rng.randrange(2, 10)), y + rng.randrange(-3, 2 ** rng.randrange(2, 9)))
    return [[tuple(v + shift for v in box()) for _ in range(rng.randrange(6))] for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.3, 0.5, 0.8])
def test_cells_hold_every_track_that_can_match(threshold):
    for seed, shift in ((1, 0), (2, 0.5)):
        frames = some_frames(random.Random(seed), 400, shift)
        t = Tracker(threshold)
        assert [t.add(np.array(f, float).reshape(-1, 4)) for f in frames] == of_all(frames, threshold)
        assert t.cells is not None


def test_all_tracks_are_compared_only_where_boxes_want_the_same(monkeypatch):
    calls = []
    monkeypatch.setattr(tracking, "assign", lambda cost: calls.append(cost.shape) or assign(cost))
    t = Tracker(0.5)
    for n in range(60):
        assert t.add(np.array([(100 * i + n, 0, 100 * i + n + 49, 49) for i in range(30)], float)) == list(range(30))
    assert calls == []
    assert t.add(np.array([(60, 0, 109, 49), (62, 0, 111, 49)], float)) == [0, 30] and calls == [(1, 2)]
