"""Areas in common without pieces, and counts of equal shapes tried once."""

import random

import pytest
from test_overlays import box, frame, polygon, ring, slab_area, star

from ravelin.operators import overlays


def test_areas_in_common_equal_slabs(spark):
    rng = random.Random(5)
    left = {f"l{k}": [star(rng, rng.uniform(0, 12), rng.uniform(0, 12), 5, 7)] for k in range(6)} | {"turned": [box(2, 2, 6, 6)[::-1], box(3, 3, 2, 2)]}
    right = {f"r{k}": [star(rng, rng.uniform(0, 12), rng.uniform(0, 12), 4, 6)] for k in range(6)} | {"hole": [box(1, 1, 9, 9), box(3, 3, 4, 4)]}
    frames = [frame(spark, [*(polygon(k, *rings) for k, rings in side.items()), ("none", None, None)]) for side in (left, right)]
    got = {(r["left_id"], r["right_id"]): r["area"] for r in overlays.intersection_areas(*frames, "id", "id").collect()}
    want = {(a, b): slab_area([left[a], right[b]], 2) for a in left for b in right}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 1e-9})


def test_sides_and_corners_have_no_area(spark):
    left = frame(spark, [polygon("a", box(0, 0, 2, 2)), polygon("b", ring((1e6, 1e6), (1e6 + 3, 1e6 + 0.1), (1e6, 1e6 + 1)))])
    right = frame(spark, [polygon("side", box(2, 0, 2, 2)), polygon("corner", box(2, 2, 1, 1)), polygon("all", box(-1, -1, 2e6, 2e6))])
    got = {(r["left_id"], r["right_id"]): r["area"] for r in overlays.intersection_areas(left, right, "id", "id").collect()}
    assert got == pytest.approx({("a", "all"): 4.0, ("b", "all"): 1.5})


def test_crowded_cells_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(overlays, "_PAIRS_A_TASK", 3)
    left = frame(spark, [polygon(str(k), box(k % 5, k % 3, 2, 2)) for k in range(20)])
    right = frame(spark, [polygon(str(k), box(k % 4, 1, 3, 1)) for k in range(9)])
    pairs = [tuple(r) for r in overlays.bounds_join(left, right, "id", "id").collect()]
    meets = lambda a, b: a % 5 <= b % 4 + 3 and a % 5 + 2 >= b % 4 and a % 3 <= 2
    assert sorted(pairs) == sorted((str(a), str(b)) for a in range(20) for b in range(9) if meets(a, b))


def test_counts_of_copies(spark):
    zone = [box(0, 0, 8, 8), box(2, 2, 4, 4)]
    zones = frame(spark, [polygon("a", *zone), polygon("b", *zone), polygon("far", box(90, 90, 1, 1)), ("none", None, None)])
    at = lambda x, y: [[[(float(x), float(y))]]]
    points = frame(spark, [*((f"p{k}", "Point", at(1, 1)) for k in range(7)), ("in", "Point", at(3, 3)), ("edge", "Point", at(8, 8)), ("none", None, None)])
    got = {r["left_id"]: r["n"] for r in overlays.shape_counts(zones, points, "id", "contains").collect()}
    assert got == {"a": 8, "b": 8, "far": 0, "none": 0}


def test_copies_are_tried_once(spark, monkeypatch):
    join, tried = overlays.bounds_join, []
    monkeypatch.setattr(overlays, "bounds_join", lambda a, b, *args, **kept: tried.append((a.count(), b.count())) or join(a, b, *args, **kept))
    boxes = frame(spark, [polygon(str(k), box(k % 2, 0, 2, 2)) for k in range(10)])
    assert {r["n"] for r in overlays.shape_counts(boxes, boxes, "id").collect()} == {10}
    assert tried == [(2, 2)]
