"""Areas in common where rows meet: pairs are not shuffled, and parts, blocks and steps change nothing."""

import random

import pytest
from test_overlays import box, frame, polygon, ring, slab_area, star

from ravelin.operators import overlays


def areas(left, right):
    found = overlays.intersection_areas(left, right, "id", "id").collect()
    got = {(r["left_id"], r["right_id"]): r["area"] for r in found}
    assert len(got) == len(found)
    return got


def boxes(rng, name, n, near):
    """Boxes of all sizes on both sides of the origin."""
    return {f"{name}{k}": (rng.uniform(-near, near), rng.uniform(-near, near), 2 ** rng.uniform(-2, 5), 2 ** rng.uniform(-2, 5)) for k in range(n)}


def in_common(a, b):
    x, y = (min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k]) for k in (0, 1))
    return x * y if x > 0 and y > 0 else 0.0


def of_boxes(left, right):
    found = {(a, b): in_common(p, q) for a, p in left.items() for b, q in right.items()}
    return {k: v for k, v in found.items() if v > 0}


def test_pairs_are_not_shuffled(spark):
    left, right = (frame(spark, [polygon(str(k), box(k, 0, 3, 3)) for k in range(9)]) for _ in "lr")
    found = overlays.intersection_areas(left, right, "id", "id")
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 9 + 2 * (8 + 7)


@pytest.mark.parametrize("most", [2, 400, 8_000_000])
def test_parts_and_blocks_change_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(overlays, "_PAIRS_A_BLOCK", most)
    rng = random.Random(most)
    left, right = boxes(rng, "l", 40, 30), boxes(rng, "r", 30, 30)
    frames = [frame(spark, [polygon(k, box(*b)) for k, b in side.items()]) for side in (left, right)]
    assert areas(*frames) == pytest.approx(of_boxes(left, right), rel=1e-9)


def test_more_pairs_than_a_batch(spark):
    rng = random.Random(2)
    left, right = ({f"{s}{k}": (rng.uniform(0.1, 4), rng.uniform(0.1, 4), rng.uniform(5, 8), rng.uniform(5, 8)) for k in range(400)} for s in "lr")
    frames = [frame(spark, [polygon(k, box(*b)) for k, b in side.items()]) for side in (left, right)]
    want = of_boxes(left, right)
    assert len(want) > 2 * overlays._BATCH and areas(*frames) == pytest.approx(want, rel=1e-9)


def test_polygons_of_many_edges(spark):
    rng = random.Random(4)
    left = {f"l{k}": [star(rng, rng.uniform(0, 9), rng.uniform(0, 9), 6, 3 * overlays._FEW_EDGES)] for k in range(3)} | {"box": [box(2, 2, 5, 5)]}
    right = {f"r{k}": [star(rng, rng.uniform(0, 9), rng.uniform(0, 9), 6, 5)] for k in range(3)} | {"hole": [box(0, 0, 9, 9), star(rng, 4, 4, 3, 40)]}
    frames = [frame(spark, [polygon(k, *rings) for k, rings in side.items()]) for side in (left, right)]
    want = {(a, b): slab_area([left[a], right[b]], 2) for a in left for b in right}
    assert areas(*frames) == pytest.approx({k: v for k, v in want.items() if v > 1e-9})


def test_rows_of_an_id_are_added_up(spark):
    left = frame(spark, [polygon("a", box(0, 0, 2, 2)), polygon("a", box(4, 0, 2, 2)), polygon("a", box(0, 0, 2, 2)), polygon("b", box(1, 1, 1, 1)), polygon(None, box(0, 0, 1, 1)), polygon(None, box(5, 0, 9, 1))])
    right = frame(spark, [polygon("all", box(-1, -1, 9, 9)), polygon("two", box(0, 0, 1, 1)), polygon("two", box(1, 1, 1, 1)), polygon("point", ring((3, 3), (3, 3), (3, 3)))])
    assert areas(left, right) == {("a", "all"): 12.0, ("b", "all"): 1.0, (None, "all"): 4.0, ("a", "two"): 4.0, ("b", "two"): 1.0, (None, "two"): 1.0}


def test_what_is_no_number_has_no_area(spark):
    odd = polygon("odd", ring((0, 0), (float("nan"), 0), (1, 1)))
    left = frame(spark, [polygon("a", box(0, 0, 2, 2)), odd, ("line", "LineString", [[[(0.0, 0.0), (9.0, 9.0)]]]), ("none", None, None)])
    assert areas(left, frame(spark, [polygon("b", box(1, 1, 2, 2)), ("none", "Polygon", [])])) == {("a", "b"): 1.0}
