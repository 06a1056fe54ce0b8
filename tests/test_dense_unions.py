"""Unions of many shapes on one place: edges within them are not split, and quartered cells change nothing."""

import random

import pytest
from pyspark.sql import functions as F
from test_overlays import box, by_id, frame, polygon, slab_area, star

from ravelin.functions import shapes
from ravelin.operators import overlays


def measures(boxes):
    """The area and the outline of boxes' union, by unit cells."""
    cells = {(x + i, y + j) for x, y, w, h in boxes for i in range(w) for j in range(h)}
    return len(cells), sum((x + i, y + j) not in cells for x, y in cells for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))


def test_edges_within_a_union_are_not_split(spark, monkeypatch):
    rng = random.Random(3)
    boxes = {g: [(rng.randrange(60), rng.randrange(60), rng.randrange(15, 30), rng.randrange(15, 30)) for _ in range(n)] for g, n in (("few", 4), ("many", 500), (None, 60))}
    settle, rows = overlays.settle, {}

    def counted(df, name):
        out = settle(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(overlays, "settle", counted)
    found = by_id(overlays.dissolve(frame(spark, [polygon(g, box(*b)) for g, some in boxes.items() for b in some]), "id"))
    assert {g: (sum(a for a, _, _ in v), sum(b for _, b, _ in v)) for g, v in found.items()} == {g: measures(some) for g, some in boxes.items()}
    # Split everywhere, the edges are 10 969 pieces.
    assert rows["pieces"] < 8000


@pytest.mark.parametrize("edges", [1, 4])
def test_quartered_cells_change_nothing(spark, monkeypatch, edges):
    monkeypatch.setattr(overlays, "_EDGES_A_CELL", edges, raising=False)
    monkeypatch.setattr(overlays, "_QUARTERINGS", 3, raising=False)
    rng = random.Random(8)
    groups = {
        "stars": [[star(rng, rng.uniform(0, 12), rng.uniform(0, 12), rng.uniform(2, 6), 7)] for _ in range(14)],
        "frame": [[box(0, 0, 9, 1)], [box(0, 8, 9, 1)], [box(0, 0, 1, 9)], [box(8, 0, 1, 9)], [box(3, 3, 2, 2)]],
        "holes": [[box(0, 0, 9, 9), box(2, 2, 5, 5)]] * 3 + [[box(3, 3, 1, 1)], [box(0, 0, 1, 400)]],
    }
    found = by_id(overlays.dissolve(frame(spark, [polygon(g, *rings) for g, some in groups.items() for rings in some]), "id"))
    for g, some in groups.items():
        assert sum(a for a, _, _ in found[g]) == pytest.approx(slab_area(some), abs=1e-6), g
    lefts, rights = ([polygon(f"{s}{k}", star(rng, rng.uniform(0, 9), rng.uniform(0, 9), 5, 7)) for k in range(3)] for s in "lr")
    got = overlays.intersection(frame(spark, lefts), frame(spark, rights), "id", "id").groupBy("left_id", "right_id").agg(F.sum(shapes.area(F.col("shape"))).alias("a"))
    common = {(r["left_id"], r["right_id"]): r["a"] for r in got.collect()}
    for a, _, p in lefts:
        for b, _, q in rights:
            assert common.get((a, b), 0.0) == pytest.approx(slab_area([p[0], q[0]], 2), abs=1e-6)


def test_edges_of_a_line_are_laid_over_each_other(spark):
    rows = [("g", 0.0, 0.0, 0.0, 5.0, 1), ("g", 0.0, 0.0, 0.0, 3.0, 2), ("g", 0.0, 3.0, 0.0, 8.0, -1), ("g", 0.0, 0.0, 4.0, 0.0, 1), ("g", 4.0, 0.0, 6.0, 0.0, 1), ("g", 0.0, 0.0, 1.0, 1.0, 1), (None, 0.0, 0.0, 0.0, 1.0, 1)]
    got = overlays.laid_over(spark.createDataFrame(rows, "group string, ax double, ay double, bx double, by double, w int"))
    want = {("g", 0.0, 0.0, 0.0, 3.0, 3), ("g", 0.0, 5.0, 0.0, 8.0, -1), ("g", 0.0, 0.0, 6.0, 0.0, 1), ("g", 0.0, 0.0, 1.0, 1.0, 1), (None, 0.0, 0.0, 0.0, 1.0, 1)}
    assert {tuple(r) for r in got.collect()} == want
