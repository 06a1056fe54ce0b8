"""Joins of points by places: far and crowded rows, copies of ids, and pairs of crowded places."""

import math
import random

from ravelin.operators import spatial


def test_far_rows_take_no_more_jobs(spark):
    sc = spark.sparkContext
    left = spark.createDataFrame([(k, 1e6 * k, 0.0) for k in range(8)], "a long, x double, y double")
    right = spark.createDataFrame([(k, float(k % 3), float(k % 2)) for k in range(60)], "b long, x double, y double")
    sc.setJobGroup("far", "far")
    got = {(r["left_id"], r["rank"]): r["right_id"] for r in spatial.nearest_join(left, right, "a", "b", 2).collect()}
    n = len(sc.statusTracker().getJobIdsForGroup("far"))
    sc.setJobGroup("tests", "tests")
    for k in range(8):
        want = sorted((math.hypot(1e6 * k - j % 3, j % 2), str(j), j) for j in range(60))[:2]
        assert [got[k, 1], got[k, 2]] == [j for _, _, j in want]
    assert n < 45


def test_nearest_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "_BLOCK_PLACES", 5)
    rng = random.Random(3)
    rows = [(k % 50, float(rng.randrange(12)), float(rng.randrange(12))) for k in range(60)]
    df = spark.createDataFrame(rows, "a long, x double, y double")
    got = {}
    for r in spatial.nearest_join(df, df, "a", "a", 3, exclude_self=True).collect():
        got.setdefault(r["left_id"], []).append((round(r["distance"], 9), r["rank"]))
    for a in range(10, 50):  # ids that are there once
        x, y = next(p[1:] for p in rows if p[0] == a)
        want = sorted(round(math.hypot(x - u, y - v), 9) for b, u, v in rows if b != a)[:3]
        assert sorted(got[a], key=lambda d: d[1]) == [(d, i + 1) for i, d in enumerate(want)]


def test_pairs_and_pressure_of_crowded_places(spark):
    rows = [(k, float(k % 3), 0.0, float(k)) for k in range(30)] + [(99, 50.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "a long, x double, y double, w double")
    pairs = [(r["left_id"], r["right_id"]) for r in spatial.proximity_join(df, df, 1.0, "a", "a").collect()]
    want = sorted((p[0], q[0]) for p in rows for q in rows if abs(p[1] - q[1]) <= 1)
    assert sorted(pairs) == want
    got = {r["a"]: r["pressure"] for r in spatial.neighborhood_pressure(df, "a", "w", 1.0).collect()}
    for a, x, _, _ in rows:
        assert abs(got[a] - sum(w / (1 + abs(x - u)) ** 2 for b, u, _, w in rows if b != a and abs(x - u) <= 1)) < 1e-9


def test_nearest_on_the_sphere_tells_last_digits_apart(spark):
    # In doubles the second is nearer by one unit in the last place; by the JVM's arc tangent both are as far.
    left = spark.createDataFrame([(1, 3.5, -45.5)], "a long, x double, y double")
    right = spark.createDataFrame([(13047, 2.0, -46.0), (13048, 5.0, -46.0)], "b long, x double, y double")
    got = [r["right_id"] for r in spatial.nearest_join(left, right, "a", "b", 2, 200.0, method="haversine").orderBy("rank").collect()]
    assert got == [13048, 13047]
