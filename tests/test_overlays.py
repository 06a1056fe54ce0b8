"""Shapes with holes and parts, unions, overlaps and buffers, against unit cells, slabs and formulas."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ravelin.functions import geometry, shapes
from ravelin.operators import overlays
from ravelin.sources import files


def ring(*points):
    return [(float(x), float(y)) for x, y in (*points, points[0])]


def box(x, y, w, h):
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def frame(spark, rows, id_type="string"):
    """``rows``: (id, type, parts as lists of rings of pairs)."""
    return spark.createDataFrame(rows, f"id {id_type}, type string, parts array<array<{shapes.RING}>>").select(
        "id", F.when(F.col("type").isNotNull(), F.struct("type", "parts")).alias("shape")
    )


def polygon(key, *rings):
    return (key, "Polygon", [list(rings)])


def slab_area(polygons, least=1):
    """The area that at least so many polygons cover, rings by the even-odd rule: exact over slabs between all vertices and crossings."""
    edges = [(a, b, k) for k, rings in enumerate(polygons) for r in rings for a, b in zip(r, r[1:], strict=False) if a[1] != b[1]]
    ys = {p[1] for a, b, _ in edges for p in (a, b)}
    for i, (a, b, _) in enumerate(edges):
        for c, d, _ in edges[:i]:
            cross = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if abs(cross) > 1e-12:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / cross
                ys.add(a[1] + t * (b[1] - a[1]))
    ys, total = sorted(ys), 0.0
    for low, high in zip(ys, ys[1:], strict=False):
        mid = (low + high) / 2
        met = sorted((a[0] + (mid - a[1]) * (b[0] - a[0]) / (b[1] - a[1]), k) for a, b, k in edges if (a[1] > mid) != (b[1] > mid))
        inside, came = set(), None
        for x, k in met:
            before = len(inside) >= least
            inside ^= {k}
            if (len(inside) >= least) != before:
                total, came = (total + (high - low) * (x - came), None) if before else (total, x)
    return total


def star(rng, x, y, r, n):
    sizes = [r * rng.uniform(0.3, 1) for _ in range(n)]
    return ring(*((x + s * math.cos(2 * math.pi * k / n), y + s * math.sin(2 * math.pi * k / n)) for k, s in enumerate(sizes)))


def by_id(df):
    out = {}
    for r in df.select("id", shapes.area(F.col("shape")).alias("area"), shapes.length(F.col("shape")).alias("length"), F.size(shapes.rings(F.col("shape"))).alias("rings")).collect():
        out.setdefault(r["id"], []).append((r["area"], r["length"], r["rings"]))
    return out


def test_dissolve_equals_slabs(spark):
    rng = random.Random(4)
    groups = {
        "touching": [[box(0, 0, 2, 2)], [box(2, 0, 3, 2)], [box(0, 2, 5, 1)]],
        "copies": [[box(1, 1, 4, 3)]] * 50 + [[box(1, 1, 4, 3)[::-1]]],
        "frame": [[box(0, 0, 9, 1)], [box(0, 8, 9, 1)], [box(0, 0, 1, 9)], [box(8, 0, 1, 9)], [box(3, 3, 2, 2)]],
        "hole": [[box(0, 0, 9, 9), box(2, 2, 5, 5)], [box(3, 3, 1, 1)], [box(5, 1, 1, 3)]],
        "corner": [[box(0, 0, 1, 1)], [box(1, 1, 1, 1)]],
        "apart": [[box(0, 0, 1, 1)], [box(100, 5000, 1, 1)]],
        None: [[star(rng, rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(2, 6), 7)] for _ in range(12)],
        "stars": [[star(rng, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(1, 9), 9)] for _ in range(14)],
    }
    rows = [polygon(g, *rings) for g, many in groups.items() for rings in many]
    rows += [("nothing", None, None), ("touching", "Point", [[[(7.0, 7.0)]]])]
    found = by_id(overlays.dissolve(frame(spark, rows).repartition(5), "id"))
    assert set(found) == set(groups)
    for g, many in groups.items():
        assert sum(a for a, _, _ in found[g]) == pytest.approx(slab_area(many), abs=1e-6), g
    assert found["touching"] == [(15.0, 16.0, 1)] and found["copies"] == [(12.0, 14.0, 1)]
    assert sorted(found["frame"]) == [(4.0, 8.0, 1), (32.0, 64.0, 2)]
    assert sorted(found["corner"]) == [(1.0, 4.0, 1)] * 2 and len(found["apart"]) == 2
    assert sum(r for _, _, r in found["hole"]) == 3


def test_aggregates_and_vertices_of_a_union(spark):
    rows = [polygon("a", box(0, 0, 2, 2)), polygon("a", box(1, 1, 2, 2)), polygon("b", box(0, 0, 1, 1))]
    df = frame(spark, rows).withColumn("v", F.lit(2))
    got = {r["id"]: r for r in overlays.dissolve(df, "id", aggregations={"v": "sum"}).collect()}
    assert got["a"]["v_sum"] == 4 and got["b"]["v_sum"] == 2
    corners = {(p["x"], p["y"]) for p in got["a"]["shape"]["parts"][0][0]}
    assert corners == {(0, 0), (2, 0), (2, 1), (3, 1), (3, 3), (1, 3), (1, 2), (0, 2)}
    assert overlays.dissolve(frame(spark, []), "id").count() == 0


def test_overlaps_of_any_polygons(spark):
    rng = random.Random(9)
    lefts = [polygon(f"l{k}", star(rng, rng.uniform(0, 20), rng.uniform(0, 20), 6, 8)) for k in range(6)]
    rights = [polygon(f"r{k}", box(3 * k, 2 * k, 8, 8), box(3 * k + 2, 2 * k + 2, 3, 3)) for k in range(4)]
    rights += [polygon("far", box(500, 500, 1, 1)), polygon("same", *lefts[0][2][0])]
    got = overlays.intersection(frame(spark, lefts), frame(spark, rights), "id", "id")
    found = {}
    for r in got.select("left_id", "right_id", shapes.area(F.col("shape")).alias("a")).collect():
        found[r[0], r[1]] = found.get(r[:2], 0) + r["a"]
    for a, _, p in lefts:
        for b, _, q in rights:
            assert found.get((a, b), 0.0) == pytest.approx(slab_area([p[0], q[0]], 2), abs=1e-6), (a, b)


def test_buffers_of_points_lines_and_polygons(spark):
    d, res = 2.0, 6
    cap = 2 * res * d * d * math.sin(2 * math.pi / (4 * res))
    rows = [
        ("point", "Point", [[[(5.0, 5.0)]]]),
        ("line", "LineString", [[[(0.0, 0.0), (10.0, 0.0)]]]),
        ("corner", "LineString", [[[(0.0, 0.0), (10.0, 0.0), (10.0, 7.0)]]]),
        ("two points", "MultiPoint", [[[(0.0, 0.0)]], [[(50.0, 0.0)]]]),
        ("back and forth", "LineString", [[[(0.0, 0.0), (6.0, 0.0), (6.0, 0.0), (0.0, 0.0)]]]),
        polygon("box", box(0, 0, 6, 4)),
        polygon("with hole", box(0, 0, 20, 20), box(5, 5, 8, 8)),
        polygon("small hole", box(0, 0, 20, 20), box(5, 5, 3, 3)),
    ]
    found = by_id(overlays.buffer(frame(spark, rows), "id", d, res))
    area = {k: sum(a for a, _, _ in v) for k, v in found.items()}
    assert area["point"] == pytest.approx(cap)
    assert area["line"] == pytest.approx(10 * 2 * d + cap)
    assert area["corner"] == pytest.approx(17 * 2 * d - d * d + 1.25 * cap)
    assert area["two points"] == pytest.approx(2 * cap) and len(found["two points"]) == 2
    assert area["back and forth"] == pytest.approx(6 * 2 * d + cap)
    assert area["box"] == pytest.approx(24 + 20 * d + cap)
    assert area["with hole"] == pytest.approx(400 + 80 * d + cap - (8 - 2 * d) ** 2) and found["with hole"][0][2] == 2
    assert area["small hole"] == pytest.approx(400 + 80 * d + cap) and found["small hole"][0][2] == 1
    with pytest.raises(ValueError):
        overlays.buffer(frame(spark, rows), "id", -1.0)


def test_buffer_join_measures_from_whole_shapes(spark):
    left = [("line", "LineString", [[[(0.0, 0.0), (10.0, 0.0)]]]), polygon("ring", box(20, 0, 20, 20), box(25, 5, 10, 10))]
    points = {f"p{x}_{y}": (x, y) for x in range(-3, 45, 2) for y in range(-3, 24, 3)}
    right = [(k, "Point", [[[(float(x), float(y))]]]) for k, (x, y) in points.items()]
    got = {tuple(r) for r in overlays.buffer_shape_join(frame(spark, left), frame(spark, right), 2.0, "id", "id", resolution=64).collect()}
    line = {k for k, (x, y) in points.items() if math.hypot(max(-x, 0, x - 10), y) < 1.99}
    outside = lambda x, y: math.hypot(max(20 - x, 0, x - 40), max(-y, 0, y - 20))
    in_hole = lambda x, y: min(x - 25, 35 - x, y - 5, 15 - y)
    area = {k for k, (x, y) in points.items() if outside(x, y) < 1.99 and in_hole(x, y) <= 2}
    edge = {k for k, (x, y) in points.items() if 1.99 <= min(math.hypot(max(-x, 0, x - 10), y), outside(x, y)) <= 2.01}
    assert {k for i, k in got if i == "line"} - edge == line - edge
    assert {k for i, k in got if i == "ring"} - edge == area - edge


GEOJSON = {
    "point": {"type": "Point", "coordinates": [1.5, 2.0]},
    "points": {"type": "MultiPoint", "coordinates": [[0.0, 0.0], [1.0, 1.0]]},
    "line": {"type": "LineString", "coordinates": [[0.0, 0.0], [3.0, 4.0]]},
    "lines": {"type": "MultiLineString", "coordinates": [[[0.0, 0.0], [0.0, 2.0]], [[5.0, 5.0], [6.0, 5.0]]]},
    "lake": {"type": "Polygon", "coordinates": [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]], [[2.0, 2.0], [2.0, 6.0], [6.0, 6.0], [6.0, 2.0], [2.0, 2.0]]]},
    "islands": {
        "type": "MultiPolygon",
        "coordinates": [[[[20.0, 0.0], [22.0, 0.0], [22.0, 2.0], [20.0, 2.0], [20.0, 0.0]]], [[[30.0, 0.0], [33.0, 0.0], [33.0, 3.0], [30.0, 3.0], [30.0, 0.0]], [[31.0, 1.0], [32.0, 1.0], [32.0, 2.0], [31.0, 2.0], [31.0, 1.0]]]],
    },
}


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("shapes") / "all.geojson"
    broken = [("null", None), ("odd", {"type": "Polygon", "coordinates": [["x"]]}), ("other", {"type": "GeometryCollection", "geometries": []})]
    found = [{"type": "Feature", "properties": {"site_id": k}, "geometry": g} for k, g in (*GEOJSON.items(), *broken)]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": found}))
    return files.read_shapes(spark, str(path)).cache()


def test_reader_keeps_rings_and_parts(read):
    s = F.col("shape")
    got = {r["site_id"]: r for r in read.select("site_id", shapes.to_geojson(s).alias("json"), shapes.area(s).alias("area"), shapes.length(s).alias("length"), shapes.centroid(s).alias("c"), F.size(shapes.vertices(s)).alias("n")).collect()}
    assert {k: json.loads(got[k]["json"]) for k in GEOJSON} == GEOJSON
    assert all(got[k]["json"] is None for k in ("null", "odd", "other"))
    assert (got["lake"]["area"], got["lake"]["length"], got["islands"]["area"], got["lines"]["length"]) == (84.0, 56.0, 12.0, 3.0)
    assert got["line"]["length"] == 5 and got["line"]["area"] == 0 and got["points"]["n"] == 2
    assert tuple(got["lake"]["c"]) == pytest.approx(((500 - 16 * 4) / 84, (500 - 16 * 4) / 84))
    assert tuple(got["islands"]["c"]) == pytest.approx(((4 * 21 + 9 * 31.5 - 31.5) / 12, (4 * 1 + 9 * 1.5 - 1.5) / 12))


def test_holes_are_outside(spark, read):
    points = [(f"{x} {y}", "Point", [[[(x / 2, y / 2)]]]) for x in range(-2, 70) for y in range(-2, 24)]
    areas = read.where("site_id IN ('lake', 'islands')").select(F.col("site_id").alias("id"), "shape")
    got = {tuple(r) for r in overlays.shape_join(areas, frame(spark, points), "id", "id", "contains").collect()}

    def inside(k, x, y):
        boxes = {"lake": [((0, 10, 0, 10), (2, 6, 2, 6))], "islands": [((20, 22, 0, 2), None), ((30, 33, 0, 3), (31, 32, 1, 2))]}[k]
        return any(a <= x <= b and c <= y <= d and not (h and h[0] < x < h[1] and h[2] < y < h[3]) for (a, b, c, d), h in boxes)

    assert got == {(k, p) for k in ("lake", "islands") for p, _, ((((x, y),),),) in points if inside(k, x, y)}
    assert {tuple(r) for r in overlays.shape_join(areas, frame(spark, points), "id", "id", "intersects").collect()} == got


def test_predicates_of_shapes_with_holes(spark):
    lake = polygon("lake", box(0, 0, 10, 10), box(2, 2, 4, 4))
    others = [
        polygon("in the hole", box(3, 3, 1, 1)), polygon("around the hole", box(1, 1, 7, 7)), polygon("beside it", box(7, 7, 2, 2)), polygon("on its edge", box(6, 2, 2, 4)),
        polygon("over the border", box(8, 8, 4, 4)), ("across the hole", "LineString", [[[(1.0, 3.0), (8.0, 3.0)]]]), ("in two places", "MultiPoint", [[[(4.0, 4.0)]], [[(50.0, 50.0)]]]),
        ("one inside", "MultiPoint", [[[(50.0, 50.0)]], [[(1.0, 1.0)]]]), polygon("whole", box(-1, -1, 20, 20)),
    ]
    a, b = frame(spark, others), frame(spark, [lake])
    found = lambda predicate: {r[0] for r in overlays.shape_join(a, b, "id", "id", predicate).collect()}
    assert found("within") == {"beside it", "on its edge"}
    assert found("intersects") == {"around the hole", "beside it", "on its edge", "over the border", "across the hole", "one inside", "whole"}
    assert found("contains") == {"whole"}
    kept = overlays.shape_join(a, b, "id", "id", "within", how="left").collect()
    assert len(kept) == len(others) and sum(r["right_id"] is not None for r in kept) == 2
    with pytest.raises(ValueError):
        overlays.shape_join(a, b, "id", "id", "near")


def test_one_ring_geometries_become_shapes(spark):
    df = spark.range(1).select(shapes.from_geometry(geometry.box(*(F.lit(float(k)) for k in (0, 0, 3, 2)))).alias("shape"))
    assert df.select(shapes.area(F.col("shape")), shapes.geometry_type(F.col("shape"))).first()[:] == (6.0, "Polygon")


def test_features_round_trip_with_any_id(spark, tmp_path):
    rows = [('a"b', "Polygon", [[box(0, 0, 4, 4), box(1, 1, 1, 1)]]), ("line\nbreak\\", "MultiPoint", [[[(1.0, 2.0)]], [[(3.0, 4.0)]]]), (None, "Point", [[[(5.0, 6.0)]]]), ("none", None, None)]
    df = frame(spark, rows).withColumn("label", F.concat(F.lit('says "'), F.col("id"), F.lit('"')))
    files.write_geojson(df, str(tmp_path / "out"), "id", "shape")
    got = {r["site_id"]: r for r in files.read_shape_lines(spark, str(tmp_path / "out")).collect()}
    want = {r["id"]: r for r in df.collect()}
    assert {k: (r["shape"], r["properties"].get("label")) for k, r in got.items()} == {k: (r["shape"], r["label"]) for k, r in want.items()}
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.txt").write_text('{"type":"Feature","id":"a"b"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_shape_lines(spark, str(tmp_path / "broken")).collect()
