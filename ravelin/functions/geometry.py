"""Geometry as ``struct<type, coords: array<struct<x, y>>>`` and predicates over it.

Points have one vertex, lines two or more; polygons are one closed ring. All
functions are column expressions over arrays of vertices.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "struct<type:string,coords:array<struct<x:double,y:double>>>"
TOLERANCE = 1e-9


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(vertex(x, y)).alias("coords"))


def box(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    ring = F.array(vertex(min_x, min_y), vertex(max_x, min_y), vertex(max_x, max_y), vertex(min_x, max_y), vertex(min_x, min_y))
    return F.struct(F.lit("Polygon").alias("type"), ring.alias("coords"))


def line(vertices: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), vertices.alias("coords"))


def from_wkt_point(text: Column) -> Column:
    """``POINT(x y)`` as a geometry, else null."""
    number = r"\s*([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*"
    pattern = rf"(?i)^\s*POINT\s*\({number}\s{number}\)\s*$"
    x, y = (F.regexp_extract(text, pattern, k) for k in (1, 2))
    return F.when(text.rlike(pattern), point(x.try_cast("double"), y.try_cast("double")))


def segments(g: Column) -> Column:
    """Consecutive pairs of vertices."""
    c = g["coords"]
    n = F.size(c)
    return F.when(n < 2, F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
            lambda i: F.struct(F.element_at(c, i).alias("a"), F.element_at(c, F.least(i + 1, n)).alias("b"))
        )
    )


def bounds(g: Column) -> Column:
    xs, ys = F.transform(g["coords"], lambda v: v["x"]), F.transform(g["coords"], lambda v: v["y"])
    return F.struct(
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")
    )


def _total(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, s: a + value(s))


def _cross(s: Column) -> Column:
    return s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]


def length(g: Column) -> Column:
    return _total(segments(g), lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))


def area(g: Column) -> Column:
    return F.when(g["type"] == "Polygon", F.abs(_total(segments(g), _cross)) / 2).otherwise(F.lit(0.0))


def centroid(g: Column) -> Column:
    """Of a point itself; of a line by length; of a polygon by area; else the mean of the vertices."""
    s = segments(g)
    half = lambda k: (lambda p: (p["a"][k] + p["b"][k]))
    size = lambda p: F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"])
    total, twice = _total(s, size), _total(s, _cross)
    n = F.size(g["coords"])
    mean = lambda k: _total(g["coords"], lambda v: v[k]) / n

    def part(k: str) -> Column:
        by_length = _total(s, lambda p: half(k)(p) / 2 * size(p)) / F.nullif(total, F.lit(0.0))
        by_area = _total(s, lambda p: half(k)(p) * _cross(p)) / F.nullif(3 * twice, F.lit(0.0))
        return F.when(
            g["type"] == "LineString", F.coalesce(by_length, mean(k))
        ).when(g["type"] == "Polygon", F.coalesce(by_area, mean(k))).otherwise(F.element_at(g["coords"], 1)[k])

    return F.struct(part("x").alias("x"), part("y").alias("y"))


def bounds_intersect(a: Column, b: Column) -> Column:
    return (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])


def bounds_within(a: Column, b: Column) -> Column:
    return (a["min_x"] >= b["min_x"]) & (a["max_x"] <= b["max_x"]) & (a["min_y"] >= b["min_y"]) & (a["max_y"] <= b["max_y"])


def _turn(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def on_segment(p: Column, s: Column) -> Column:
    a, b = s["a"], s["b"]
    near = F.abs(_turn(a, b, p)) <= TOLERANCE
    between = lambda k: (p[k] >= F.least(a[k], b[k]) - TOLERANCE) & (p[k] <= F.greatest(a[k], b[k]) + TOLERANCE)
    return near & between("x") & between("y")


def segments_cross(s: Column, t: Column) -> Column:
    o1, o2 = _turn(s["a"], s["b"], t["a"]), _turn(s["a"], s["b"], t["b"])
    o3, o4 = _turn(t["a"], t["b"], s["a"]), _turn(t["a"], t["b"], s["b"])
    apart = ((o1 > TOLERANCE) & (o2 < -TOLERANCE)) | ((o1 < -TOLERANCE) & (o2 > TOLERANCE))
    across = ((o3 > TOLERANCE) & (o4 < -TOLERANCE)) | ((o3 < -TOLERANCE) & (o4 > TOLERANCE))
    return (apart & across) | on_segment(t["a"], s) | on_segment(t["b"], s) | on_segment(s["a"], t) | on_segment(s["b"], t)


def point_in_polygon(p: Column, polygon: Column) -> Column:
    """Even-odd rule; the boundary is inside."""
    edges = segments(polygon)

    def crossed(s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = (a["y"] > p["y"]) != (b["y"] > p["y"])
        at = (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.coalesce(spans & (p["x"] < at), F.lit(False))

    odd = F.aggregate(edges, F.lit(False), lambda seen, s: seen != crossed(s))
    return F.exists(edges, lambda s: on_segment(p, s)) | odd


def intersects(g: Column, h: Column) -> Column:
    """Shared points of two geometries; polygons are tested by edges and first vertices."""
    p, q = F.element_at(g["coords"], 1), F.element_at(h["coords"], 1)
    same = (F.abs(p["x"] - q["x"]) <= TOLERANCE) & (F.abs(p["y"] - q["y"]) <= TOLERANCE)
    edges = F.exists(segments(g), lambda s: F.exists(segments(h), lambda t: segments_cross(s, t)))
    g_point, h_point = g["type"] == "Point", h["type"] == "Point"
    in_h = F.when(h["type"] == "Polygon", point_in_polygon(p, h)).otherwise(F.exists(segments(h), lambda s: on_segment(p, s)))
    in_g = F.when(g["type"] == "Polygon", point_in_polygon(q, g)).otherwise(F.exists(segments(g), lambda s: on_segment(q, s)))
    inside = F.when(
        h["type"] == "Polygon", point_in_polygon(p, h)
    ).otherwise(F.lit(False)) | F.when(g["type"] == "Polygon", point_in_polygon(q, g)).otherwise(F.lit(False))
    return F.when(g_point & h_point, same).when(g_point, in_h).when(h_point, in_g).otherwise(edges | inside)


def within(g: Column, container: Column) -> Column:
    """All vertices inside; the boundary counts."""
    inside = F.forall(g["coords"], lambda v: point_in_polygon(v, container))
    on_line = F.forall(g["coords"], lambda v: F.exists(segments(container), lambda s: on_segment(v, s)))
    p, q = F.element_at(g["coords"], 1), F.element_at(container["coords"], 1)
    same = (F.size(g["coords"]) == 1) & (F.abs(p["x"] - q["x"]) <= TOLERANCE) & (F.abs(p["y"] - q["y"]) <= TOLERANCE)
    return F.when(container["type"] == "Polygon", inside).when(container["type"] == "LineString", on_line).otherwise(same)


def contains(container: Column, g: Column) -> Column:
    return within(g, container)


def transform_vertices(g: Column, change) -> Column:
    """``change`` maps a vertex column to a vertex struct."""
    return F.struct(g["type"].alias("type"), F.transform(g["coords"], change).alias("coords"))


def to_web_mercator(g: Column) -> Column:
    """Degrees to spherical Mercator metres."""
    r = 6378137.0
    return transform_vertices(
        g, lambda v: vertex(F.radians(v["x"]) * r, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(v["y"]) / 2)) * r)
    )


def from_web_mercator(g: Column) -> Column:
    r = 6378137.0
    return transform_vertices(
        g, lambda v: vertex(F.degrees(v["x"] / r), F.degrees(2 * F.atan(F.exp(v["y"] / r)) - F.lit(1.5707963267948966)))
    )


def to_geojson(g: Column) -> Column:
    """A GeoJSON geometry as text."""
    pair = lambda v: F.concat(F.lit("["), v["x"].cast("string"), F.lit(","), v["y"].cast("string"), F.lit("]"))
    flat = F.array_join(F.transform(g["coords"], pair), ",")
    body = F.when(g["type"] == "Point", flat).when(
        g["type"] == "Polygon", F.concat(F.lit("[["), flat, F.lit("]]"))
    ).otherwise(F.concat(F.lit("["), flat, F.lit("]")))
    return F.concat(F.lit('{"type":"'), g["type"], F.lit('","coordinates":'), body, F.lit("}"))
