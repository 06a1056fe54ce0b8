"""Shapes with several parts and holes: ``struct<type, parts>``, parts of rings of vertices.

A part of points is one ring of one vertex, a part of lines one open ring; a
polygon's part is its closed outer ring and then its holes. All functions are
column expressions. Inside is what the even-odd rule over all rings says, so
holes are outside, and boundaries are inside.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry

RING = "array<struct<x:double,y:double>>"
SHAPE = f"struct<type:string,parts:array<array<{RING}>>>"
TYPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")


def shape(kind: Column, parts: Column) -> Column:
    return F.struct(kind.alias("type"), parts.cast(f"array<array<{RING}>>").alias("parts"))


def from_geometry(g: Column) -> Column:
    """A geometry of one ring as a shape."""
    return F.when(g.isNotNull(), shape(g["type"], F.array(F.array(g["coords"]))))


def polygon(*rings: Column) -> Column:
    """Closed rings of vertices: the outer one, then holes."""
    return shape(F.lit("Polygon"), F.array(F.array(*rings)))


def from_geojson(kind: Column, coordinates: Column) -> Column:
    """A shape from a GeoJSON type and its ``coordinates`` as text; null for other types and what doesn't parse."""

    def read(depth: int) -> Column:
        return F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)

    ring = lambda r: F.transform(r, lambda v: geometry.vertex(v[0], v[1]))
    lone = lambda v: F.array(ring(F.array(v)))
    rings = lambda part: F.transform(part, ring)
    parts = (
        F.when(kind == "Point", F.array(lone(read(1))))
        .when(kind == "MultiPoint", F.transform(read(2), lone))
        .when(kind == "LineString", F.array(F.array(ring(read(2)))))
        .when(kind == "MultiLineString", F.transform(read(3), lambda r: F.array(ring(r))))
        .when(kind == "Polygon", F.array(rings(read(3))))
        .when(kind == "MultiPolygon", F.transform(read(4), rings))
    )
    whole = parts.isNotNull() & F.forall(F.flatten(F.flatten(parts)), lambda v: v["x"].isNotNull() & v["y"].isNotNull())
    return F.when(whole, shape(kind, parts))


def to_geojson(s: Column) -> Column:
    """A GeoJSON geometry as text."""
    pair = lambda v: F.concat(F.lit("["), v["x"].cast("string"), F.lit(","), v["y"].cast("string"), F.lit("]"))
    joined = lambda xs, f: F.concat(F.lit("["), F.array_join(F.transform(xs, f), ","), F.lit("]"))
    ring = lambda r: joined(r, pair)
    part = lambda p: joined(p, ring)
    kind, parts = s["type"], s["parts"]
    body = (
        F.when(kind == "Point", pair(parts[0][0][0]))
        .when(kind == "MultiPoint", joined(parts, lambda p: pair(p[0][0])))
        .when(kind == "LineString", ring(parts[0][0]))
        .when(kind == "MultiLineString", joined(parts, lambda p: ring(p[0])))
        .when(kind == "Polygon", part(parts[0]))
        .otherwise(joined(parts, part))
    )
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), body, F.lit("}"))


def geometry_type(s: Column) -> Column:
    return s["type"]


def is_polygon(s: Column) -> Column:
    return s["type"].isin("Polygon", "MultiPolygon")


def rings(s: Column) -> Column:
    return F.flatten(s["parts"])


def vertices(s: Column) -> Column:
    return F.flatten(rings(s))


def _ring_segments(ring: Column) -> Column:
    return geometry.segments(F.struct(F.lit("LineString").alias("type"), ring.alias("coords")))


def segments(s: Column) -> Column:
    """The edges of all rings, from vertex to vertex."""
    return F.flatten(F.transform(rings(s), _ring_segments))


def _total(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + value(x))


def signed_area(ring: Column) -> Column:
    """Positive for rings that turn left; from the first vertex, which keeps digits far from the origin."""
    o = ring[0]
    cross = lambda e: (e["a"]["x"] - o["x"]) * (e["b"]["y"] - o["y"]) - (e["b"]["x"] - o["x"]) * (e["a"]["y"] - o["y"])
    return _total(_ring_segments(ring), cross) / 2


def area(s: Column) -> Column:
    """Outer rings less holes; 0 for points and lines."""
    part = lambda p: F.abs(signed_area(p[0])) - _total(F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda r: F.abs(signed_area(r)))
    return F.when(is_polygon(s), _total(s["parts"], part)).otherwise(F.when(s.isNotNull(), F.lit(0.0)))


def length(s: Column) -> Column:
    """Of lines their length, of polygons that of all rings."""
    return _total(segments(s), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def bounds(s: Column) -> Column:
    return geometry.bounds(F.struct(s["type"].alias("type"), vertices(s).alias("coords")))


def centroid(s: Column) -> Column:
    """By area, by length, or the mean of points; where these are zero the mean of the vertices."""
    v, e = vertices(s), segments(s)
    size = lambda p: F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"])
    mean = lambda k: _total(v, lambda p: p[k]) / F.size(v)
    origin = v[0]

    def by_area(k: str) -> Column:
        """Rings with signs: the outer ring counts for, the holes against."""

        def moment(ring: Column, weight: Column) -> Column:
            turn = lambda p: (p["a"]["x"] - origin["x"]) * (p["b"]["y"] - origin["y"]) - (p["b"]["x"] - origin["x"]) * (p["a"]["y"] - origin["y"])
            return weight * F.signum(signed_area(ring)) * _total(_ring_segments(ring), lambda p: (p["a"][k] + p["b"][k] - 2 * origin[k]) * turn(p)) / 6

        part = lambda p: moment(p[0], F.lit(1.0)) + _total(F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda r: moment(r, F.lit(-1.0)))
        return origin[k] + _total(s["parts"], part) / F.nullif(area(s), F.lit(0.0))

    def at(k: str) -> Column:
        by_length = _total(e, lambda p: (p["a"][k] + p["b"][k]) / 2 * size(p)) / F.nullif(length(s), F.lit(0.0))
        return F.when(is_polygon(s), F.coalesce(by_area(k), mean(k))).when(s["type"].isin("LineString", "MultiLineString"), F.coalesce(by_length, mean(k))).otherwise(mean(k))

    return F.struct(at("x").alias("x"), at("y").alias("y"))


def covers_point(s: Column, p: Column) -> Column:
    """Whether a polygon shape has the point, holes excepted; its boundary counts."""
    edges = segments(s)

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.coalesce(((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < at), F.lit(False))

    odd = F.aggregate(edges, F.lit(False), lambda seen, e: seen != crossed(e))
    return odd | F.exists(edges, lambda e: geometry.on_segment(p, e))


def _has_point(s: Column, p: Column) -> Column:
    """Whether a shape of any type has the point."""
    on_line = F.exists(segments(s), lambda e: geometry.on_segment(p, e))
    same = F.exists(vertices(s), lambda v: (F.abs(v["x"] - p["x"]) <= geometry.TOLERANCE) & (F.abs(v["y"] - p["y"]) <= geometry.TOLERANCE))
    return F.when(is_polygon(s), covers_point(s, p)).otherwise(on_line | same)


def intersects(s: Column, t: Column) -> Column:
    """Whether two shapes share a point. A part may lie inside the other shape without crossing it, so one vertex of each part is tried."""
    first = lambda x, y: F.exists(x["parts"], lambda part: _has_point(y, part[0][0]))
    edges = F.exists(segments(s), lambda e: F.exists(segments(t), lambda f: geometry.segments_cross(e, f)))
    return edges | first(s, t) | first(t, s)


def within(s: Column, t: Column) -> Column:
    """Whether all vertices of ``s`` lie in ``t``, no edge of ``s`` crosses out of it, and no hole of ``t`` lies in ``s``."""
    inside = F.forall(vertices(s), lambda v: _has_point(t, v))
    middle = lambda e: F.struct(((e["a"]["x"] + e["b"]["x"]) / 2).alias("x"), ((e["a"]["y"] + e["b"]["y"]) / 2).alias("y"))
    strictly = lambda e, f: _sides(e["a"], e["b"], f["a"], f["b"]) & _sides(f["a"], f["b"], e["a"], e["b"])
    out = F.exists(segments(s), lambda e: F.exists(segments(t), lambda f: strictly(e, f)) | ~_has_point(t, middle(e)))
    holes = F.flatten(F.transform(t["parts"], lambda p: F.slice(p, 2, F.greatest(F.size(p), F.lit(1)))))
    eaten = F.exists(holes, lambda r: covers_point(s, r[0]) & F.exists(r, lambda v: ~F.exists(segments(s), lambda e: geometry.on_segment(v, e)) & covers_point(s, v)))
    return inside & ~F.when(is_polygon(t), out).otherwise(F.lit(False)) & ~F.when(is_polygon(t) & is_polygon(s), eaten).otherwise(F.lit(False))


def _sides(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether c and d lie on different sides of the line through a and b."""
    turn = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
    return ((turn(c) > geometry.TOLERANCE) & (turn(d) < -geometry.TOLERANCE)) | ((turn(c) < -geometry.TOLERANCE) & (turn(d) > geometry.TOLERANCE))
