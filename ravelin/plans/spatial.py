"""Spatial queries: customers and suppliers are points, nations are boxes on a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import equations, geometry
from ..operators import spatial
from ..session import table


def customer_points(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(
        "c_custkey", "c_acctbal", (F.col("c_custkey") % 97).cast("double").alias("x"),
        F.floor(F.col("c_custkey") / 97).cast("double").alias("y")
    )
    return c.withColumn("geometry", geometry.point(F.col("x"), F.col("y")))


def supplier_points(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(
        "s_suppkey", "s_acctbal", ((F.col("s_suppkey") * 7) % 97 + 0.5).cast("double").alias("x"),
        ((F.col("s_suppkey") * 13) % 16 + 0.5).cast("double").alias("y")
    )
    return s.withColumn("geometry", geometry.point(F.col("x"), F.col("y")))


def nation_boxes(spark: SparkSession, d: str) -> DataFrame:
    x, y = (F.col("n_nationkey") % 5) * 20.0, F.floor(F.col("n_nationkey") / 5) * 4.0
    n = table(spark, d, "nation").select("n_nationkey", x.alias("x0"), y.cast("double").alias("y0"))
    return n.withColumn("geometry", geometry.box(F.col("x0"), F.col("y0"), F.col("x0") + 18, F.col("y0") + 3))


def bounds_filter(spark: SparkSession, d: str) -> DataFrame:
    return spatial.query_bounds(customer_points(spark, d), 10, 2, 40, 9).select("c_custkey", "x", "y")


def radius_filter(spark: SparkSession, d: str) -> DataFrame:
    return spatial.query_radius(customer_points(spark, d), 30, 5, 6.5).select("c_custkey", F.round("distance", 6).alias("distance"))


def proximity_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = spatial.proximity_join(supplier_points(spark, d), customer_points(spark, d), 2.5, "s_suppkey", "c_custkey")
    return found.select(F.col("left_id").alias("s_suppkey"), F.col("right_id").alias("c_custkey"), F.round("distance", 6).alias("distance"))


def nearest_suppliers(spark: SparkSession, d: str) -> DataFrame:
    found = spatial.nearest_join(customer_points(spark, d), supplier_points(spark, d), "c_custkey", "s_suppkey", 2)
    return found.select(
        F.col("left_id").alias("c_custkey"), F.col("right_id").alias("s_suppkey"), F.round("distance", 6).alias("distance"),
        F.col("rank").cast("long").alias("rank")
    )


def nearest_neighbors(spark: SparkSession, d: str) -> DataFrame:
    p = supplier_points(spark, d)
    found = spatial.nearest_join(p, p, "s_suppkey", "s_suppkey", 3, exclude_self=True)
    return found.select(
        F.col("left_id").alias("s_suppkey"), F.col("right_id").alias("neighbor"), F.round("distance", 6).alias("distance"),
        F.col("rank").cast("long").alias("rank")
    )


def assignment_summary(spark: SparkSession, d: str) -> DataFrame:
    found = spatial.summarize_assignments(supplier_points(spark, d), customer_points(spark, d), "s_suppkey", "c_custkey")
    return found.select(
        F.col("origin_id").alias("s_suppkey"), "n_targets", F.round("max_distance", 6).alias("max_distance"),
        F.round("mean_distance", 6).alias("mean_distance")
    )


def box_join(spark: SparkSession, d: str) -> DataFrame:
    found = spatial.spatial_join(customer_points(spark, d), nation_boxes(spark, d), "c_custkey", "n_nationkey", "within", cell=8.0)
    return found.select(F.col("left_id").alias("c_custkey"), F.col("right_id").alias("n_nationkey"))


def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Boxes against the same boxes moved, by intersection of polygons."""
    moved = nation_boxes(spark, d).withColumn(
        "geometry", geometry.transform_vertices(F.col("geometry"), lambda v: geometry.vertex(v["x"] + 11, v["y"] + 2))
    )
    found = spatial.spatial_join(nation_boxes(spark, d), moved, "n_nationkey", "n_nationkey", "intersects", cell=10.0)
    return found.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))


def box_coverage(spark: SparkSession, d: str) -> DataFrame:
    found = spatial.coverage_summary(nation_boxes(spark, d), supplier_points(spark, d), "n_nationkey", "s_suppkey", "contains", 8.0)
    return found.select(F.col("area_id").alias("n_nationkey"), "n_covered")


def supplier_pressure(spark: SparkSession, d: str) -> DataFrame:
    found = spatial.neighborhood_pressure(supplier_points(spark, d), "s_suppkey", "s_acctbal", 8.0, 2.0)
    return found.select("s_suppkey", F.round("pressure", 4).alias("pressure"))


def supplier_interaction(spark: SparkSession, d: str) -> DataFrame:
    p = supplier_points(spark, d).withColumn("mass", F.abs("s_acctbal") / 1000)
    found = spatial.interaction_table(p, "s_suppkey", "mass", "mass", 5.0)
    return found.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.round("interaction", 5).alias("interaction"))


def great_circle(spark: SparkSession, d: str) -> DataFrame:
    p = customer_points(spark, d).withColumn("lon", F.col("x") * 3 - 145).withColumn("lat", F.col("y") % 120 - 60)
    at = equations.haversine_distance(F.lit(-100.0), F.lit(30.0), F.col("lon"), F.col("lat"))
    toward = equations.bearing(F.lit(-100.0), F.lit(30.0), F.col("lon"), F.col("lat"))
    return p.select("c_custkey", F.round(at, 4).alias("km"), F.round(toward, 6).alias("bearing"))


def shape_measures(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("geometry")
    n = nation_boxes(spark, d)
    return n.select(
        "n_nationkey", F.round(geometry.area(g), 6).alias("area"), F.round(geometry.length(g), 6).alias("perimeter"),
        F.round(geometry.centroid(g)["x"], 6).alias("cx"), F.round(geometry.centroid(g)["y"], 6).alias("cy")
    )


def clipped_boxes(spark: SparkSession, d: str) -> DataFrame:
    found = spatial.clip_to_box(nation_boxes(spark, d), 10, 2, 70, 13)
    found = found.select("n_nationkey", F.round(geometry.area(F.col("geometry")), 6).alias("area"))
    return found.where("area > 0")


def _degrees(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.col("x") * 3 - 145, "y": F.col("y") % 120 - 60})


def sphere_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within 400 km; suppliers without any stay."""
    found = spatial.proximity_join(
        _degrees(supplier_points(spark, d)), _degrees(customer_points(spark, d)), 400.0, "s_suppkey", "c_custkey", "left", "haversine"
    )
    return found.select(
        F.col("left_id").alias("s_suppkey"), F.coalesce("right_id", F.lit(-1)).alias("c_custkey"), F.round("distance", 4).alias("km")
    )


def sphere_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The nearest customer of each supplier within 200 km, if there is one."""
    found = spatial.nearest_join(
        _degrees(supplier_points(spark, d)), _degrees(customer_points(spark, d)), "s_suppkey", "c_custkey", 1, 200.0, how="left",
        method="haversine"
    )
    return found.select(
        F.col("left_id").alias("s_suppkey"), F.coalesce("right_id", F.lit(-1)).alias("c_custkey"), F.round("distance", 4).alias("km")
    )


def assignment_balances(spark: SparkSession, d: str) -> DataFrame:
    found = spatial.summarize_assignments(
        supplier_points(spark, d), customer_points(spark, d), "s_suppkey", "c_custkey", 6.0, "inner", aggregations={"c_acctbal": "sum"}
    )
    return found.select(F.col("origin_id").alias("s_suppkey"), "n_targets", F.round("c_acctbal_sum", 2).alias("balance"))


def box_balances(spark: SparkSession, d: str) -> DataFrame:
    found = spatial.coverage_summary(
        nation_boxes(spark, d), customer_points(spark, d), "n_nationkey", "c_custkey", "contains", 8.0, {"c_acctbal": "max"}
    )
    return found.select(F.col("area_id").alias("n_nationkey"), "n_covered", F.col("c_acctbal_max").alias("balance"))


def joined_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nearest suppliers with all columns of both sides."""
    s, c = supplier_points(spark, d).drop("geometry"), customer_points(spark, d).drop("geometry")
    found = spatial.with_rows(spatial.nearest_join(s, c, "s_suppkey", "c_custkey"), s, c, "s_suppkey", "c_custkey")
    return found.select("s_suppkey", "c_custkey", "s_acctbal", "c_acctbal", "x", "x_right", F.round("distance", 6).alias("distance"))


def distance_rows(spark: SparkSession, d: str) -> DataFrame:
    found = spatial.distance_table(supplier_points(spark, d), "s_suppkey", 9.0)
    return found.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.round("distance", 6).alias("distance"))


def area_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Boxes cut to different widths by their keys."""
    n = nation_boxes(spark, d).withColumns({"x": F.col("x0"), "y": F.col("y0")})
    n = n.withColumn("geometry", geometry.box(F.col("x0"), F.col("y0"), F.col("x0") + 1 + F.col("n_nationkey") % 4, F.col("y0") + 2))
    found = spatial.area_similarity_table(n, "n_nationkey", 21.0, 4.0)
    return found.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.round("similarity", 6).alias("similarity"))


def anchor_influences(spark: SparkSession, d: str) -> DataFrame:
    found = spatial.anchor_influence(customer_points(spark, d), "c_custkey", "c_acctbal", 7, 3.0)
    return found.select("c_custkey", F.round("influence", 5).alias("influence"))


def corridor_scores(spark: SparkSession, d: str) -> DataFrame:
    """Customers as lines of different length."""
    at = lambda k: geometry.vertex(F.col("x") + k * (F.col("c_custkey") % 5), F.col("y"))
    lines = customer_points(spark, d).withColumn("geometry", geometry.line(F.array(at(0), at(1))))
    found = spatial.corridor_accessibility(lines, "c_custkey", "c_acctbal", 7, 3.0)
    return found.select("c_custkey", F.round("accessibility", 5).alias("accessibility"))


def directed_interaction(spark: SparkSession, d: str) -> DataFrame:
    p = supplier_points(spark, d).withColumn("mass", F.abs("s_acctbal") / 1000)
    found = spatial.interaction_table(p, "s_suppkey", "mass", "mass", 6.0, preferred_bearing=90.0)
    return found.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.round("alignment", 6).alias("alignment"))


def buffer_hits(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose surroundings of 2.5 meet a box; the polygon's corners at right angles reach exactly as far."""
    found = spatial.buffer_join(supplier_points(spark, d), nation_boxes(spark, d), 2.5, "s_suppkey", "n_nationkey")
    return found.select(F.col("left_id").alias("s_suppkey"), F.col("right_id").alias("n_nationkey"))


def buffer_areas(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.buffer_points(supplier_points(spark, d), 3.0, 4)
    return out.select("s_suppkey", F.round(geometry.area(F.col("geometry")), 6).alias("area"))


def overlay_areas(spark: SparkSession, d: str) -> DataFrame:
    moved = nation_boxes(spark, d).withColumn(
        "geometry", geometry.transform_vertices(F.col("geometry"), lambda v: geometry.vertex(v["x"] + 11, v["y"] + 2))
    )
    found = spatial.overlay_intersections(nation_boxes(spark, d), moved, "n_nationkey", "n_nationkey", 10.0)
    found = found.select(
        F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.round(geometry.area(F.col("geometry")), 6).alias("area")
    )
    return found.where("area > 0")


_C = "(SELECT c_custkey, c_acctbal, CAST(c_custkey % 97 AS DOUBLE) AS x, floor(c_custkey / 97) AS y FROM customer)"
_S = "(SELECT s_suppkey, s_acctbal, CAST((s_suppkey * 7) % 97 + 0.5 AS DOUBLE) AS x, CAST((s_suppkey * 13) % 16 + 0.5 AS DOUBLE) AS y FROM supplier)"
_N = "(SELECT n_nationkey, (n_nationkey % 5) * 20.0 AS x0, floor(n_nationkey / 5) * 4.0 AS y0 FROM nation)"
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_DEG = "(pi() / 180)"
_KM = f"""c AS (SELECT c_custkey, radians(x * 3 - 145) AS lon, radians(y % 120 - 60) AS lat FROM {_C}), v AS (SELECT s_suppkey, radians(x * 3 - 145) AS lon, radians(y % 120 - 60) AS lat FROM {_S}),
h AS (SELECT s_suppkey, c_custkey, pow(sin((c.lat - v.lat) / 2), 2) + cos(v.lat) * cos(c.lat) * pow(sin((c.lon - v.lon) / 2), 2) AS a FROM c, v), k AS (SELECT s_suppkey, c_custkey, 2 * 6371.0088 * atan2(sqrt(a), sqrt(1 - a)) AS km FROM h)"""

QUERIES = {
    f.__name__: f
    for f in (
        bounds_filter, radius_filter, proximity_pairs, nearest_suppliers, nearest_neighbors, assignment_summary, box_join, box_overlaps,
        box_coverage, supplier_pressure, supplier_interaction, great_circle, shape_measures, clipped_boxes, sphere_pairs, sphere_nearest,
        assignment_balances, box_balances, joined_rows, distance_rows, area_similarities, anchor_influences, corridor_scores,
        directed_interaction, buffer_hits, buffer_areas, overlay_areas
    )
}

SQL = {
    "bounds_filter": f"SELECT c_custkey, x, y FROM {_C} WHERE x BETWEEN 10 AND 40 AND y BETWEEN 2 AND 9",
    "radius_filter": f"SELECT c_custkey, round(sqrt((x - 30) * (x - 30) + (y - 5) * (y - 5)), 6) AS distance FROM {_C} WHERE sqrt((x - 30) * (x - 30) + (y - 5) * (y - 5)) <= 6.5",
    "proximity_pairs": f"SELECT s_suppkey, c_custkey, round({_D}, 6) AS distance FROM {_S} a, {_C} b WHERE {_D} <= 2.5",
    "nearest_suppliers": f"SELECT c_custkey, s_suppkey, round(dist, 6) AS distance, k AS rank FROM (SELECT c_custkey, s_suppkey, {_D} AS dist, row_number() OVER (PARTITION BY c_custkey ORDER BY {_D}, CAST(s_suppkey AS VARCHAR)) AS k FROM {_C} a, {_S} b) WHERE k <= 2",
    "nearest_neighbors": f"SELECT s AS s_suppkey, t AS neighbor, round(dist, 6) AS distance, k AS rank FROM (SELECT a.s_suppkey AS s, b.s_suppkey AS t, {_D} AS dist, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY {_D}, CAST(b.s_suppkey AS VARCHAR)) AS k FROM {_S} a, {_S} b WHERE a.s_suppkey <> b.s_suppkey) WHERE k <= 3",
    "assignment_summary": f"""
WITH n AS (SELECT c_custkey, s_suppkey, {_D} AS dist, row_number() OVER (PARTITION BY c_custkey ORDER BY {_D}, CAST(s_suppkey AS VARCHAR)) AS k FROM {_C} a, {_S} b)
SELECT s.s_suppkey, count(n.c_custkey) AS n_targets, round(max(dist), 6) AS max_distance, round(avg(dist), 6) AS mean_distance FROM supplier s LEFT JOIN n ON s.s_suppkey = n.s_suppkey AND k = 1 GROUP BY s.s_suppkey""",
    "box_join": f"SELECT c_custkey, n_nationkey FROM {_C}, {_N} WHERE x BETWEEN x0 AND x0 + 18 AND y BETWEEN y0 AND y0 + 3",
    "box_overlaps": f"SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {_N} a, {_N} b WHERE a.x0 <= b.x0 + 29 AND a.x0 + 18 >= b.x0 + 11 AND a.y0 <= b.y0 + 5 AND a.y0 + 3 >= b.y0 + 2",
    "box_coverage": f"SELECT n_nationkey, count(s_suppkey) AS n_covered FROM {_N} LEFT JOIN {_S} ON x BETWEEN x0 AND x0 + 18 AND y BETWEEN y0 AND y0 + 3 GROUP BY n_nationkey",
    "supplier_pressure": f"SELECT a.s_suppkey, round(coalesce(sum(b.s_acctbal * pow(1 + {_D} / 2.0, -2.0)), 0), 4) AS pressure FROM {_S} a LEFT JOIN {_S} b ON a.s_suppkey <> b.s_suppkey AND {_D} <= 8 GROUP BY a.s_suppkey",
    "supplier_interaction": f"SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(abs(a.s_acctbal) / 1000 * (abs(b.s_acctbal) / 1000) * pow(1 + {_D}, -2.0), 5) AS interaction FROM {_S} a, {_S} b WHERE a.s_suppkey <> b.s_suppkey AND {_D} <= 5",
    "great_circle": f"""
WITH p AS (SELECT c_custkey, (x * 3 - 145) AS lon, y % 120 - 60 AS lat FROM {_C}),
h AS (SELECT *, pow(sin((lat - 30) * {_DEG} / 2), 2) + cos(30 * {_DEG}) * cos(lat * {_DEG}) * pow(sin((lon + 100) * {_DEG} / 2), 2) AS a FROM p)
SELECT c_custkey, round(2 * 6371.0088 * atan2(sqrt(a), sqrt(1 - a)), 4) AS km, round((atan2(lon + 100, lat - 30) / {_DEG} + 360) % 360, 6) AS bearing FROM h""",
    "shape_measures": f"SELECT n_nationkey, 54.0::DOUBLE AS area, 42.0::DOUBLE AS perimeter, CAST(x0 + 9 AS DOUBLE) AS cx, CAST(y0 + 1.5 AS DOUBLE) AS cy FROM {_N}",
    "clipped_boxes": f"SELECT n_nationkey, CAST(area AS DOUBLE) AS area FROM (SELECT n_nationkey, (least(x0 + 18, 70) - greatest(x0, 10)) * (least(y0 + 3, 13) - greatest(y0, 2)) AS area, least(x0 + 18, 70) > greatest(x0, 10) AND least(y0 + 3, 13) > greatest(y0, 2) AS ok FROM {_N}) WHERE ok",
    "sphere_pairs": f"WITH {_KM} SELECT s.s_suppkey, coalesce(k.c_custkey, -1) AS c_custkey, round(km, 4) AS km FROM supplier s LEFT JOIN k ON k.s_suppkey = s.s_suppkey AND km <= 400",
    "sphere_nearest": f"""
WITH {_KM}, r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY km, CAST(c_custkey AS VARCHAR)) AS i FROM k WHERE km <= 200)
SELECT s.s_suppkey, coalesce(r.c_custkey, -1) AS c_custkey, round(km, 4) AS km FROM supplier s LEFT JOIN r ON r.s_suppkey = s.s_suppkey AND i = 1""",
    "assignment_balances": f"""
WITH n AS (SELECT c_custkey, s_suppkey, c_acctbal, {_D} AS dist, row_number() OVER (PARTITION BY c_custkey ORDER BY {_D}, CAST(s_suppkey AS VARCHAR)) AS k FROM {_C} a, {_S} b WHERE {_D} <= 6)
SELECT s_suppkey, count(*) AS n_targets, round(sum(c_acctbal), 2) AS balance FROM n WHERE k = 1 GROUP BY s_suppkey""",
    "box_balances": f"SELECT n_nationkey, count(c_custkey) AS n_covered, max(c_acctbal) AS balance FROM {_N} LEFT JOIN {_C} ON x BETWEEN x0 AND x0 + 18 AND y BETWEEN y0 AND y0 + 3 GROUP BY n_nationkey",
    "joined_rows": f"""
WITH n AS (SELECT a.*, c_custkey, c_acctbal, b.x AS x_right, {_D} AS dist, row_number() OVER (PARTITION BY s_suppkey ORDER BY {_D}, CAST(c_custkey AS VARCHAR)) AS k FROM {_S} a, {_C} b)
SELECT s_suppkey, c_custkey, s_acctbal, c_acctbal, x, x_right, round(dist, 6) AS distance FROM n WHERE k = 1""",
    "distance_rows": f"SELECT a.s_suppkey AS a, b.s_suppkey AS b, round({_D}, 6) AS distance FROM {_S} a, {_S} b WHERE {_D} <= 9",
    "area_similarities": f"""
WITH n AS (SELECT n_nationkey, x0 AS x, y0 AS y, 2.0 * (1 + n_nationkey % 4) AS s FROM {_N})
SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(least(a.s, b.s) / greatest(a.s, b.s) / (1 + {_D} / 4), 6) AS similarity FROM n a, n b WHERE a.n_nationkey <> b.n_nationkey AND {_D} <= 21""",
    "anchor_influences": f"SELECT b.c_custkey, round(b.c_acctbal * pow(1 + {_D} / 3, -2), 5) AS influence FROM {_C} a, {_C} b WHERE a.c_custkey = 7",
    "corridor_scores": f"SELECT b.c_custkey, round(b.c_acctbal * ln(1 + b.c_custkey % 5) * pow(1 + {_D} / 3, -2), 5) + 0.0 AS accessibility FROM {_C} a, {_C} b WHERE a.c_custkey = 7",
    "directed_interaction": f"SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(cos(radians((degrees(atan2(b.x - a.x, b.y - a.y)) + 360) % 360 - 90)), 6) AS alignment FROM {_S} a, {_S} b WHERE a.s_suppkey <> b.s_suppkey AND {_D} <= 6",
    "buffer_areas": "SELECT s_suppkey, round(8 * 9 * sin(pi() / 8), 6) AS area FROM supplier",
    "overlay_areas": f"""
WITH p AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, least(a.x0 + 18, b.x0 + 29) - greatest(a.x0, b.x0 + 11) AS w, least(a.y0 + 3, b.y0 + 5) - greatest(a.y0, b.y0 + 2) AS h FROM {_N} a, {_N} b)
SELECT a, b, round(CAST(w * h AS DOUBLE), 6) AS area FROM p WHERE w > 0 AND h > 0""",
}
