"""Small cases with known answers: nulls, ties, edges of shapes, networks, series, statistics."""

import math

import pytest
from pyspark.sql import functions as F

from ravelin.functions import equations, geometry
from ravelin.operators import network, ratings, series, spatial, statistics, tables
from ravelin.streaming import conformal


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# --- tables


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(
        [(1, "a", 2.0), (2, None, None), (3, "a", 5.0), (4, None, 1.0), (5, "b", None)], "id int, k string, v double"
    )


def test_null_keys_meet(spark, messy):
    right = spark.createDataFrame([(None, 9.0), ("a", 8.0)], "k string, v double")
    got = {(r["id"], r["v_right"]) for r in tables.join(messy, right, "k").collect()}
    assert got == {(1, 8.0), (3, 8.0), (2, 9.0), (4, 9.0)}
    assert tables.join(messy, right, "k", "left").count() == 5
    with pytest.raises(ValueError):
        tables.join(messy, right, "k", "outer")


def test_where_and_select(messy):
    assert {r["id"] for r in tables.where(messy, k=None).collect()} == {2, 4}
    assert {r["id"] for r in tables.where(messy, F.col("v") > 1, k="a").collect()} == {1, 3}
    with pytest.raises(KeyError):
        tables.select_columns(messy, ["id", "none"])


def test_null_order(messy):
    up = [r["id"] for r in tables.sort_values(messy, "v", ties=["id"]).collect()]
    down = [r["id"] for r in tables.sort_values(messy, "v", True, ties=["id"]).collect()]
    assert up == [4, 1, 3, 2, 5] and down == [2, 5, 3, 1, 4]


def test_aggregates_of_nothing_are_null(messy):
    got = {r["k"]: r for r in tables.summarize(messy, "k", {"v": "count", "id": "first"}, order="id").collect()}
    assert got["b"]["v_count"] is None and got["b"]["row_count"] == 1
    assert got[None]["v_count"] == 1 and got[None]["id_first"] == 2
    wide = tables.pivot(messy.na.fill({"k": "z"}), "id", "k", "v", "sum", ["z", "a"])
    assert wide.columns == ["id", "a", "z"] and wide.where("id = 2").first()["z"] is None


# --- functions


def test_equations(spark):
    l = F.lit  # noqa: E741
    assert value(spark, equations.power_decay(l(1.0), 1.0, 2.0)) == pytest.approx(0.25)
    assert value(spark, equations.haversine_distance(l(0.0), l(0.0), l(0.0), l(90.0))) == pytest.approx(6371.0088 * math.pi / 2)
    assert value(spark, equations.stress_index(l(5.0), l(0.0))) == 0.0
    assert value(spark, equations.service_deficit(l(10.0), l(4.0))) == pytest.approx(0.6)
    assert value(spark, equations.area_similarity(l(0.0), l(0.0), l(0.0))) == 1.0
    assert value(spark, equations.bearing(l(0.0), l(0.0), l(-1.0), l(0.0))) == pytest.approx(270.0)
    assert value(spark, equations.logistic_probability({"a": l(-800.0)}, {"a": 1.0})) == pytest.approx(0.0)
    assert value(spark, equations.convert_units(l(2.0), "mi", "m")) == pytest.approx(3218.688)
    assert value(spark, equations.accessibility_score(F.array(l(4.0), l(9.0)), F.array(l(1.0), l(2.0)))) == pytest.approx(2.0)
    assert value(spark, equations.threshold_status(l(9.0), l(None).cast("double"), l(5.0), l("normal"))) == "alert"
    with pytest.raises(ValueError):
        equations.decay(l(1.0), "none")
    with pytest.raises(Exception, match="positive"):
        value(spark, equations.gravity_interaction(l(1.0), l(1.0), l(0.0)))


def shape(kind, *points):
    coords = F.array(*[geometry.vertex(F.lit(float(x)), F.lit(float(y))) for x, y in points])
    return F.struct(F.lit(kind).alias("type"), coords.alias("coords"))


def test_geometry(spark):
    square = shape("Polygon", (0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    cases = [
        (geometry.area(square), 16.0), (
            geometry.length(shape("LineString", (0, 0), (3, 4), (3, 5))), 6.0
        ), (geometry.length(shape("LineString", (1, 1), (1, 1))), 0.0),
        (geometry.within(shape("Point", (4, 2)), square), True), (geometry.within(shape("Point", (5, 2)), square), False), (
            geometry.contains(square, shape("LineString", (1, 1), (2, 3))), True
        ),
        (
            geometry.intersects(square, shape("Polygon", (4, 4), (6, 4), (6, 6), (4, 4))), True
        ), (geometry.intersects(square, shape("Polygon", (1, 1), (2, 1), (2, 2), (1, 1))), True),
        (geometry.intersects(shape("LineString", (-1, 2), (5, 2)), square), True), (
            geometry.intersects(shape("LineString", (-1, 5), (5, 5)), square), False
        ), (geometry.intersects(shape("Point", (1, 1)), shape("LineString", (0, 0), (2, 2))), True),
    ]
    for column, want in cases:
        assert value(spark, column) == want
    c = value(spark, geometry.centroid(square))
    assert (c["x"], c["y"]) == (2.0, 2.0)
    flat = value(spark, geometry.centroid(shape("Polygon", (0, 0), (2, 0), (4, 0), (0, 0))))
    assert flat["y"] == 0.0
    back = value(spark, geometry.from_web_mercator(geometry.to_web_mercator(shape("Point", (10, 50)))))
    assert back["coords"][0]["x"] == pytest.approx(10.0) and back["coords"][0]["y"] == pytest.approx(50.0)
    assert value(spark, geometry.from_wkt_point(F.lit("point( 1 -2.5 )")))["coords"][0]["y"] == -2.5
    assert value(spark, geometry.from_wkt_point(F.lit("LINE (1 2)"))) is None


def test_nearest_ties_and_far_rows(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0)], "id int, x double, y double")
    right = spark.createDataFrame([(10, 1.0, 0.0), (9, -1.0, 0.0), (3, 0.0, 5.0)], "rid int, x double, y double")
    got = [
        (r["left_id"], r["right_id"], r["rank"])
        for r in spatial.nearest_join(left, right, "id", "rid", 2).orderBy("left_id", "rank").collect()
    ]
    assert got == [(1, 10, 1), (1, 9, 2), (2, 10, 1), (2, 3, 2)]  # ids tie as text
    assert spatial.nearest_join(left, right, "id", "rid", 1, max_distance=2.0).count() == 1
    assert spatial.nearest_join(left, right.limit(0), "id", "rid").count() == 0
    assert spatial.summarize_assignments(right, left, "rid", "id").where("n_targets = 0").count() == 2


# --- networks


def test_network(spark):
    edges = spark.createDataFrame(
        [
            ("a", 1, 2, 1.0, 5.0), ("b", 2, 3, 1.0, 5.0), ("c", 1, 3, 5.0, 5.0), ("d", 3, 3, 1.0, 5.0), ("e", 8, 9, 1.0, 0.0),
            ("f", 1, 2, 4.0, 1.0)
        ],
        "edge_id string, from_node int, to_node int, cost double, capacity double"
    )
    assert {(r["node"], r["cost"]) for r in network.service_area(edges, 1, 10.0).collect()} == {(1, 0.0), (2, 1.0), (3, 2.0)}
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "node int")
    od = {(r["origin"], r["destination"]): r["cost"] for r in network.od_costs(edges, nodes(1, 77), nodes(3, 9)).collect()}
    assert od == {(1, 3): 2.0, (1, 9): math.inf}
    t = network.topology(edges).first()
    assert (t["n_nodes"], t["n_components"], t["n_loops"], t["n_repeated"]) == (5, 2, 1, 1)
    loads = {
        r["edge_id"]: (r["load"], r["stress"])
        for r in network.edge_loads(
            edges, spark.createDataFrame([(1, 3, 2.0), (1, 2, 3.0), (1, 9, 4.0)], "origin int, destination int, demand double")
        ).collect()
    }
    assert loads["a"] == (5.0, 1.0) and loads["b"][0] == 2.0 and loads["e"] == (0.0, 0.0)
    cut = {
        r["edge_id"]: (r["lost_nodes"], r["lost_demand"])
        for r in network.single_edge_screen(
            edges, nodes(1), spark.createDataFrame([(2, 7.0), (3, 1.0)], "node int, demand double"), edges
        ).collect()
    }
    assert cut["a"] == (0, 0.0) and cut["c"] == (0, 0.0)
    alone = edges.where("edge_id in ('a', 'b')")
    cut = {
        r["edge_id"]: (r["lost_nodes"], r["lost_demand"])
        for r in network.single_edge_screen(
            alone, nodes(1), spark.createDataFrame([(2, 7.0), (3, 1.0)], "node int, demand double"), alone
        ).collect()
    }
    assert cut == {"a": (2, 8.0), "b": (1, 1.0)}
    with pytest.raises(Exception, match="negative"):
        network.service_area(edges.withColumn("cost", F.lit(-1.0)), 1, 9.0).collect()


# --- series and statistics


def test_short_and_flat_series(spark):
    s = spark.createDataFrame([("flat", i, 3.0) for i in range(1, 9)] + [("short", 1, 1.0)], "key string, position long, value double")
    assert {r["z"] for r in series.detector_scores(s).where("key = 'flat'").collect()} == {0.0}
    assert {r["mad_score"] for r in series.mad_scores(s).where("key = 'flat'").collect()} == {0.0}
    assert series.rolling_mean(s, 3).where("key = 'short'").isEmpty() and series.change_point(s).where("key = 'short'").isEmpty()
    assert {r["acf"] for r in series.autocorrelation(s, 2).collect()} == {0.0}
    step = spark.createDataFrame([("k", i, 0.0 if i <= 5 else 10.0) for i in range(1, 11)], "key string, position long, value double")
    assert series.change_point(step).first()["position"] == 5
    ar = spark.createDataFrame([("k", k, 0.5**k) for k in (1, 2, 3)], "key string, lag long, acf double")
    got = [r["pacf"] for r in series.partial_autocorrelation(ar).orderBy("lag").collect()]
    assert got == pytest.approx([0.5, 0.0, 0.0])


def test_conformal(spark):
    scores = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", 4.0), ("b", None)], "kind string, score double")
    q = {r["kind"]: r["quantile"] for r in statistics.conformal_quantiles(scores, "kind", "score", 0.1).collect()}
    assert q == {"a": 10.0, "b": 4.0}
    assert conformal.window_quantile([float(i) for i in range(1, 11)], 0.1) == 10.0 and conformal.window_quantile([], 0.1) == math.inf
    rows = spark.createDataFrame([("a", 0.0, 3.0), ("none", 0.0, 3.0)], "kind string, p double, y double")
    out = statistics.conformal_intervals(rows, statistics.conformal_quantiles(scores, "kind", "score"), "kind", "p")
    assert {r["upper"] for r in out.collect()} == {10.0, math.inf}


def test_causal(spark):
    rows = spark.createDataFrame(
        [(t, s, 10.0 * s + 3.0 * t) for t, s, n in ((1, 0, 2), (0, 0, 6), (1, 1, 6), (0, 1, 2)) for _ in range(n)], "t int, s int, y double"
    )
    p = statistics.stratum_propensity(rows, "t", "s")
    assert statistics.ipw_effect(p, "t", "y").first()["effect"] == pytest.approx(3.0)
    assert statistics.doubly_robust_effect(p, "t", "y", "s").first()["effect"] == pytest.approx(3.0)
    assert statistics.confusion(rows, "t", "t").first()["f1"] == 1.0
    assert value(spark, statistics.e_value(F.lit(2.0))) == pytest.approx(2 + math.sqrt(2))


def test_ratings(spark):
    matches = spark.createDataFrame(
        [("x", 1, "a", "b", 2, 0), ("x", 2, "b", "a", 1, 1), ("y", 1, "c", "d", 0, 0)],
        "league string, n int, home string, away string, home_score int, away_score int"
    )
    got = {r["team"]: r for r in ratings.elo_ratings(matches, "league", ["n"]).collect()}
    assert got["a"]["rating"] > 1500 > got["b"]["rating"] and got["c"]["rating"] == got["d"]["rating"] == 1500.0
    assert ratings.team_table(matches).where("team = 'a'").first()["wins"] == 1


def test_strata_go_to_the_rows(spark):
    rows = spark.createDataFrame([(k % 2, float(k % 7 + 2 * (k % 2)), k % 3) for k in range(60)], "t int, y double, s int")
    p = statistics.stratum_propensity(rows, "t", "s")
    for df in (p, statistics.doubly_robust_effect(p, "t", "y", "s")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Inner") == plan.count("rightHint=(strategy=broadcast)") > 0
