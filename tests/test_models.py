"""Models, diagnostics and monitoring on small cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.operators import calibration, models, monitoring, network, statistics


def test_autoregression_finds_the_process(spark):
    values = [1.0, 2.0]
    for _ in range(60):
        values.append(0.6 * values[-1] - 0.5 * values[-2] + 1.0)
    s = spark.createDataFrame(
        [("k", i + 1, v) for i, v in enumerate(values)] + [("short", 1, 1.0)], "key string, position long, value double"
    )
    got = models.autoregression(s, 4, [1, 2]).orderBy("step").collect()
    assert {r["order"] for r in got} == {2} and {r["key"] for r in got} == {"k"} and [r["step"] for r in got] == [1, 2, 3, 4]
    assert got[0]["forecast"] == pytest.approx(0.6 * values[-1] - 0.5 * values[-2] + 1.0, abs=1e-6)
    parts = {
        r["part"]: r["n"] for r in models.split_tail(s.where("key = 'k'"), 5, 3).groupBy("part").agg(F.count("*").alias("n")).collect()
    }
    assert parts == {"test": 3, "validation": 5, "train": 54}


def test_propensity(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    t = rng.random(3000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))
    rows = spark.createDataFrame([(float(a), int(b), 1.0) for a, b in zip(x, t, strict=True)], "x double, t int, flat double")
    got = models.logistic_propensity(rows, "t", ["x", "flat"]).toPandas()
    assert np.abs(got["propensity"] - 1 / (1 + np.exp(-(0.5 + 1.5 * got["x"])))).mean() < 0.03
    assert got["propensity"].between(0.01, 0.99).all()


def test_synthetic_control(spark):
    rows = [
        (u, t, v) for t in range(20) for u,
        v in (("a", t * 1.0), ("b", 10.0 - t * 0.5), ("c", 40.0), ("y", 0.5 * t + 0.5 * (10.0 - t * 0.5) + (3.0 if t >= 12 else 0.0)))
    ]
    got = models.synthetic_control(spark.createDataFrame(rows, "unit string, t int, v double"), "unit", "t", "v", "y", 12).collect()
    assert all(r["gap"] == pytest.approx(3.0 if r["t"] >= 12 else 0.0, abs=0.05) for r in got)


def test_matching(spark):
    rows = spark.createDataFrame(
        [
            (1, 1, 5.0, 0.30, "s"), (2, 0, 3.0, 0.31, "s"), (3, 1, 9.0, 0.32, "s"), (4, 0, 4.0, 0.36, "s"), (5, 0, 0.0, 0.9, "s"),
            (6, 1, 1.0, 0.5, "alone")
        ],
        "id int, t int, y double, p double, s string"
    )
    got = {r["stratum"]: r for r in statistics.matched_effect(rows, "t", "y", "p", "s", 0.05, "id").collect()}
    assert (got["s"]["pairs"], got["s"]["effect"]) == (2, 3.5) and got["alone"]["pairs"] == 0 and got["alone"]["effect"] is None


def test_diagnostics(spark):
    rows = spark.createDataFrame([(float(i), float(i % 10)) for i in range(100)], "v double, e double")
    assert {
        r["bin"]: r["n"] for r in calibration.percentile_bins(rows, "v", 4).groupBy("bin").agg(F.count("*").alias("n")).collect()
    } == {0: 25, 1: 25, 2: 25, 3: 25}
    curve = {
        r["share"]: (r["rmse"], r["n"])
        for r in calibration.coverage_curve(
            rows.withColumn("err", F.when(F.col("v") < 50, 1.0).otherwise(3.0)), "err", "v", [0.5, 1.0]
        ).collect()
    }
    assert curve[0.5] == (1.0, 50) and curve[1.0] == (pytest.approx(math.sqrt(5.0)), 100)
    steady = spark.createDataFrame([("k", i, float(i)) for i in range(20)], "k string, i int, v double")
    r = calibration.runs_test(steady, "k", ["i"], "v").first()
    assert (r["runs"], r["n_above"], r["n_below"]) == (2, 10, 10) and r["z"] < -3
    line = spark.createDataFrame([(i, float(i)) for i in range(50)], "id int, value double")
    pairs = spark.createDataFrame([(i, j) for i in range(50) for j in (i - 1, i + 1) if 0 <= j < 50], "left_id int, right_id int")
    assert calibration.morans_i(line, pairs).first()["moran"] > 0.9


def test_paths_and_rings(spark):
    edges = spark.createDataFrame(
        [("a", 1, 2, 1.0, 1.0, 0.0), ("b", 2, 3, 1.0, 5.0, 1.0), ("c", 3, 1, 5.0, 5.0, 5.0), ("d", 3, 4, 1.0, 5.0, 0.0)],
        "edge_id string, from_node int, to_node int, cost double, capacity double, load double"
    )
    path = [(r["step"], r["edge_id"]) for r in network.shortest_path(edges, 1, 4).orderBy("step").collect()]
    assert path == [(1, "a"), (2, "b"), (3, "d")] and network.shortest_path(edges, 4, 1).count() == 0
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,)], "node int")
    assert {
        r["node"]: r["redundant"] for r in network.ring_redundancy(edges, 1, nodes).collect()
    } == {1: True, 2: True, 3: True, 4: False, 9: False}
    flow = {
        r["node"]: (r["spare"], r["enough"])
        for r in network.fire_flow(edges, spark.createDataFrame([(1, 1.0), (4, 6.0), (9, 0.5)], "node int, demand double")).collect()
    }
    assert flow == {1: (1.0, True), 4: (5.0, False), 9: (0.0, False)}
    # A full edge gets dearer until the demand takes the other way.
    ring = network.both_ways(edges.where("edge_id <> 'd'").drop("load"))
    loads = {
        r["edge_id"]: r["load"]
        for r in network.flow_rounds(
            ring, spark.createDataFrame([(1, 3, 4.0)], "origin int, destination int, demand double"), 4, 2.0
        ).collect()
    }
    assert loads["c"] == 4.0 and loads["a"] == 0.0


def test_monitoring(spark):
    features = spark.createDataFrame(
        [("f", "Air", "West", 1.0, 1.0), ("g", "air", "East", 5.0, 5.0), ("h", "Water", "West", 9.0, 9.0)],
        "feature_id string, category string, region string, x double, y double"
    )
    seen = spark.createDataFrame(
        [
            ("1", "f", "2024-01-01 00:00:00", "m", 9.0, "normal"), ("2", "f", "2024-01-01 00:00:00", "m", 2.0, "normal"),
            ("3", "g", "2024-01-02 00:00:00", "m", 9.0, "Offline")
        ],
        "observation_id string, feature_id string, observed_at string, metric string, value double, status string"
    ).withColumn("observed_at", F.to_timestamp("observed_at"))
    limits = spark.createDataFrame(
        [("f", "m", None, 1.0), ("g", "other", None, 1.0)], "feature_id string, metric string, low double, high double"
    )
    stated = monitoring.with_status(features, seen, limits)
    got = {r["feature_id"]: (r["status"], r["alert_score"]) for r in stated.collect()}
    assert got == {"f": ("alert", 2.0), "g": ("offline", 0.8), "h": ("normal", 0.2)}
    assert monitoring.list_features(stated, category="AIR").count() == 2 and monitoring.list_features(
        stated, category="AIR", exact_case=True
    ).count() == 0
    assert monitoring.list_features(stated, bbox=(0, 0, 5, 5)).count() == 2
    with pytest.raises(ValueError):
        monitoring.list_features(stated, bbox=(5, 0, 0, 5))
    assert [r["observation_id"] for r in monitoring.recent_observations(seen, 2).collect()] == ["3", "2"]
    assert monitoring.in_time(seen, "2024-01-01 00:00:00", "2024-01-01 00:00:00").count() == 2
    changed = monitoring.upsert_thresholds(
        limits, limits.limit(0).unionByName(spark.createDataFrame([("f", "m", 0.0, 7.0)], limits.schema))
    )
    assert {(r["feature_id"], r["high"]) for r in changed.collect()} == {("f", 7.0), ("g", 1.0)}
