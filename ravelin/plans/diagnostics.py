"""Diagnostics of intervals, tests, paths and cuts over the shipped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.equations import _ERFC
from ..operators import calibration, network, spatial, statistics
from ..session import table
from .network import _ALL, grid
from .spatial import _D, _S, supplier_points


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    half = 4000 + 300 * F.col("l_quantity") + F.col("l_orderkey") % 997
    return l.select(
        (F.col("l_quantity") * 1500.0 - half).alias("lower"), (F.col("l_quantity") * 1500.0 + half).alias("upper"),
        F.col("l_extendedprice").alias("label"), half.cast("double").alias("half"),
        F.abs(F.col("l_extendedprice") - 1500.0 * F.col("l_quantity")).alias("score"), "l_quantity", "l_discount", "l_tax", "l_orderkey"
    )


def coverage_by_width(spark: SparkSession, d: str) -> DataFrame:
    out = calibration.coverage_by_bin(_intervals(spark, d), "label", "half", 5)
    return out.select("bin", F.round("coverage", 6).alias("coverage"), F.round("mean_by", 4).alias("mean_half"), "n")


def interval_error(spark: SparkSession, d: str) -> DataFrame:
    return calibration.calibration_error(_intervals(spark, d), "label", 0.9, 10).select(F.round("ece", 6).alias("ece"), "n")


def coverage_levels(spark: SparkSession, d: str) -> DataFrame:
    out = calibration.expected_coverage(_intervals(spark, d), "score", F.col("l_orderkey") % 2 == 0, [0.5, 0.8, 0.9])
    return out.select("level", F.round("actual", 6).alias("actual"))


def quantile_loss(spark: SparkSession, d: str) -> DataFrame:
    loss = calibration.pinball_loss(F.col("upper"), F.col("label"), 0.9)
    score = calibration.cqr_scores(F.col("lower"), F.col("upper"), F.col("label"))
    return _intervals(spark, d).agg(F.round(F.avg(loss), 3).alias("pinball"), F.round(F.avg(score), 3).alias("cqr"))


def attribution(spark: SparkSession, d: str) -> DataFrame:
    out = calibration.feature_attribution(_intervals(spark, d), "half", ["l_quantity", "l_discount", "l_tax"], 2)
    return out.select("feature", F.round("correlation", 6).alias("correlation"))


def station_runs(spark: SparkSession, d: str) -> DataFrame:
    out = calibration.runs_test(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return out.select("user_id", "runs", "n_above", "n_below", F.round("z", 6).alias("z"), F.round("p_value", 6).alias("p_value"))


def supplier_autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    """Moran's I of balances over the three nearest suppliers."""
    p = supplier_points(spark, d)
    pairs = spatial.nearest_join(p, p, "s_suppkey", "s_suppkey", 3, exclude_self=True).select("left_id", "right_id")
    out = calibration.morans_i(p.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value")), pairs)
    return out.select(F.round("moran", 6).alias("moran"), F.round("z", 5).alias("z"))


def region_ensemble(spark: SparkSession, d: str) -> DataFrame:
    out = calibration.ensemble(table(spark, d, "customer"), "c_nationkey", "c_acctbal")
    return out.select("c_nationkey", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"))


def error_event_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Event types as cloud masks: stations by hour of day."""
    e = table(spark, d, "events").select(
        (F.col("user_id") % 10).alias("y"), F.hour("ts").alias("x"), (F.col("event_type") == "error").alias("cloudy")
    )
    out = calibration.cloud_frequency(e, ["y", "x"], "cloudy", 0.25)
    return out.select(
        "y", F.col("x").cast("long").alias("x"), F.round("frequency", 6).alias("frequency"), "void",
        F.round("knowability", 6).alias("knowability")
    )


def raster_losses(spark: SparkSession, d: str) -> DataFrame:
    rows = _intervals(spark, d).withColumn("mask", F.col("l_orderkey") % 3 == 0).withColumn("prediction", F.col("l_quantity") * 1500.0)
    out = calibration.masked_losses(rows, "prediction", "label", "half", "mask")
    return out.select(F.round("l1", 3).alias("l1"), F.round("nll", 6).alias("nll"))


def grid_path(spark: SparkSession, d: str) -> DataFrame:
    """Cost and length of a least path; the path itself may tie."""
    out = network.shortest_path(network.both_ways(grid(spark, d)), 0, 24)
    return out.agg(F.round(F.sum("cost"), 6).alias("cost"))


def grid_landmarks(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    # three by three
    pairs = nodes.where("node < 3").select(F.col("node").alias("origin")).join(
        nodes.where("node > 21").select(F.col("node").alias("target")), how="cross"
    )
    return network.landmark_bounds(network.both_ways(grid(spark, d)), nodes.where("node in (2, 22)"), pairs)


def supplier_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Orders that are lost if a supplier fails."""
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("edge_id"), F.col("l_orderkey").alias("circuit"))
    return network.shared_fate(c)


def project_priorities(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    out = network.priority_order(p, F.col("p_size").cast("double"), F.col("p_retailprice"), "p_partkey")
    return out.select("p_partkey", F.round("score", 6).alias("score"))


def learner_effects(spark: SparkSession, d: str) -> DataFrame:
    """Effects from two outcome lines, one for each arm, averaged over all rows."""
    rows = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("t"), "l_quantity", "l_extendedprice")
    out = statistics.two_line_effect(rows, "t", "l_quantity", "l_extendedprice")
    return out.select(F.round("effect", 3).alias("effect"), "n")


_I = "i AS (SELECT l_quantity * 1500.0 - (4000 + 300 * l_quantity + l_orderkey % 997) AS lower, l_quantity * 1500.0 + (4000 + 300 * l_quantity + l_orderkey % 997) AS upper, l_extendedprice AS label, CAST(4000 + 300 * l_quantity + l_orderkey % 997 AS DOUBLE) AS half, abs(l_extendedprice - 1500.0 * l_quantity) AS score, l_quantity, l_discount, l_tax, l_orderkey FROM lineitem)"
_W = lambda n: ", ".join(str(k / n) for k in range(1, n))

QUERIES = {
    f.__name__: f
    for f in (
        coverage_by_width, interval_error, coverage_levels, quantile_loss, attribution, station_runs, supplier_autocorrelation,
        region_ensemble, error_event_frequency, raster_losses, grid_path, grid_landmarks, supplier_cuts, project_priorities, learner_effects
    )
}

SQL = {
    "coverage_by_width": f"WITH {_I}, e AS (SELECT quantile_cont(half, [{_W(5)}]) AS e FROM i) SELECT CAST(len(list_filter(e, lambda x: x <= half)) AS BIGINT) AS bin, round(avg(CASE WHEN label BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(half), 4) AS mean_half, count(*) AS n FROM i, e GROUP BY 1",
    "interval_error": f"WITH {_I}, e AS (SELECT quantile_cont(upper - lower, [{_W(10)}]) AS e FROM i), b AS (SELECT len(list_filter(e, lambda x: x <= upper - lower)) AS bin, avg(CASE WHEN label BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END) AS c, count(*) AS n FROM i, e GROUP BY 1) SELECT round(sum(abs(c - 0.9) * n) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b",
    "coverage_levels": f"WITH {_I}, q AS (SELECT unnest([0.5::DOUBLE, 0.8, 0.9]) AS level, unnest(quantile_cont(score, [0.5, 0.8, 0.9])) AS q FROM i WHERE l_orderkey % 2 = 0) SELECT level, round(avg(CASE WHEN score <= q THEN 1.0 ELSE 0.0 END), 6) AS actual FROM i, q WHERE l_orderkey % 2 <> 0 GROUP BY level",
    "quantile_loss": f"WITH {_I} SELECT round(avg(greatest(0.9 * (label - upper), -0.1 * (label - upper))), 3) AS pinball, round(avg(greatest(lower - label, label - upper)), 3) AS cqr FROM i",
    "attribution": f"WITH {_I}, c AS (SELECT 'l_quantity' AS feature, corr(half, l_quantity) AS c FROM i UNION ALL SELECT 'l_discount', corr(half, l_discount) FROM i UNION ALL SELECT 'l_tax', corr(half, l_tax) FROM i) SELECT feature, round(c, 6) AS correlation FROM c ORDER BY abs(c) DESC, feature LIMIT 2",
    "station_runs": f"""
WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1), u AS (SELECT user_id, ts, event_id, value >= m AS up FROM events JOIN m USING (user_id)),
n AS (SELECT *, CASE WHEN lag(up) OVER (PARTITION BY user_id ORDER BY ts, event_id) = up THEN 0 ELSE 1 END AS new FROM u),
r AS (SELECT user_id, CAST(sum(new) AS BIGINT) AS runs, count(*) FILTER (up) AS a, count(*) FILTER (NOT up) AS b FROM n GROUP BY 1),
s AS (SELECT *, CASE WHEN a + b >= 10 AND a > 0 AND b > 0 THEN (runs - 1 - 2.0 * a * b / (a + b)) / sqrt(greatest(2.0 * a * b * (2.0 * a * b - a - b) / (pow(a + b, 2) * (a + b - 1)), 1e-12)) END AS z FROM r),
t AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.5 * abs(z) / sqrt(2)) AS t FROM s)
SELECT user_id, runs, a AS n_above, b AS n_below, round(z, 6) AS z, round(coalesce(t * exp(-x * x + ({" + ".join(f"({c}) * pow(t, {k})" for k, c in enumerate(_ERFC))})), 1.0), 6) AS p_value FROM t""",
    "supplier_autocorrelation": f"""
WITH p AS (SELECT s, t FROM (SELECT a.s_suppkey AS s, b.s_suppkey AS t, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY {_D}, CAST(b.s_suppkey AS VARCHAR)) AS k FROM {_S} a, {_S} b WHERE a.s_suppkey <> b.s_suppkey) WHERE k <= 3),
m AS (SELECT avg(s_acctbal) AS m, count(*) AS n, var_pop(s_acctbal) AS v FROM supplier), c AS (SELECT s_suppkey AS id, s_acctbal - m AS c FROM supplier, m),
i AS (SELECT sum(x.c * y.c) / count(*) AS s FROM p JOIN c x ON x.id = p.s JOIN c y ON y.id = p.t) SELECT round(s / v, 6) AS moran, round((s / v + 1 / (n - 1)) * sqrt(n - 1), 5) AS z FROM i, m""",
    "region_ensemble": "SELECT c_nationkey, round(avg(c_acctbal), 4) AS mean, round(var_pop(c_acctbal), 2) AS variance FROM customer GROUP BY 1",
    "error_event_frequency": "WITH f AS (SELECT user_id % 10 AS y, hour(ts) AS x, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS f FROM events GROUP BY 1, 2) SELECT y, x, round(f, 6) AS frequency, f > 0.25 AS void, round(1 / (1 + exp(-10.0 * (0.25 - f))), 6) AS knowability FROM f",
    "raster_losses": f"WITH {_I} SELECT round(avg(score), 3) AS l1, round(avg(score * score / (2 * half * half) + ln(half)), 6) AS nll FROM i WHERE l_orderkey % 3 = 0",
    "grid_path": f"{_ALL} SELECT round(cost, 6) AS cost FROM c WHERE s = 0 AND node = 24",
    "grid_landmarks": f"{_ALL} SELECT a.node AS origin, b.node AS target, max(abs(a.cost - b.cost)) AS bound FROM c a JOIN c b ON a.s = b.s WHERE a.s IN (2, 22) AND a.node < 3 AND b.node > 21 GROUP BY 1, 2",
    "supplier_cuts": "SELECT l_suppkey AS edge_id, count(DISTINCT l_orderkey) AS n_lost FROM lineitem GROUP BY 1",
    "project_priorities": "SELECT p_partkey, round(p_size / p_retailprice, 6) AS score FROM part",
    "learner_effects": """
WITH t AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS t, l_quantity AS x, l_extendedprice AS y FROM lineitem),
f AS (SELECT regr_slope(y, x) FILTER (t = 1) AS b1, regr_intercept(y, x) FILTER (t = 1) AS a1, regr_slope(y, x) FILTER (t = 0) AS b0, regr_intercept(y, x) FILTER (t = 0) AS a0, avg(x) AS m, count(*) AS n FROM t)
SELECT round(a1 - a0 + (b1 - b0) * m, 3) AS effect, n FROM f""",
}
