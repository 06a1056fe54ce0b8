"""Scorecards, profiles, propagated intervals and losses over the shipped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profiles
from ..session import table
from .analytics import _M, _monthly


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Parts as stations, with features from their keys, sizes and prices."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k, (F.col("p_retailprice") / 100).alias("recent_mean"), (k % 31 / 10).alias("variability"), (k % 13 / 20).alias("trend"), (k % 11 / 30).alias("anomaly_rate"),
        (F.col("p_size") % 9).cast("double").alias("maintenance_lag"), (k % 6).cast("double").alias("exceedance_days"), F.when(
            F.col("p_size") + k % 13 > 32, "high"
        ).otherwise("low").alias("label"),
    )


def risk_scores(spark: SparkSession, d: str) -> DataFrame:
    top = F.array_join(F.transform(profiles.top_drivers(2), lambda p: p["feature"]), ",")
    return _samples(spark, d).select(
        "p_partkey", profiles.risk_score().alias("score"), profiles.scorecard_label().alias("scorecard"),
        profiles.rules_label().alias("rules"), top.alias("drivers")
    )


def risk_profile(spark: SparkSession, d: str) -> DataFrame:
    return profiles.training_profile(_samples(spark, d), "label")


def risk_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d).withColumns({"scorecard": profiles.scorecard_label(), "rules": profiles.rules_label()})
    return profiles.classifier_leaderboard(rows, "label", ["scorecard", "rules"])


def monthly_profiles(spark: SparkSession, d: str) -> DataFrame:
    return profiles.feature_profile(_monthly(spark, d), 3, 6)


def price_fits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_quantity") * 1500).alias("guess"))
    return profiles.fit_percent(rows, "l_returnflag", "l_extendedprice", "guess")


def price_gauges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as gauges."""
    out = profiles.gauge_report(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice")
    return out.select(
        F.col("gauge").alias("l_suppkey"), "n", "x_range", "y_range", F.round("r2", 3).alias("r2"), F.round("slope", 4).alias("slope"),
        "category"
    )


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    part = F.when(k % 5 < 2, "train").when(k % 5 < 4, "calibration").otherwise("test")
    return table(spark, d, "customer").select(
        k.alias("node"), (F.col("c_nationkey") % 3).cast("long").alias("type"), part.alias("part"),
        (F.col("c_acctbal") / 1000).alias("label"), (k % 10).cast("double").alias("prediction")
    )


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Every customer is reached from those of half and a third of its key."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("to_node"), F.explode(F.array(F.floor(k / 2), F.floor(k / 3) + 1)).alias("from_node"))


def propagated_widths(spark: SparkSession, d: str) -> DataFrame:
    out = profiles.propagated_intervals(_nodes(spark, d), _links(spark, d), 0.4, 0.2)
    return out.select("node", "type", F.round("lower", 5).alias("lower"), F.round("upper", 5).alias("upper"))


def propagation_weights(spark: SparkSession, d: str) -> DataFrame:
    return profiles.tuned_weights(_nodes(spark, d), _links(spark, d), [0.0, 0.1, 0.3, 1.0], 0.2)


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    return table(spark, d, "lineitem").select(
        (k % 17 / 10).alias("nir"), (k % 7 / 10).alias("red"), (F.col("l_quantity") / 50).alias("blue"),
        (k % 9 - 4).cast("double").alias("logit"), (k % 4 == 0).alias("cloudy"),
        (F.col("l_quantity") + F.col("l_discount") * 100).alias("sigma"),
        (F.col("l_extendedprice") / 1000 - F.col("l_quantity")).alias("error")
    )


def pixel_losses(spark: SparkSession, d: str) -> DataFrame:
    p = _pixels(spark, d)
    one = profiles.physical_loss(p, "nir", "red", "blue").join(F.broadcast(profiles.cloud_loss(p, "logit", "cloudy")))  # single rows
    out = profiles.combined_loss(one.withColumn("l1", F.lit(0.5)), 5)
    return out.select(*[F.round(c, 6).alias(c) for c in ("physical", "cloud", "total")])


def certain_pixels(spark: SparkSession, d: str) -> DataFrame:
    out = profiles.kept_by_uncertainty(_pixels(spark, d), "sigma", "error", [0.1, 0.5, 1.0])
    return out.select("share", F.round("threshold", 6).alias("threshold"), F.round("rmse", 5).alias("rmse"), "n")


def _trade(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("mass"), (F.col("o_custkey") % 9 + 1).cast("double").alias("other"),
        (F.col("o_orderkey") % 23 + 1).cast("double").alias("cost")
    )


def gravity_rows(spark: SparkSession, d: str) -> DataFrame:
    return profiles.gravity_table(
        _trade(spark, d), "mass", "other", "cost", alpha=0.5, gamma=1.5
    ).select("o_orderkey", F.round("gravity", 6).alias("gravity"))


def service_rows(spark: SparkSession, d: str) -> DataFrame:
    return profiles.service_table(
        _trade(spark, d), ["mass", "cost"], {"mass": 0.01, "cost": -0.1}, 0.2
    ).select("o_orderkey", F.round("service", 6).alias("service"))


def customer_access(spark: SparkSession, d: str) -> DataFrame:
    out = profiles.accessibility_table(_trade(spark, d), "o_custkey", "mass", "cost", "exponential", rate=0.2)
    return out.select("o_custkey", F.round("accessibility", 4).alias("accessibility"), "n")


_R = """s AS (SELECT p_partkey, p_retailprice / 100 AS m, p_partkey % 31 / 10 AS v, p_partkey % 13 / 20 AS t, p_partkey % 11 / 30 AS a, CAST(p_size % 9 AS DOUBLE) AS l, CAST(p_partkey % 6 AS DOUBLE) AS e,
  CASE WHEN p_size + p_partkey % 13 > 32 THEN 'high' ELSE 'low' END AS label FROM part),
r AS (SELECT *, round(0.0 + m * 0.12 + v * 0.8 + t * 6.0 + a * 12.0 + l * 0.35 + e * 0.9, 2) AS score, CASE WHEN a >= 0.25 OR (t >= 0.45 AND v >= 2.0) OR (l >= 6 AND e >= 3) THEN 'high' ELSE 'low' END AS rules FROM s),
k AS (SELECT *, CASE WHEN score >= 8.3 THEN 'high' ELSE 'low' END AS scorecard FROM r)"""
_N = """n AS (SELECT c_custkey AS node, CAST(c_nationkey % 3 AS BIGINT) AS type, CASE WHEN c_custkey % 5 < 2 THEN 'train' WHEN c_custkey % 5 < 4 THEN 'calibration' ELSE 'test' END AS part, c_acctbal / 1000 AS y, CAST(c_custkey % 10 AS DOUBLE) AS p FROM customer),
x AS (SELECT node AS t, node // 2 AS f FROM n UNION ALL SELECT node, node // 3 + 1 FROM n), w AS (SELECT t AS node, avg(abs(y - p)) AS w FROM x JOIN n ON n.node = x.f AND n.part = 'train' GROUP BY t), v AS (SELECT n.*, coalesce(w, 0) AS w FROM n LEFT JOIN w USING (node))"""
_Q = "l[CAST(floor(pos) AS BIGINT) + 1] + (l[CAST(ceil(pos) AS BIGINT) + 1] - l[CAST(floor(pos) AS BIGINT) + 1]) * (pos - floor(pos))"
_PX = "p AS (SELECT l_orderkey % 17 / 10 AS nir, l_orderkey % 7 / 10 AS red, l_quantity / 50 AS blue, l_orderkey % 9 - 4 AS z, CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END AS c, l_quantity + l_discount * 100 AS sigma, l_extendedprice / 1000 - l_quantity AS e FROM lineitem)"
_TR = "t AS (SELECT o_orderkey, o_custkey, o_totalprice / 1000 AS m, CAST(o_custkey % 9 + 1 AS DOUBLE) AS o, CAST(o_orderkey % 23 + 1 AS DOUBLE) AS c FROM orders)"

QUERIES = {
    f.__name__: f
    for f in (
        risk_scores, risk_profile, risk_leaderboard, monthly_profiles, price_fits, price_gauges, propagated_widths, propagation_weights,
        pixel_losses, certain_pixels, gravity_rows, service_rows, customer_access
    )
}

SQL = {
    "risk_scores": f"""
WITH {_R}, d AS (SELECT p_partkey, unnest(['recent_mean', 'variability', 'trend', 'anomaly_rate', 'maintenance_lag', 'exceedance_days']) AS f, unnest(range(6)) AS i, unnest([round(m * 0.12, 2), round(v * 0.8, 2), round(t * 6.0, 2), round(a * 12.0, 2), round(l * 0.35, 2), round(e * 0.9, 2)]) AS c FROM k),
o AS (SELECT p_partkey, f, row_number() OVER (PARTITION BY p_partkey ORDER BY c DESC, i) AS j FROM d), g AS (SELECT p_partkey, string_agg(f, ',' ORDER BY j) AS drivers FROM o WHERE j <= 2 GROUP BY p_partkey) SELECT p_partkey, score, scorecard, rules, drivers FROM k JOIN g USING (p_partkey)""",
    "risk_profile": f"WITH {_R} SELECT label, count(*) AS n, round(avg(score), 2) AS mean_risk, round(avg(m), 2) AS mean_recent, round(avg(a), 2) AS mean_anomaly_rate FROM k GROUP BY label",
    "risk_leaderboard": f"""
WITH {_R}, u AS (SELECT 'scorecard' AS model, scorecard = 'high' AS p, label = 'high' AS y FROM k UNION ALL SELECT 'rules', rules = 'high', label = 'high' FROM k),
c AS (SELECT model, count(*) AS n, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn, count(*) FILTER (p = y) AS ok FROM u GROUP BY model),
m AS (SELECT model, round(ok / n, 2) AS accuracy, coalesce(round(tp / nullif(tp + fp, 0), 2), 0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 2), 0) AS recall FROM c), f AS (SELECT *, coalesce(round(2 * precision * recall / nullif(precision + recall, 0), 2), 0) AS f1 FROM m)
SELECT *, row_number() OVER (ORDER BY f1 DESC, accuracy DESC, model) AS rank FROM f""",
    "monthly_profiles": f"""
WITH {_M}, b AS (SELECT *, max(position) OVER (PARTITION BY key) - position AS back, max(position) OVER (PARTITION BY key) AS n FROM m)
SELECT key, round(max(value) FILTER (back = 0), 2) AS latest, round(avg(value), 2) AS mean, round(avg(value) FILTER (back < 3), 2) AS short_mean, round(avg(value) FILTER (back < 6), 2) AS long_mean, round(stddev_samp(value) FILTER (back < 3), 2) AS short_deviation,
round(max(value) FILTER (back = 0) - max(value) FILTER (back = 1), 2) AS recent_change, round((max(value) FILTER (back = 0) - max(value) FILTER (position = 1)) / (any_value(n) - 1), 2) AS slope, round(stddev_samp(value), 2) AS variability FROM b GROUP BY key""",
    "price_fits": "SELECT l_returnflag, round((1 - sum(pow(l_extendedprice - l_quantity * 1500, 2)) / (var_pop(l_extendedprice) * count(*))) * 100, 2) AS fit FROM lineitem GROUP BY 1",
    "price_gauges": """
WITH r AS (SELECT l_suppkey, count(*) AS n, round(max(l_quantity) - min(l_quantity), 3) AS x_range, round(max(l_extendedprice) - min(l_extendedprice), 3) AS y_range, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2, regr_slope(l_extendedprice, l_quantity) AS s FROM lineitem GROUP BY 1)
SELECT l_suppkey, n, x_range, y_range, round(r2, 3) AS r2, round(s, 4) AS slope, CASE WHEN r2 >= 0.8 THEN 'very_strong' WHEN r2 >= 0.6 THEN 'adequate' WHEN r2 >= 0.25 THEN 'weak_to_moderate' ELSE 'poor' END AS category FROM r""",
    "propagated_widths": f"""
WITH {_N}, s AS (SELECT type, list_sort(list(abs(y - p) / (1 + 0.4 * w))) AS l, count(*) AS k FROM v WHERE part = 'calibration' GROUP BY type), a AS (SELECT *, (k - 1) * least(1.0, ceil((k + 1) * (1 - 0.2)) / k) AS pos FROM s), q AS (SELECT type, {_Q} AS q FROM a)
SELECT node, type, round(p - q * (1 + 0.4 * w), 5) AS lower, round(p + q * (1 + 0.4 * w), 5) AS upper FROM v JOIN q USING (type) WHERE part <> 'train'""",
    "gravity_rows": f"WITH {_TR} SELECT o_orderkey, round(1.0 * pow(m, 0.5) * pow(o, 1.0) / pow(c, 1.5), 6) AS gravity FROM t",
    "service_rows": f"WITH {_TR} SELECT o_orderkey, round(1 / (1 + exp(-(0.2 + 0.01 * m - 0.1 * c))), 6) AS service FROM t",
    "customer_access": f"WITH {_TR} SELECT o_custkey, round(sum(m * exp(-0.2 * c)), 4) AS accessibility, count(*) AS n FROM t GROUP BY 1",
    "pixel_losses": f"""
WITH {_PX}, i AS (SELECT *, (nir - red) / greatest(nir + red, 1e-6) AS nd, 2.5 * (nir - red) / greatest(nir + 6 * red - 7.5 * blue + 1, 1e-6) AS ev FROM p),
l AS (SELECT (avg(greatest(-1 - nd, 0) + greatest(nd - 1, 0)) + avg(greatest(-0.2 - ev, 0) + greatest(ev - 1, 0))) / 2 AS physical, avg(greatest(z, 0) - z * c + ln(1 + exp(-abs(z)))) AS cloud FROM i)
SELECT round(physical, 6) AS physical, round(cloud, 6) AS cloud, round(0.5 + 0.5 * 0.05 * physical + 0.5 * 0.01 * cloud, 6) AS total FROM l""",
    "certain_pixels": f"""
WITH {_PX}, o AS (SELECT *, row_number() OVER (ORDER BY sigma) AS k, count(*) OVER () AS n FROM p), h AS (SELECT unnest([0.1::DOUBLE, 0.5, 1.0]) AS share), m AS (SELECT share, sigma AS threshold FROM o, h WHERE k = greatest(1, floor(n * share)))
SELECT share, round(threshold, 6) AS threshold, round(sqrt(avg(e * e)), 5) AS rmse, count(*) AS n FROM m JOIN p ON p.sigma <= threshold GROUP BY share, threshold""",
}
