"""Formulas over the shipped tables, calibration of decay, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import equations as eq
from ..operators import statistics
from ..session import table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        "s_suppkey", (k % 7 + 1).cast("double").alias("a"), (k % 5 + 2).cast("double").alias("b"), (k % 11 / 2).cast("double").alias("dist")
    )


def equation_table(spark: SparkSession, d: str) -> DataFrame:
    a, b, x = F.col("a"), F.col("b"), F.col("dist")
    columns = {
        "power": eq.power_decay(x, 2.0, 1.5), "exponential": eq.exponential_decay(x, 0.3), "gaussian": eq.gaussian_decay(x, 2.0), "influence": eq.influence(a, x), "interaction": eq.interaction(a, b, x),
        "gravity": eq.gravity_interaction(a, b, x + 1, 1.0, 0.5, 2.0), "service": eq.logistic_probability(
            {"a": a, "b": b}, {"a": 0.4, "b": -0.7}, 0.1
        ), "corridor": eq.corridor_strength(a, b, x),
        "similarity": eq.area_similarity(a, b, x), "stress": eq.stress_index(a, b), "deficit": eq.service_deficit(b, a), "headloss": eq.headloss_hazen_williams(b * 100, a, b - 3), "failure": eq.aged_failure_rate(b / 100, a),
        "resilience": eq.resilience_index(
            a / 10, b / 10, x / 10, a / 20
        ), "miles": eq.convert_units(a, "km", "mi"), "access": eq.accessibility_score(
            F.array(a, b), F.array(x, x + 1), "exponential", rate=0.5
        ),
        "elo": eq.elo_expected(1500 + a, 1500 - b), "margin": eq.margin_multiplier(a - 1), "ndvi": eq.ndvi(a, b), "evi": eq.evi(a, b, x / 10), "aligned": eq.alignment(a, b, x, a + b, 45.0),
    }
    return _pairs(spark, d).select("s_suppkey", *[(F.round(c, 6) + 0.0).alias(n) for n, c in columns.items()])


def decay_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).withColumn("seen", F.pow(1 + F.col("dist") / 2, F.lit(-1.5)) + F.col("a") / 1000)
    out = statistics.calibrate_decay(rows, "dist", "seen", [1.0, 2.0, 3.0], [1.0, 1.5, 2.0])
    return out.select("scale", "power", F.round("rmse", 6).alias("rmse"))


def parameter_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    model = lambda p: F.col("a") * F.pow(1 + F.col("dist") / p["scale"], F.lit(-p["power"]))
    out = statistics.sensitivity(_pairs(spark, d), {"scale": 2.0, "power": 1.5}, model)
    return out.select("parameter", *[F.round(c, 6).alias(c) for c in ("low", "base", "high")])


def travel_fatigue(spark: SparkSession, d: str) -> DataFrame:
    """Great-circle distances of nations on a grid of degrees, and a logarithmic penalty above 500 km."""
    k = F.col("n_nationkey")
    km = eq.haversine_distance(
        F.lit(0.0), F.lit(0.0), (k % 5 * 2.0).cast("double"), (F.floor(k / 5) * 3.0).cast("double"), eq.TRAVEL_RADIUS_KM
    )
    penalty = eq.travel_penalty(km)
    return table(spark, d, "nation").select("n_nationkey", F.round(km, 4).alias("km"), F.round(penalty, 6).alias("penalty"))


def customer_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of union, intersection and difference of buyers in two years."""
    buyers = lambda y: table(spark, d, "orders").where(F.year("o_orderdate") == y).select("o_custkey")
    a, b = buyers(1996), buyers(1997)
    sized = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return sized(a.union(b).distinct(), "union").unionByName(
        sized(a.intersect(b), "intersect")
    ).unionByName(sized(a.subtract(b), "except")).unionByName(sized(a.union(b), "union_all"))


_P = "p AS (SELECT s_suppkey, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS a, CAST(s_suppkey % 5 + 2 AS DOUBLE) AS b, CAST(s_suppkey % 11 AS DOUBLE) / 2 AS x FROM supplier)"
_E = {
    "power": "pow(1 + x / 2, -1.5)", "exponential": "exp(-0.3 * x)", "gaussian": "exp(-x * x / 8)", "influence": "a * pow(1 + x, -2)", "interaction": "a * b * pow(1 + x, -2)", "gravity": "a * pow(b, 0.5) / pow(x + 1, 2)",
    "service": "1 / (1 + exp(-(0.1 + 0.4 * a - 0.7 * b)))", "corridor": "a * ln(1 + b) * pow(1 + x, -2)", "similarity": "least(a, b) / greatest(a, b) / (1 + x)", "stress": "pow(a / b, 2)", "deficit": "least(1, greatest(0, (b - a) / b))",
    "headloss": "CASE WHEN b - 3 <= 0 THEN 0.0 ELSE 10.67 * b * 100 * pow(a / 130, 1.852) / pow(b - 3, 4.87) END", "failure": "b / 100 * exp(0.03 * a)", "resilience": "(0.3 * (a / 10) + 0.25 * (b / 10) + 0.25 * (x / 10) - 0.2 * (a / 20)) / 1.0", "miles": "a * 1000 / 1609.344",
    "access": "a * exp(-0.5 * x) + b * exp(-0.5 * (x + 1))", "elo": "1 / (1 + pow(10, (0 - b - a) / 400))", "margin": "CASE WHEN a = 1 THEN 1.0 ELSE ln(a) * 2.2 / (0.001 * (a - 1) + 2.2) END", "ndvi": "(a - b) / greatest(a + b, 0.000001)",
    "evi": "2.5 * (a - b) / (a + 6 * b - 7.5 * (x / 10) + 1)", "aligned": "cos(radians((degrees(atan2(x - a, (a + b) - b)) + 360) % 360 - 45))",
}
_M = "SELECT avg(a * pow(1 + x / {s}, -{p})) FROM p"

QUERIES = {f.__name__: f for f in (equation_table, decay_calibration, parameter_sensitivity, travel_fatigue, customer_sets)}

SQL = {
    "equation_table": f"WITH {_P} SELECT s_suppkey, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in _E.items()) + " FROM p",
    "decay_calibration": f"WITH {_P}, g AS (SELECT s, w, sqrt(avg(pow(pow(1 + x / s, -w) - (pow(1 + x / 2, -1.5) + a / 1000), 2))) AS r FROM p, (SELECT unnest([1.0::DOUBLE, 2.0, 3.0]) AS s), (SELECT unnest([1.0::DOUBLE, 1.5, 2.0]) AS w) GROUP BY s, w) SELECT s AS scale, w AS power, round(r, 6) AS rmse FROM g ORDER BY round(r, 9), s, w LIMIT 1",
    "parameter_sensitivity": f"WITH {_P} SELECT 'scale' AS parameter, round(({_M.format(s=1.8, p=1.5)}), 6) AS low, round(({_M.format(s=2.0, p=1.5)}), 6) AS base, round(({_M.format(s=2.2, p=1.5)}), 6) AS high UNION ALL SELECT 'power', round(({_M.format(s=2.0, p=1.35)}), 6), round(({_M.format(s=2.0, p=1.5)}), 6), round(({_M.format(s=2.0, p=1.65)}), 6)",
    "travel_fatigue": """
WITH n AS (SELECT n_nationkey, radians(n_nationkey % 5 * 2.0) AS lon, radians(floor(n_nationkey / 5) * 3.0) AS lat FROM nation), h AS (SELECT n_nationkey, pow(sin(lat / 2), 2) + cos(lat) * pow(sin(lon / 2), 2) AS a FROM n),
k AS (SELECT n_nationkey, 2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) AS km FROM h) SELECT n_nationkey, round(km, 4) AS km, round(CASE WHEN km < 500 THEN 0.0 ELSE least(0.15, 0.15 * ln(km / 500) / ln(8000.0 / 500.0)) END, 6) AS penalty FROM k""",
    "customer_sets": """
WITH a AS (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)
SELECT 'union' AS kind, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'union_all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
}
