"""Monitoring queries: customers are features, events are observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import monitoring
from ..session import table


def _features(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.col("c_custkey").alias("feature_id"), F.col("c_mktsegment").alias("category"),
        F.concat(F.lit("R"), "n_regionkey").alias("region"), (F.col("c_custkey") % 97).cast("double").alias("x"),
        F.floor(F.col("c_custkey") / 97).cast("double").alias("y")
    )


def _observations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("observation_id"), F.col("user_id").alias("feature_id"), F.col("ts").alias("observed_at"),
        F.lit("value").alias("metric"), "value",
        F.when(F.col("event_type") == "error", "alert").when(F.col("event_type") == "signup", "offline").otherwise("normal").alias("status")
    )


def _thresholds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("feature_id"), F.when(F.col("c_custkey") % 6 == 0, "other").otherwise("value").alias("metric"),
        F.lit(4.0).alias("low"), (F.col("c_custkey") % 40 + 30).cast("double").alias("high")
    )


def _stated(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.with_status(_features(spark, d), _observations(spark, d), _thresholds(spark, d))


def feature_status(spark: SparkSession, d: str) -> DataFrame:
    return _stated(spark, d).where("value is not null").select("feature_id", "status", "alert_score")


def feature_list(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.list_features(
        _stated(spark, d), category="Building", status="ALERT", bbox=(5, 0, 90, 1)
    ).select("feature_id", "category", "status")


def feature_summary(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.summary(_stated(spark, d))


def operations_rollup(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.operations_summary(_stated(spark, d), _observations(spark, d), "2024-01-05", "2024-01-20")


def recent_rows(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.recent_observations(_observations(spark, d), 7, end="2024-01-20").select(
        "observation_id", "feature_id", F.round("value", 6).alias("value")
    )


def recent_by_feature(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.recent_per_feature(_observations(spark, d), 3).select(
        "feature_id", F.col("rank").cast("long").alias("rank"), "observation_id"
    )


def observation_file(spark: SparkSession, d: str) -> DataFrame:
    chosen = monitoring.list_features(_features(spark, d), region="r2")
    return monitoring.export_observations(
        _observations(spark, d), chosen, _thresholds(spark, d), start="2024-01-10"
    ).select("observation_id", "category", "status", "low", "high")


_F = "f AS (SELECT c_custkey AS feature_id, c_mktsegment AS category, 'R' || n_regionkey AS region, c_custkey % 97 AS x, floor(c_custkey / 97) AS y FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_O = "o AS (SELECT event_id AS observation_id, user_id AS feature_id, ts AS observed_at, value, CASE event_type WHEN 'error' THEN 'alert' WHEN 'signup' THEN 'offline' ELSE 'normal' END AS status FROM events)"
_T = "th AS (SELECT c_custkey AS feature_id, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 4.0::DOUBLE END AS low, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE (c_custkey % 40 + 30)::DOUBLE END AS high FROM customer)"
_S = f"""WITH {_F}, {_O}, {_T}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY observed_at DESC, observation_id DESC) AS k FROM o) WHERE k = 1),
s AS (SELECT f.*, l.value, low, high, CASE WHEN l.value IS NULL THEN coalesce(l.status, 'normal') WHEN l.status = 'offline' THEN 'offline' WHEN l.value < low OR l.value > high THEN 'alert' ELSE 'normal' END AS status FROM f LEFT JOIN l USING (feature_id) LEFT JOIN th USING (feature_id))"""

QUERIES = {
    f.__name__: f
    for f in (feature_status, feature_list, feature_summary, operations_rollup, recent_rows, recent_by_feature, observation_file)
}

SQL = {
    "feature_status": f"{_S} SELECT feature_id, status, CASE WHEN high IS NOT NULL THEN round(value / high, 2) WHEN status = 'alert' THEN 1.0 WHEN status = 'offline' THEN 0.8 ELSE 0.2 END AS alert_score FROM s WHERE value IS NOT NULL",
    "feature_list": f"{_S} SELECT feature_id, category, status FROM s WHERE lower(category) = 'building' AND status = 'alert' AND x BETWEEN 5 AND 90 AND y BETWEEN 0 AND 1",
    "feature_summary": f"{_S} SELECT 'category' AS kind, category AS name, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'region', region, count(*) FROM s GROUP BY 2",
    "operations_rollup": f"{_S}, a AS (SELECT feature_id, count(*) AS n FROM o WHERE status = 'alert' AND observed_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY 1) SELECT region, count(*) AS n_features, count(*) FILTER (status = 'alert') AS n_alert_features, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_alerts, round(count(*) FILTER (status = 'alert') / count(*), 4) AS alert_rate FROM s LEFT JOIN a USING (feature_id) GROUP BY region",
    "recent_rows": f"WITH {_O} SELECT observation_id, feature_id, round(value, 6) AS value FROM o WHERE observed_at <= TIMESTAMP '2024-01-20' ORDER BY observed_at DESC, observation_id DESC LIMIT 7",
    "recent_by_feature": f"WITH {_O} SELECT feature_id, rank, observation_id FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY observed_at DESC, observation_id DESC) AS rank FROM o) WHERE rank <= 3",
    "observation_file": f"WITH {_F}, {_O}, {_T} SELECT observation_id, category, status, coalesce(CAST(low AS VARCHAR), '') AS low, coalesce(CAST(high AS VARCHAR), '') AS high FROM o JOIN f USING (feature_id) LEFT JOIN th USING (feature_id) WHERE region = 'R2' AND observed_at >= TIMESTAMP '2024-01-10'",
}
