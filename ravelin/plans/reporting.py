"""Observation reporting over ``events``: windows, breakdowns, anomalies, contracts.

A station is a user, its region the user's number modulo five, an ``error`` is
an alert, and the score and reading are the event's value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.equations import alert_score, threshold_status
from ..operators import tables
from ..session import table

RECENT = ("2024-01-20", "2024-01-30")
PREVIOUS = ("2024-01-10", "2024-01-20")


def observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("region", F.col("user_id") % 5)


def in_window(window: tuple[str, str]):
    """Half open: after the start, up to the end."""
    start, end = window
    return (F.col("ts") > F.lit(start).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz"))


def is_alert():
    return F.col("event_type") == "error"


def regional_window_change(spark: SparkSession, d: str) -> DataFrame:
    """Alerts by region in two windows from one pass, with names and changes."""
    now, before = in_window(RECENT), in_window(PREVIOUS)
    alerts = observations(spark, d).where(is_alert() & (now | before)).groupBy("region").agg(
        F.count_if(now).alias("recent_alerts"), F.count_if(before).alias("previous_alerts")
    )
    named = alerts.join(table(spark, d, "region"), F.col("region") == F.col("r_regionkey"))
    change = F.col("recent_alerts") - F.col("previous_alerts")
    return named.select(
        F.col("r_name").alias("region"), "recent_alerts", "previous_alerts", change.alias("change"),
        F.when(change > 0, "worsening").when(change < 0, "improving").otherwise("stable").alias("direction")
    )


def regional_full_join(spark: SparkSession, d: str) -> DataFrame:
    """The same change as a full outer join of two grouped windows."""
    rows = observations(spark, d).where(is_alert())
    group = lambda w, name: rows.where(in_window(w)).groupBy("region").agg(F.count("*").alias(name))
    both = group(RECENT, "recent_alerts").join(group(PREVIOUS, "previous_alerts"), "region", "full")
    recent, previous = F.coalesce("recent_alerts", F.lit(0)), F.coalesce("previous_alerts", F.lit(0))
    return both.select("region", recent.alias("recent_alerts"), previous.alias("previous_alerts"), (recent - previous).alias("delta"))


def window_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).where(in_window(RECENT))
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_if(is_alert()).alias("alerts"), F.round(F.avg("value"), 2).alias("mean_value"),
        F.round(F.min("value"), 6).alias("min_value"), F.round(F.max("value"), 6).alias("max_value")
    )


def category_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).groupBy("event_type").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("value") > 50).alias("n_high"), F.count_if(F.col("value") <= 10).alias("n_low"), F.countDistinct("user_id").alias("n_stations"), F.round(F.avg("value"), 4).alias("mean_value")
    )


def top_alerts_per_category(spark: SparkSession, d: str) -> DataFrame:
    """The three highest values of each category; ties by event."""
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    ranked = observations(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return ranked.select("event_type", F.col("rank").cast("long").alias("rank"), "event_id", F.round("value", 6).alias("value"))


def station_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Large changes from a station's previous observation, found before the period is cut out."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = observations(spark, d).withColumn("before", F.lag("value").over(w)).withColumn("type_before", F.lag("event_type").over(w))
    delta = F.col("value") - F.col("before")
    found = rows.where(in_window(RECENT) & (F.abs(delta) > 40))
    return found.select(
        "event_id", "user_id", "type_before", F.round(delta, 6).alias("delta")
    ).orderBy(F.desc(F.abs("delta")), "event_id").limit(20)


def latest_per_station(spark: SparkSession, d: str) -> DataFrame:
    newest = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("last")
    found = observations(spark, d).groupBy("user_id").agg(newest, F.count("*").alias("n_rows"))
    return found.select("user_id", "last.event_id", "last.event_type", F.round("last.value", 6).alias("value"), "n_rows")


def station_status(spark: SparkSession, d: str) -> DataFrame:
    """Status and score of each station's latest value against the limits of its region."""
    last = latest_per_station(spark, d).withColumn("low", F.lit(5.0)).withColumn("high", 60.0 + 5 * (F.col("user_id") % 5))
    status = threshold_status(
        F.col("value"), F.col("low"), F.col("high"), F.when(F.col("event_type") == "signup", "offline").otherwise("normal")
    )
    return last.select(
        "user_id", status.alias("status"), alert_score(F.col("value"), F.lit(None).cast("double"), F.col("high"), F.lit(0.0)).alias("score")
    )


def observation_export(spark: SparkSession, d: str) -> DataFrame:
    """Observations of the customers of one segment, with attributes; a semi-join filters, left joins add."""
    customers = table(spark, d, "customer")
    chosen = customers.where(F.lower("c_mktsegment") == "building")
    rows = observations(spark, d).join(chosen, F.col("user_id") == F.col("c_custkey"), "left_semi")
    named = rows.join(
        customers.select("c_custkey", "c_nationkey"), F.col("user_id") == F.col("c_custkey"), "left"
    ).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return named.select(
        "event_id", "user_id", F.coalesce("n_name", F.lit("")).alias("nation"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observed_at"), F.round("value", 6).alias("value")
    )


def json_properties(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return observations(spark, d).groupBy((k % 10).alias("bucket")).agg(F.count("*").alias("n_rows"), F.sum(k).alias("total"))


def contract_checks(spark: SparkSession, d: str) -> DataFrame:
    events, customers = observations(spark, d), table(spark, d, "customer")
    orphans = events.join(customers, F.col("user_id") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("failures")).select(
        F.lit("station_exists").alias("check_name"), "failures", (F.col("failures") == 0).alias("passed")
    )
    return (
        tables.unique_violations(events, "event_id_unique", ["event_id"])
        .unionByName(
            tables.scalar_check(events, "event_type_known", ~F.col("event_type").isin("view", "signup", "error", "click", "purchase"))
        )
        .unionByName(tables.scalar_check(events, "props_complete", F.col("props").isNull() | (F.trim("props") == "")))
        .unionByName(orphans)
    )


def freshness(spark: SparkSession, d: str) -> DataFrame:
    """Hours by which each category lags behind the newest observation."""
    newest = observations(spark, d).groupBy("event_type").agg(F.max("ts").alias("newest"))
    top = newest.agg(F.max("newest").alias("top"))
    lag = (F.unix_micros(F.col("top").cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 3.6e9
    return newest.join(F.broadcast(top)).select("event_type", F.round(lag, 4).alias("lag_hours"))


def daily_status_mart(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "region", "event_type").agg(
        F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("total_value"), F.round(F.max("value"), 6).alias("max_value")
    )


def layer_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by three attributes from one pass with grouping sets."""
    customers = table(spark, d, "customer")
    sets = customers.groupingSets([["c_mktsegment"], ["c_nationkey"], []], "c_mktsegment", "c_nationkey")
    counted = sets.agg(F.count("*").alias("n_rows"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return counted.withColumn("c_nationkey", F.col("c_nationkey").cast("string"))


def segment_pivot(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("total", F.col("o_totalprice").cast("decimal(18,2)"))
    wide = tables.pivot(orders, "o_orderpriority", "o_orderstatus", "total", "sum", ["F", "O", "P"])
    return wide.select(F.col("o_orderpriority").alias("priority"), *[F.col(c).cast("double").alias(f"total_{c.lower()}") for c in "FOP"])


def table_summary(spark: SparkSession, d: str) -> DataFrame:
    found = tables.summarize(table(spark, d, "part"), "p_brand", {"p_size": "sum", "p_retailprice": "max", "p_type": "count"})
    return found.select("p_brand", "row_count", "p_size_sum", F.round("p_retailprice_max", 6).alias("p_retailprice_max"), "p_type_count")


def table_join(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    suppliers = table(spark, d, "supplier").select(
        F.when(F.col("s_nationkey") % 7 != 0, F.col("s_nationkey")).alias("key"), F.col("s_name").alias("name")
    )
    nations = tables.where(nations.withColumn("key", F.when(F.col("key") != 3, F.col("key"))))
    return tables.join(suppliers, nations, "key", "left").select(F.col("key").cast("string").alias("key"), "name", "name_right")


_OBS = "(SELECT *, user_id % 5 AS region FROM events)"
_IN = lambda w: f"(ts > TIMESTAMP '{w[0]}' AND ts <= TIMESTAMP '{w[1]}')"

QUERIES = {
    f.__name__: f
    for f in (
        regional_window_change, regional_full_join, window_summary, category_breakdown, top_alerts_per_category, station_anomalies,
        latest_per_station, station_status, observation_export, json_properties, contract_checks, freshness, daily_status_mart,
        layer_counts, segment_pivot, table_summary, table_join
    )
}

SQL = {
    "regional_window_change": f"""
SELECT r_name AS region, recent_alerts, previous_alerts, recent_alerts - previous_alerts AS change,
       CASE WHEN recent_alerts > previous_alerts THEN 'worsening' WHEN recent_alerts < previous_alerts THEN 'improving' ELSE 'stable' END AS direction
FROM (SELECT region, count(*) FILTER ({_IN(RECENT)}) AS recent_alerts, count(*) FILTER ({_IN(PREVIOUS)}) AS previous_alerts
      FROM {_OBS} WHERE event_type = 'error' AND ({_IN(RECENT)} OR {_IN(PREVIOUS)}) GROUP BY region) a JOIN region r ON r.r_regionkey = a.region""",
    "regional_full_join": f"""
WITH a AS (SELECT region, count(*) AS n FROM {_OBS} WHERE event_type = 'error' AND {_IN(RECENT)} GROUP BY region),
b AS (SELECT region, count(*) AS n FROM {_OBS} WHERE event_type = 'error' AND {_IN(PREVIOUS)} GROUP BY region)
SELECT coalesce(a.region, b.region) AS region, coalesce(a.n, 0) AS recent_alerts, coalesce(b.n, 0) AS previous_alerts, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta
FROM a FULL JOIN b ON a.region = b.region""",
    "window_summary": f"SELECT count(*) AS n_rows, count(*) FILTER (event_type = 'error') AS alerts, round(avg(value), 2) AS mean_value, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value FROM events WHERE {_IN(RECENT)}",
    "category_breakdown": "SELECT event_type, count(*) AS n_rows, count(*) FILTER (value > 50) AS n_high, count(*) FILTER (value <= 10) AS n_low, count(DISTINCT user_id) AS n_stations, round(avg(value), 4) AS mean_value FROM events GROUP BY event_type",
    "top_alerts_per_category": "SELECT event_type, rank, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3",
    "station_anomalies": f"""
SELECT event_id, user_id, type_before, round(value - before, 6) AS delta
FROM (SELECT *, lag(value) OVER w AS before, lag(event_type) OVER w AS type_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE {_IN(RECENT)} AND abs(value - before) > 40 ORDER BY abs(round(value - before, 6)) DESC, event_id LIMIT 20""",
    "latest_per_station": "SELECT user_id, event_id, event_type, round(value, 6) AS value, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n_rows FROM events) WHERE k = 1",
    "station_status": """
SELECT user_id, CASE WHEN event_type = 'signup' THEN 'offline' WHEN value < 5 OR value > 60 + 5 * (user_id % 5) THEN 'alert' ELSE 'normal' END AS status, round(value / (60.0 + 5 * (user_id % 5)), 2) AS score
FROM (SELECT user_id, event_type, round(value, 6) AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""",
    "observation_export": """
SELECT event_id, user_id, coalesce(n_name, '') AS nation, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS observed_at, round(value, 6) AS value
FROM events JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE lower(c_mktsegment) = 'building'""",
    "json_properties": "SELECT k % 10 AS bucket, count(*) AS n_rows, CAST(sum(k) AS BIGINT) AS total FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY k % 10",
    "contract_checks": """
SELECT check_name, failures, failures = 0 AS passed FROM (
SELECT 'event_id_unique' AS check_name, count(*) AS failures FROM (SELECT event_id FROM events GROUP BY event_id HAVING count(*) > 1)
UNION ALL SELECT 'event_type_known', count(*) FILTER (event_type NOT IN ('view', 'signup', 'error', 'click', 'purchase')) FROM events
UNION ALL SELECT 'props_complete', count(*) FILTER (props IS NULL OR trim(props) = '') FROM events
UNION ALL SELECT 'station_exists', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer))""",
    "freshness": "SELECT event_type, round((epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 3.6e9, 4) AS lag_hours FROM events GROUP BY event_type",
    "daily_status_mart": f"SELECT strftime(ts, '%Y-%m-%d') AS day, region, event_type, count(*) AS n_rows, round(sum(value), 2) AS total_value, round(max(value), 6) AS max_value FROM {_OBS} GROUP BY 1, 2, 3",
    "layer_counts": "SELECT c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey, count(*) AS n_rows, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "segment_pivot": """
SELECT o_orderpriority AS priority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') AS DOUBLE) AS total_f,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'O') AS DOUBLE) AS total_o, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'P') AS DOUBLE) AS total_p
FROM orders GROUP BY o_orderpriority""",
    "table_summary": "SELECT p_brand, count(*) AS row_count, CAST(sum(p_size) AS BIGINT) AS p_size_sum, round(max(p_retailprice), 6) AS p_retailprice_max, nullif(count(p_type), 0) AS p_type_count FROM part GROUP BY p_brand",
    "table_join": """
SELECT CAST(s.key AS VARCHAR) AS key, s.name, n.name AS name_right
FROM (SELECT CASE WHEN s_nationkey % 7 <> 0 THEN s_nationkey END AS key, s_name AS name FROM supplier) s
LEFT JOIN (SELECT CASE WHEN n_nationkey <> 3 THEN n_nationkey END AS key, n_name AS name FROM nation) n ON s.key IS NOT DISTINCT FROM n.key""",
}
