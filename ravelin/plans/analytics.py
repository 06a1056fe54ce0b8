"""Warehouse, series, statistics and raster queries over the shipped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import series, statistics
from ..session import table

# --- warehouse


def dim_segment(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").select("c_mktsegment").distinct()  # a few rows, so one window orders them
    return names.select(
        F.row_number().over(Window.orderBy("c_mktsegment")).cast("long").alias("segment_key"), F.col("c_mktsegment").alias("segment")
    )


def customer_history(spark: SparkSession, d: str) -> DataFrame:
    """Slowly changing history of a customer's order priority: runs of equal values with their span."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").withColumn(
        "_new", F.coalesce((F.lag("o_orderpriority").over(w) != F.col("o_orderpriority")).cast("int"), F.lit(1))
    )
    rows = rows.where("_new = 1").withColumn("to_date", F.lead("o_orderdate").over(w))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.select(
        "o_custkey", F.col("o_orderpriority").alias("priority"), day("o_orderdate").alias("effective_from"),
        F.coalesce(day("to_date"), F.lit("open")).alias("effective_to"), F.col("to_date").isNull().alias("is_current")
    )


def fact_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the keys of segment and region."""
    c = table(spark, d, "customer").join(F.broadcast(dim_segment(spark, d)), F.col("c_mktsegment") == F.col("segment")).join(
        F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")
    )
    rows = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        "o_orderkey", "segment_key", F.col("n_regionkey").alias("region_key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.round("o_totalprice", 2).alias("total")
    )


def mart_region_daily(spark: SparkSession, d: str) -> DataFrame:
    return fact_orders(spark, d).groupBy("region_key", "day").agg(
        F.count("*").alias("n_orders"), F.round(F.max("total"), 2).alias("max_total"), F.countDistinct("segment_key").alias("n_segments")
    )


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))  # noqa: E741
    dec = lambda c: c.cast("decimal(20,4)")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(dec(F.col("l_quantity"))).alias("q"), F.sum(dec(price)).alias("p"), F.count("*").alias("n_rows")
    )
    return out.select(
        "l_returnflag", "l_linestatus", F.round(F.col("q").cast("double"), 2).alias("sum_qty"),
        F.round(F.col("p").cast("double"), 0).alias("sum_disc_price"), "n_rows"
    )


# --- series


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        (F.sum(F.col("o_totalprice").cast("decimal(18,2)")) / 1000).cast("double").alias("total")
    )
    return series.numbered(o, "o_orderpriority", ["month"], "total")


def _stations(spark: SparkSession, d: str) -> DataFrame:
    return series.numbered(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


def rolling_means(spark: SparkSession, d: str) -> DataFrame:
    return series.rolling_mean(_monthly(spark, d), 6).select("key", "position", F.round("mean", 7).alias("mean"))


def station_scores(spark: SparkSession, d: str) -> DataFrame:
    out = series.detector_scores(_stations(spark, d))
    return out.select("key", "position", *[(F.round(c, 4) + 0.0).alias(c) for c in ("z", "rolling_z", "change_z")])


def station_mad(spark: SparkSession, d: str) -> DataFrame:
    return series.mad_scores(_stations(spark, d)).select("key", "position", F.round("mad_score", 4).alias("mad_score"))


def detector_quality(spark: SparkSession, d: str) -> DataFrame:
    out = series.detector_scores(_stations(spark, d)).withColumns({"flag": F.abs("rolling_z") >= 2.5, "truth": F.col("value") > 100})
    return series.detector_quality(out, "flag", "truth")


def forecast_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return series.leaderboard(_monthly(spark, d), 12).select("key", "model", F.round("mae", 4).alias("mae"), "rank")


def linear_trends(spark: SparkSession, d: str) -> DataFrame:
    return series.linear_trend(_monthly(spark, d)).select(
        "key", F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"), F.round("forecast", 3).alias("forecast")
    )


def change_points(spark: SparkSession, d: str) -> DataFrame:
    return series.change_point(_monthly(spark, d)).select("key", "position", F.round("shift", 3).alias("shift"))


def autocorrelations(spark: SparkSession, d: str) -> DataFrame:
    return series.autocorrelation(_monthly(spark, d), 4).select("key", "lag", F.round("acf", 6).alias("acf"))


def seasonal_profiles(spark: SparkSession, d: str) -> DataFrame:
    return series.seasonal_profile(_monthly(spark, d), 12).select("key", "phase", F.round("mean", 4).alias("mean"), "n")


def volatilities(spark: SparkSession, d: str) -> DataFrame:
    return series.volatility(_monthly(spark, d)).select("key", F.round("volatility", 4).alias("volatility"))


# --- statistics


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"), (F.col("l_quantity") * 1500.0).alias("prediction"),
        F.col("l_extendedprice").alias("label"), (F.col("l_orderkey") % 2 == 0).alias("calibration")
    )


def conformal_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = _predicted(spark, d)
    scores = rows.where("calibration").withColumn("score", F.abs(F.col("label") - F.col("prediction")))
    q = statistics.conformal_quantiles(scores, "kind", "score", 0.1)
    out = statistics.coverage(statistics.conformal_intervals(rows.where("not calibration"), q, "kind", "prediction"), "kind", "label")
    return out.select("kind", F.round("coverage", 6).alias("coverage"), F.round("mean_width", 3).alias("mean_width"), "n")


def prediction_errors(spark: SparkSession, d: str) -> DataFrame:
    return statistics.rmse_by(_predicted(spark, d), "kind", "prediction", "label").select("kind", F.round("rmse", 3).alias("rmse"))


def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(
        table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id"
    ).withColumn("predicted", (F.col("n_chars") > 400).cast("int"))
    return statistics.confusion(rows, "predicted", "quality")


def nearest_class(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").withColumn("size", F.col("p_size").cast("double")).withColumn("price", F.col("p_retailprice") / 40)
    classes = parts.withColumn("cls", F.substring("p_brand", 1, 7))
    found = statistics.nearest_centroid(
        parts, statistics.centroids(classes, "cls", ["size", "price"]), "p_partkey", "cls", ["size", "price"]
    )
    return found.groupBy("predicted").agg(F.count("*").alias("n"))


def _treated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("t"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), (F.col("l_linenumber") % 4).alias("stratum"),
        F.year("l_shipdate").alias("year")
    )


def covariate_balance(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.standardized_difference(_treated(spark, d), "t", ["quantity", "price", "discount"])
    return out.select("covariate", F.round("smd", 6).alias("smd"), F.round("variance_ratio", 6).alias("variance_ratio"))


def weighted_effect(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.ipw_effect(statistics.stratum_propensity(_treated(spark, d), "t", "stratum"), "t", "price")
    return out.select(
        F.round("effect", 4).alias("effect"), F.round("ess_treated", 3).alias("ess_treated"),
        F.round("ess_control", 3).alias("ess_control"), "n"
    )


def robust_effect(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.doubly_robust_effect(statistics.stratum_propensity(_treated(spark, d), "t", "stratum"), "t", "price", "stratum")
    return out.select(F.round("effect", 4).alias("effect"), F.round("standard_error", 4).alias("standard_error"), "n")


def did_effect(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.difference_in_differences(_treated(spark, d), F.col("t") == 1, F.col("year") >= 1998, "quantity")
    return out.select(F.round("effect", 6).alias("effect"), "n")


def instrument_effect(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.two_stage_least_squares(_treated(spark, d), "stratum", "quantity", "price")
    return out.select(F.round("effect", 2).alias("effect"), F.round("first_stage_f", 4).alias("first_stage_f"))


def gauge_fits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    out = statistics.regression_line(rows, "l_returnflag", "l_quantity", "l_extendedprice")
    return out.select(
        "l_returnflag", F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"), "n"
    )


def balance_gini(spark: SparkSession, d: str) -> DataFrame:
    return statistics.gini(
        table(spark, d, "customer"), "c_mktsegment", "c_acctbal"
    ).select("c_mktsegment", F.round("gini", 6).alias("gini"))


def scenario_comparison(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    m = o.groupBy(F.col("o_orderpriority").alias("scenario")).agg(
        F.count("*").cast("double").alias("orders"), F.countDistinct("o_custkey").cast("double").alias("customers")
    )
    out = statistics.compare_scenarios(m.unpivot("scenario", ["orders", "customers"], "metric", "value"), "5-LOW")
    return out.select("scenario", "metric", "delta", F.round("percent", 4).alias("percent"), "direction")


def price_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return statistics.bins_2d(
        table(spark, d, "part"), F.col("p_size"), F.col("p_retailprice"), 50.0, 2100.0, 10, F.col("p_brand").endswith("1")
    )


def raster_change(spark: SparkSession, d: str) -> DataFrame:
    """Two rasters of suppliers by parts from two years, joined by cell: the largest changes."""
    l = table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("row"), (F.col("l_partkey") % 8).alias("col"), F.year("l_shipdate").alias("year"), F.col("l_quantity").cast("long").alias("quantity"))  # noqa: E741
    cells = lambda y, name: l.where(F.col("year") == y).groupBy("row", "col").agg(F.sum("quantity").alias(name))
    both = cells(1996, "baseline").join(cells(1999, "latest"), ["row", "col"]).withColumn("delta", F.col("latest") - F.col("baseline"))
    return both.orderBy(F.desc("delta"), "row", "col").limit(5)


def odds_market(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.equations import normalised_market

    m = F.create_map(F.lit("home"), 1 + F.col("s_suppkey") % 5, F.lit("draw"), F.lit(3.2), F.lit("away"), 1.5 + F.col("s_suppkey") % 3)
    odds = F.transform_values(m, lambda _, v: v.cast("double"))
    out = table(spark, d, "supplier").select("s_suppkey", normalised_market(odds).alias("p"))
    return out.select("s_suppkey", *[F.round(F.col("p")[k], 6).alias(k) for k in ("home", "draw", "away")])


_M = """m AS (SELECT o_orderpriority AS key, row_number() OVER (PARTITION BY o_orderpriority ORDER BY month) AS position, value FROM
(SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS value FROM orders GROUP BY 1, 2))"""
_E = "e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, value FROM events)"
_T = "t AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS t, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_linenumber % 4 AS stratum, year(l_shipdate) AS year FROM lineitem)"
_SCORES = f"""WITH {_E}, c AS (SELECT *, value - lag(value) OVER (PARTITION BY key ORDER BY position) AS change FROM e),
s AS (SELECT *, avg(value) OVER p AS m, stddev_pop(value) OVER p AS sd, avg(value) OVER r AS rm, stddev_pop(value) OVER r AS rsd, avg(change) OVER p AS cm, stddev_pop(change) OVER p AS csd FROM c
WINDOW p AS (PARTITION BY key ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY key ORDER BY position ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
z AS (SELECT key, position, value, (value - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z, (value - rm) / CASE WHEN rsd > 0 THEN rsd ELSE 1 END AS rolling_z, (change - cm) / CASE WHEN csd > 0 THEN csd ELSE 1 END AS change_z FROM s WHERE position > 5)"""
_SEG = "seg AS (SELECT row_number() OVER (ORDER BY c_mktsegment) AS segment_key, c_mktsegment AS segment FROM (SELECT DISTINCT c_mktsegment FROM customer))"
_F = f"WITH {_SEG}, f AS (SELECT o_orderkey, segment_key, n_regionkey AS region_key, strftime(o_orderdate, '%Y-%m-%d') AS day, round(o_totalprice, 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN seg ON segment = c_mktsegment JOIN nation ON c_nationkey = n_nationkey)"

QUERIES = {
    f.__name__: f
    for f in (
        dim_segment, customer_history, fact_orders, mart_region_daily, pricing_summary, rolling_means, station_scores, station_mad,
        detector_quality, forecast_leaderboard, linear_trends, change_points, autocorrelations, seasonal_profiles, volatilities,
        conformal_coverage, prediction_errors, label_confusion, nearest_class, covariate_balance, weighted_effect, robust_effect,
        did_effect, instrument_effect, gauge_fits, balance_gini, scenario_comparison, price_heatmap, raster_change, odds_market
    )
}

SQL = {
    "dim_segment": f"WITH {_SEG} SELECT segment_key, segment FROM seg",
    "customer_history": """
WITH o AS (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders),
n AS (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS e FROM o WHERE b IS DISTINCT FROM o_orderpriority)
SELECT o_custkey, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS effective_from, coalesce(strftime(e, '%Y-%m-%d'), 'open') AS effective_to, e IS NULL AS is_current FROM n""",
    "fact_orders": f"{_F} SELECT * FROM f",
    "mart_region_daily": f"{_F} SELECT region_key, day, count(*) AS n_orders, max(total) AS max_total, count(DISTINCT segment_key) AS n_segments FROM f GROUP BY 1, 2",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(CAST(sum(CAST(l_quantity AS DECIMAL(20,4))) AS DOUBLE), 2) AS sum_qty, round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,4))) AS DOUBLE), 0) AS sum_disc_price, count(*) AS n_rows FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "rolling_means": f"WITH {_M} SELECT key, position, round(mean, 7) AS mean FROM (SELECT *, avg(value) OVER (PARTITION BY key ORDER BY position ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS mean FROM m) WHERE position >= 6",
    "station_scores": f"{_SCORES} SELECT key, position, round(z, 4) + 0.0 AS z, round(rolling_z, 4) + 0.0 AS rolling_z, round(change_z, 4) + 0.0 AS change_z FROM z",
    "station_mad": f"""
WITH {_E}, p AS (SELECT a.key, a.position, a.value, b.value AS past FROM e a JOIN e b ON a.key = b.key AND b.position < a.position WHERE a.position > 5),
q AS (SELECT key, position, value, past, median(past) OVER (PARTITION BY key, position) AS med FROM p),
r AS (SELECT key, position, any_value(value) AS value, any_value(med) AS med, median(abs(past - med)) AS mad FROM q GROUP BY key, position)
SELECT key, position, CASE WHEN mad > 0 THEN round(0.6745 * abs(value - med) / mad, 4) ELSE 0.0::DOUBLE END AS mad_score FROM r""",
    "detector_quality": f"""{_SCORES}, k AS (SELECT count(*) FILTER (abs(rolling_z) >= 2.5 AND value > 100) AS tp, count(*) FILTER (abs(rolling_z) >= 2.5 AND NOT value > 100) AS fp, count(*) FILTER (NOT abs(rolling_z) >= 2.5 AND value > 100) AS fn FROM z),
pr AS (SELECT *, round(tp / (tp + fp), 2) AS precision, round(tp / (tp + fn), 2) AS recall FROM k) SELECT *, round(2 * precision * recall / (precision + recall), 2) AS f1 FROM pr""",
    "forecast_leaderboard": f"""
WITH {_M}, f AS (SELECT *, lag(value) OVER w AS last_value, (lag(value) OVER w + lag(value, 2) OVER w + lag(value, 3) OVER w) / 3 AS trailing_mean,
  lag(value) OVER w + (lag(value) OVER w - first_value(value) OVER w) / nullif(position - 2, 0) AS drift, lag(value, 4) OVER w AS seasonal_naive, max(position) OVER (PARTITION BY key) AS n FROM m WINDOW w AS (PARTITION BY key ORDER BY position)),
t AS (SELECT * FROM f WHERE position > n - 12 AND position > 4),
e AS (SELECT key, 'last_value' AS model, avg(abs(value - last_value)) AS mae FROM t GROUP BY key UNION ALL SELECT key, 'trailing_mean', avg(abs(value - trailing_mean)) FROM t GROUP BY key
  UNION ALL SELECT key, 'drift', avg(abs(value - drift)) FROM t GROUP BY key UNION ALL SELECT key, 'seasonal_naive', avg(abs(value - seasonal_naive)) FROM t GROUP BY key)
SELECT key, model, round(mae, 4) AS mae, row_number() OVER (PARTITION BY key ORDER BY round(mae, 6), model) AS rank FROM e""",
    "linear_trends": f"WITH {_M} SELECT key, round(regr_slope(value, position), 4) AS slope, round(regr_r2(value, position), 6) AS r2, round(regr_intercept(value, position) + regr_slope(value, position) * (max(position) + 1), 3) AS forecast FROM m GROUP BY key",
    "change_points": f"""
WITH {_M}, s AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, sum(value) OVER (PARTITION BY key ORDER BY position) AS a, sum(value) OVER (PARTITION BY key) AS t FROM m),
d AS (SELECT key, position, (t - a) / (n - position) - a / position AS shift FROM s WHERE position >= 2 AND n - position >= 2)
SELECT key, position, round(shift, 3) AS shift FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(abs(shift), 6) DESC, position) AS k FROM d) WHERE k = 1""",
    "autocorrelations": f"""
WITH {_M}, c AS (SELECT key, position, value - avg(value) OVER (PARTITION BY key) AS c FROM m), v AS (SELECT key, sum(c * c) AS v FROM c GROUP BY key)
SELECT a.key, a.position - b.position AS lag, round(sum(a.c * b.c) / any_value(v.v), 6) AS acf FROM c a JOIN c b ON a.key = b.key AND a.position - b.position BETWEEN 1 AND 4 JOIN v ON v.key = a.key GROUP BY 1, 2""",
    "seasonal_profiles": f"WITH {_M} SELECT key, (position - 1) % 12 AS phase, round(avg(value), 4) AS mean, count(*) AS n FROM m GROUP BY 1, 2",
    "volatilities": f"WITH {_M}, d AS (SELECT key, value - lag(value) OVER (PARTITION BY key ORDER BY position) AS d FROM m) SELECT key, round(stddev_samp(d), 4) AS volatility FROM d GROUP BY key",
    "conformal_coverage": """
WITH p AS (SELECT l_returnflag AS kind, l_quantity * 1500.0 AS prediction, l_extendedprice AS label, l_orderkey % 2 = 0 AS calibration FROM lineitem),
s AS (SELECT kind, abs(label - prediction) AS s, row_number() OVER (PARTITION BY kind ORDER BY abs(label - prediction)) - 1 AS k, count(*) OVER (PARTITION BY kind) AS n FROM p WHERE calibration),
a AS (SELECT *, (n - 1) * least(1.0, ceil((n + 1) * (1 - 0.1)) / n) AS pos FROM s),
q AS (SELECT kind, sum(s * (1 - abs(pos - k))) / sum(1 - abs(pos - k)) AS q FROM a WHERE abs(pos - k) < 1 GROUP BY kind)
SELECT kind, round(avg(CASE WHEN label BETWEEN prediction - q AND prediction + q THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(2 * q), 3) AS mean_width, count(*) AS n FROM p JOIN q USING (kind) WHERE NOT calibration GROUP BY kind""",
    "prediction_errors": "SELECT l_returnflag AS kind, round(sqrt(avg(pow(l_quantity * 1500.0 - l_extendedprice, 2))), 3) AS rmse FROM lineitem GROUP BY 1",
    "label_confusion": """
WITH c AS (SELECT count(*) FILTER (n_chars > 400 AND quality = 1) AS tp, count(*) FILTER (n_chars > 400 AND quality <> 1) AS fp, count(*) FILTER (n_chars <= 400 AND quality = 1) AS fn, count(*) FILTER (n_chars <= 400 AND quality <> 1) AS tn FROM labels JOIN documents USING (doc_id)),
p AS (SELECT *, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall FROM c) SELECT *, round(2 * precision * recall / (precision + recall), 4) AS f1 FROM p""",
    "nearest_class": """
WITH c AS (SELECT substr(p_brand, 1, 7) AS cls, avg(p_size) AS s, avg(p_retailprice / 40) AS r FROM part GROUP BY 1),
d AS (SELECT p_partkey, cls, row_number() OVER (PARTITION BY p_partkey ORDER BY pow(p_size - s, 2) + pow(p_retailprice / 40 - r, 2), cls) AS k FROM part, c)
SELECT cls AS predicted, count(*) AS n FROM d WHERE k = 1 GROUP BY cls""",
    "covariate_balance": f"WITH {_T} " + " UNION ALL ".join(
        f"SELECT '{c}' AS covariate, round((avg({c}) FILTER (t = 1) - avg({c}) FILTER (t = 0)) / sqrt((var_samp({c}) FILTER (t = 1) + var_samp({c}) FILTER (t = 0)) / 2), 6) AS smd, round(var_samp({c}) FILTER (t = 1) / var_samp({c}) FILTER (t = 0), 6) AS variance_ratio FROM t"
        for c in ("quantity", "price", "discount")
    ),
    "weighted_effect": f"""
WITH {_T}, p AS (SELECT stratum, greatest(0.01, least(0.99, avg(t))) AS p FROM t GROUP BY stratum), w AS (SELECT *, CASE WHEN t = 1 THEN least(20, 1 / p) ELSE least(20, 1 / (1 - p)) END AS w FROM t JOIN p USING (stratum))
SELECT round(sum(w * price) FILTER (t = 1) / sum(w) FILTER (t = 1) - sum(w * price) FILTER (t = 0) / sum(w) FILTER (t = 0), 4) AS effect, round(pow(sum(w) FILTER (t = 1), 2) / sum(w * w) FILTER (t = 1), 3) AS ess_treated, round(pow(sum(w) FILTER (t = 0), 2) / sum(w * w) FILTER (t = 0), 3) AS ess_control, count(*) AS n FROM w""",
    "robust_effect": f"""
WITH {_T}, p AS (SELECT stratum, greatest(0.01, least(0.99, avg(t))) AS p, avg(price) FILTER (t = 1) AS m1, avg(price) FILTER (t = 0) AS m0 FROM t GROUP BY stratum),
s AS (SELECT m1 - m0 + CASE WHEN t = 1 THEN (price - m1) / p ELSE -(price - m0) / (1 - p) END AS s FROM t JOIN p USING (stratum)) SELECT round(avg(s), 4) AS effect, round(stddev_samp(s) / sqrt(count(*)), 4) AS standard_error, count(*) AS n FROM s""",
    "did_effect": f"WITH {_T} SELECT round(avg(quantity) FILTER (t = 1 AND year >= 1998) - avg(quantity) FILTER (t = 1 AND year < 1998) - avg(quantity) FILTER (t = 0 AND year >= 1998) + avg(quantity) FILTER (t = 0 AND year < 1998), 6) AS effect, count(*) AS n FROM t",
    "instrument_effect": f"WITH {_T} SELECT round(covar_samp(price, stratum) / covar_samp(quantity, stratum), 2) AS effect, round(pow(corr(stratum, quantity), 2) / (1 - pow(corr(stratum, quantity), 2)) * (count(*) - 2), 4) AS first_stage_f FROM t",
    "gauge_fits": "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(greatest(0, least(1, regr_r2(l_extendedprice, l_quantity))), 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1",
    "balance_gini": """
WITH v AS (SELECT c_mktsegment, greatest(0, c_acctbal) AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY greatest(0, c_acctbal)) AS k FROM customer)
SELECT c_mktsegment, round(2 * sum(k * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) AS gini FROM v GROUP BY 1""",
    "scenario_comparison": """
WITH m AS (SELECT o_orderpriority AS s, count(*)::DOUBLE AS orders, count(DISTINCT o_custkey)::DOUBLE AS customers FROM orders GROUP BY 1), l AS (SELECT s, 'orders' AS metric, orders AS v FROM m UNION ALL SELECT s, 'customers', customers FROM m)
SELECT a.s AS scenario, a.metric, a.v - b.v AS delta, round(100 * (a.v - b.v) / b.v, 4) AS percent, CASE WHEN a.v > b.v THEN 'up' WHEN a.v < b.v THEN 'down' ELSE 'flat' END AS direction FROM l a JOIN l b ON a.metric = b.metric AND b.s = '5-LOW' WHERE a.s <> '5-LOW'""",
    "price_heatmap": "SELECT CAST(least(floor(p_size / 50.0 * 10), 9) AS BIGINT) AS bx, CAST(least(floor(p_retailprice / 2100.0 * 10), 9) AS BIGINT) AS by, count(*) AS n, count(*) FILTER (ends_with(p_brand, '1')) AS successes FROM part GROUP BY 1, 2",
    "raster_change": """
WITH l AS (SELECT l_suppkey % 8 AS row, l_partkey % 8 AS col, year(l_shipdate) AS y, CAST(l_quantity AS BIGINT) AS q FROM lineitem), a AS (SELECT row, col, CAST(sum(q) AS BIGINT) AS baseline FROM l WHERE y = 1996 GROUP BY 1, 2), b AS (SELECT row, col, CAST(sum(q) AS BIGINT) AS latest FROM l WHERE y = 1999 GROUP BY 1, 2)
SELECT row, col, baseline, latest, latest - baseline AS delta FROM a JOIN b USING (row, col) ORDER BY delta DESC, row, col LIMIT 5""",
    "odds_market": """
WITH p AS (SELECT s_suppkey, CASE WHEN 1 + s_suppkey % 5 <= 1 THEN 0 ELSE 1 / (1 + s_suppkey % 5) END AS h, 1 / 3.2 AS d, 1 / (1.5 + s_suppkey % 3) AS a FROM supplier)
SELECT s_suppkey, round(h / (h + d + a), 6) AS home, round(d / (h + d + a), 6) AS draw, round(a / (h + d + a), 6) AS away FROM p""",
}
