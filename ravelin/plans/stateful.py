"""Queries with state: streams over the shipped files, ratings, simulations and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models, ratings, series
from ..session import scratch_path, table
from ..streaming import conformal
from .analytics import _M


def _drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """The rows of the last batch of a stream that reads all there is now."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    query = stream.writeStream.outputMode(mode).option(
        "checkpointLocation", f"{path}-log"
    ).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.parquet(path)
    return rows.drop("batch") if mode == "complete" else rows


def streamed_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Event-time windows over the event files as a stream."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    out = _drained(conformal.event_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), window="1 day"), "complete", "daily")
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean_value", 4).alias("mean_value")
    )


def streamed_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of the last 200 scores of each kind."""
    stream = spark.readStream.schema(table(spark, d, "lineitem").schema).parquet(f"{d}/lineitem*.parquet")
    scores = stream.select(
        F.col("l_returnflag").alias("kind"), F.abs(F.col("l_extendedprice") - 1500.0 * F.col("l_quantity")).alias("score"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    )
    out = _drained(conformal.sliding_calibration(scores), "update", "calibration")
    last = out.groupBy("kind").agg(F.max_by(F.struct("n_seen", "window_size", "quantile"), "n_seen").alias("x"))
    return last.select("kind", "x.n_seen", "x.window_size", F.round("x.quantile", 4).alias("quantile"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        (F.col("o_custkey") % 2).alias("league"), "o_orderkey", (F.col("o_custkey") % 8).alias("home"),
        ((F.col("o_custkey") + 1 + F.col("o_orderkey") % 7) % 8).alias("away"), (F.col("o_orderkey") % 5).cast("int").alias("home_score"),
        (F.col("o_custkey") % 4).cast("int").alias("away_score")
    )


def elo_ratings(spark: SparkSession, d: str) -> DataFrame:
    return ratings.elo_ratings(_matches(spark, d), "league", ["o_orderkey"])


def team_table(spark: SparkSession, d: str) -> DataFrame:
    return ratings.team_table(_matches(spark, d))


def simulated_matches(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("problem"), (1.0 + F.col("s_suppkey") % 4).alias("home_rate"),
        (1.0 + F.col("s_suppkey") % 3).alias("away_rate")
    )
    return ratings.simulate(spark, p, 500)


def bootstrap_means(spark: SparkSession, d: str) -> DataFrame:
    return ratings.bootstrap_interval(
        table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal"
    )


def monthly_pacf(spark: SparkSession, d: str) -> DataFrame:
    """Partial autocorrelations from the autocorrelations, a recursion over few lags for each key."""
    out = series.partial_autocorrelation(series.autocorrelation(_monthly(spark, d), 4))
    return out.select("key", "lag", F.round("pacf", 6).alias("pacf"))


def monthly_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """The best of three autoregressions for each priority, with paths."""
    return models.autoregression(_monthly(spark, d), 6, [1, 2, 3])


def propensity_bands(spark: SparkSession, d: str) -> DataFrame:
    """Treated and others by band of a fitted propensity."""
    rows = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("t"), "l_quantity", "l_discount", "l_tax")
    found = models.logistic_propensity(rows, "t", ["l_quantity", "l_discount", "l_tax"])
    return found.groupBy(F.floor(F.col("propensity") * 35).alias("band")).agg(
        F.count_if(F.col("t") == 1).alias("treated"), F.count_if(F.col("t") == 0).alias("others")
    )


def synthetic_priority(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders' monthly totals against a mix of the other priorities."""
    return models.synthetic_control(_monthly(spark, d), "key", "position", "value", "1-URGENT", 60)


def partner_matches(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one matches of customers with a debt by nation, nearest in key."""
    from ..operators.statistics import matched_effect

    c = table(spark, d, "customer").select(
        "c_custkey", (F.col("c_acctbal") < 0).cast("int").alias("t"), F.col("c_acctbal").alias("y"),
        (F.col("c_custkey") % 100 / 100).alias("p"), "c_nationkey"
    )
    return matched_effect(c, "t", "y", "p", "c_nationkey", 0.1, "c_custkey")


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        (F.sum(F.col("o_totalprice").cast("decimal(18,2)")) / 1000).cast("double").alias("total")
    )
    return series.numbered(o, "o_orderpriority", ["month"], "total")


QUERIES = {
    f.__name__: f
    for f in (
        streamed_daily_counts, streamed_calibration, elo_ratings, team_table, simulated_matches, bootstrap_means, monthly_pacf,
        monthly_forecasts, propensity_bands, synthetic_priority, partner_matches
    )
}

SQL = {
    "monthly_pacf": f"""
WITH {_M}, c AS (SELECT key, position, value - avg(value) OVER (PARTITION BY key) AS c FROM m), l AS (SELECT key, c, lag(c) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3, lag(c, 4) OVER w AS c4 FROM c WINDOW w AS (PARTITION BY key ORDER BY position)),
r AS (SELECT key, sum(c * c1) / sum(c * c) AS r1, sum(c * c2) / sum(c * c) AS r2, sum(c * c3) / sum(c * c) AS r3, sum(c * c4) / sum(c * c) AS r4 FROM l GROUP BY key),
a AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS p22 FROM r), b AS (SELECT *, r1 - p22 * r1 AS p21 FROM a), d AS (SELECT *, (r3 - p21 * r2 - p22 * r1) / (1 - p21 * r1 - p22 * r2) AS p33 FROM b),
e AS (SELECT *, p21 - p33 * p22 AS p31, p22 - p33 * p21 AS p32 FROM d), f AS (SELECT *, (r4 - p31 * r3 - p32 * r2 - p33 * r1) / (1 - p31 * r1 - p32 * r2 - p33 * r3) AS p44 FROM e)
SELECT key, unnest([1::BIGINT, 2, 3, 4]) AS lag, round(unnest([r1, p22, p33, p44]), 6) AS pacf FROM f""",
    "streamed_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY 1, 2",
    "streamed_calibration": """
WITH r AS (SELECT l_returnflag AS kind, abs(l_extendedprice - 1500.0 * l_quantity) AS s, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber DESC) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
w AS (SELECT kind, s, n, row_number() OVER (PARTITION BY kind ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY kind) AS m FROM r WHERE k <= 200),
a AS (SELECT *, (m - 1) * least(1.0, ceil((m + 1) * (1 - 0.1)) / m) AS pos FROM w)
SELECT kind, any_value(n) AS n_seen, any_value(m) AS window_size, round(sum(s * (1 - abs(pos - i))) / sum(1 - abs(pos - i)), 4) AS quantile FROM a WHERE abs(pos - i) < 1 GROUP BY kind""",
    "team_table": """
WITH m AS (SELECT o_custkey % 8 AS home, (o_custkey + 1 + o_orderkey % 7) % 8 AS away, o_orderkey % 5 AS hs, o_custkey % 4 AS a FROM orders),
s AS (SELECT home AS team, hs AS own, a AS other FROM m UNION ALL SELECT away, a, hs FROM m)
SELECT team, count(*) FILTER (own > other) AS wins, count(*) FILTER (own = other) AS draws, count(*) FILTER (own < other) AS losses, CAST(sum(own) AS BIGINT) AS scored, CAST(sum(other) AS BIGINT) AS conceded FROM s GROUP BY team""",
}
