"""Effects with covariates, checks of them, and rank tests over deliveries and balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.equations import _ERFC
from ..operators import estimators, ranking
from ..session import table


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Returned lines as the treated ones; the price in thousands as the outcome."""
    l = table(spark, d, "lineitem")  # noqa: E741
    t = (F.col("l_returnflag") == "R").cast("int")
    return l.select(
        "l_orderkey", t.alias("t"), (F.col("l_extendedprice") / 1000 + 2 * t).alias("y"), F.col("l_quantity").alias("q"),
        (F.col("l_discount") * 100 + 3 * t).alias("x"), (F.col("l_tax") * 100).alias("tax"), F.year("l_shipdate").alias("year"),
        (F.col("l_quantity") % 7 + 1).alias("w")
    )


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def regression_effect(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(estimators.regression_adjustment(_deliveries(spark, d), "t", "y", ["q"]).select("effect", "se", "n"))


def yearly_effects(spark: SparkSession, d: str) -> DataFrame:
    out = estimators.subgroup_effects(_deliveries(spark, d), "year", "t", "y", ["q"])
    return _rounded(out.select("subgroup", "n", "treated", "effect"))


def single_learner_effects(spark: SparkSession, d: str) -> DataFrame:
    out = estimators.single_learner(_deliveries(spark, d), "t", "y", ["q"])
    return _rounded(out.groupBy("year").agg(F.avg("cate").alias("cate"), F.count("*").alias("n")))


def two_learner_effects(spark: SparkSession, d: str) -> DataFrame:
    out = estimators.two_learner(_deliveries(spark, d), "t", "y", ["q"])
    return _rounded(out.groupBy("year").agg(F.avg("cate").alias("cate"), F.count("*").alias("n")))


def weighting_effect(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(estimators.inverse_weighting(_deliveries(spark, d), "t", "y", ["q", "x", "tax"]), 4)


def covariate_robust_effect(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(estimators.doubly_robust(_deliveries(spark, d), "t", "y", ["q", "x", "tax"]), 4)


def cross_fitted_effect(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(estimators.cross_fitted(_deliveries(spark, d), "t", "y", ["q", "x", "tax"], "l_orderkey", 3), 4)


def placebo_taxes(spark: SparkSession, d: str) -> DataFrame:
    """The tax, which a return can't change."""
    return _rounded(estimators.placebo_test(_deliveries(spark, d), "t", "tax", ["q"]), 4)


def price_trends(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(estimators.parallel_trends(_deliveries(spark, d), "t", "year", "y"), 4)


def weighted_balances(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(estimators.weighted_balance(_deliveries(spark, d), "t", ["q", "x"], "w"))


def score_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = _deliveries(spark, d).withColumn("score", 1 / (1 + F.exp(-(F.col("x") - 5) / 3)))
    return _rounded(estimators.overlap(rows, "t", "score"))


def weight_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(estimators.effective_sizes(_deliveries(spark, d), "t", "w"), 3)


def effect_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Biases of a given estimate, a row for each region."""
    one = table(spark, d, "region").select(
        (F.col("r_regionkey") - 1.5).cast("double").alias("effect"), (F.col("r_regionkey") - 2.5).cast("double").alias("ci_low"),
        (F.col("r_regionkey") - 0.5).cast("double").alias("ci_high")
    )
    return _rounded(estimators.bias_scenarios(one, 2.0, 3))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Orders' prices against those that their keys foretell."""
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey", F.round(F.col("o_totalprice") / 1000).alias("a"), (F.col("o_orderkey") * 7919 % 300 + 40).cast("double").alias("b"),
        (F.col("o_custkey") * 31 % 280 + 50).cast("double").alias("c")
    )


def hidden_bias(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).withColumn("diff", F.col("a") - F.col("b"))
    return _rounded(ranking.rosenbaum_bounds(rows, "diff", [1.0, 1.2, 1.5]))


def paired_means(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ranking.paired_t(_pairs(spark, d), "a", "b"))


def paired_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ranking.wilcoxon(_pairs(spark, d), "a", "b"))


def method_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ranking.friedman(_pairs(spark, d), "o_orderkey", ["a", "b", "c"]), 4)


def _tail(z: str) -> str:
    """The two-sided normal p-value of an SQL expression, by the same approximation."""
    t = f"(1 / (1 + 0.5 * abs({z}) / sqrt(2)))"
    return f"({t} * exp(-({z}) * ({z}) / 2 + " + " + ".join(f"({c}) * pow({t}, {k})" for k, c in enumerate(_ERFC)) + "))"


_T = """t AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS t, l_extendedprice / 1000 + 2 * CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity AS q,
  l_discount * 100 + 3 * CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS x, l_tax * 100 AS tax, year(l_shipdate) AS year, l_quantity % 7 + 1 AS w FROM lineitem)"""
_B = "(covar_pop(t, y) * var_pop(q) - covar_pop(q, y) * covar_pop(t, q)) / (var_pop(t) * var_pop(q) - pow(covar_pop(t, q), 2))"
_O = "o AS (SELECT o_orderkey, round(o_totalprice / 1000) AS a, CAST(o_orderkey * 7919 % 300 + 40 AS DOUBLE) AS b, CAST(o_custkey * 31 % 280 + 50 AS DOUBLE) AS c FROM orders)"
_RANKS = "d AS (SELECT a - b AS d FROM o{w}), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(d)) AS k FROM d)"
_UP = "((plus - g / (1 + g) * total) / sqrt(g / (1 + g) * (1 - g / (1 + g)) * squares))"
_Z = "((least(plus, total - plus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48))"
_WH = "((pow(chi / 2, 1 / 3) - (1 - 2 / 18)) / sqrt(2 / 18))"
_HALF = "CASE WHEN {z} >= 0 THEN {p} / 2 ELSE 1 - {p} / 2 END"
_EV = "CASE WHEN abs({x}) < 1e-12 THEN 1.0 ELSE exp(0.455 * abs({x})) + sqrt(exp(0.455 * abs({x})) * (exp(0.455 * abs({x})) - 1)) END"

QUERIES = {
    f.__name__: f
    for f in (
        regression_effect, yearly_effects, single_learner_effects, two_learner_effects, weighting_effect, covariate_robust_effect, cross_fitted_effect, placebo_taxes, price_trends,
        weighted_balances, score_overlap, weight_sizes, effect_scenarios, hidden_bias, paired_means, paired_ranks, method_ranks,
    )
}

SQL = {
    "regression_effect": f"""
WITH {_T}, b AS (SELECT {_B} AS b1, count(*) AS n, avg(t) AS mt, avg(q) AS mq, avg(y) AS my, regr_slope(y, q) AS s, regr_slope(t, q) AS u, var_pop(q) AS vq, var_pop(t) - pow(covar_pop(t, q), 2) / var_pop(q) AS rt FROM t),
e AS (SELECT sum(pow(y - my - b1 * (t - mt) - (s - b1 * u) * (q - mq), 2)) AS sse FROM t, b)
SELECT round(b1, 5) AS effect, round(sqrt(sse / (n - 3) / (n * rt)), 5) AS se, n FROM b, e""",
    "yearly_effects": f"WITH {_T} SELECT CAST(year AS VARCHAR) AS subgroup, count(*) AS n, CAST(sum(t) AS BIGINT) AS treated, round({_B}, 5) AS effect FROM t GROUP BY year HAVING count(*) >= 40 AND sum(t) >= 10 AND count(*) - sum(t) >= 10",
    "single_learner_effects": f"WITH {_T}, b AS (SELECT {_B} AS b FROM t) SELECT year, round(any_value(b), 5) AS cate, count(*) AS n FROM t, b GROUP BY year",
    "two_learner_effects": f"""
WITH {_T}, f AS (SELECT regr_slope(y, q) FILTER (t = 1) - regr_slope(y, q) FILTER (t = 0) AS s, regr_intercept(y, q) FILTER (t = 1) - regr_intercept(y, q) FILTER (t = 0) AS i FROM t)
SELECT year, round(avg(i + s * q), 5) AS cate, count(*) AS n FROM t, f GROUP BY year""",
    "price_trends": f"""
WITH {_T}, c AS (SELECT year, count(*) FILTER (t = 0) AS n0, count(*) FILTER (t = 1) AS n1, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS d, coalesce(var_pop(y) FILTER (t = 0), 0) * count(*) FILTER (t = 0) + coalesce(var_pop(y) FILTER (t = 1), 0) * count(*) FILTER (t = 1) AS s FROM t GROUP BY year),
k AS (SELECT *, n0 * n1 / (n0 + n1) AS w FROM c WHERE n0 > 0 AND n1 > 0), m AS (SELECT sum(w * d) / sum(w) AS m FROM k)
SELECT round(coalesce((sum(w * pow(d - m, 2)) / nullif(count(*) - 1, 0)) / (sum(s) / (sum(n0 + n1) - 2 * count(*))), 0), 4) AS f_statistic, count(*) AS n_periods, CAST(sum(n0 + n1) - 2 * count(*) AS BIGINT) AS df FROM k, m""",
    "weighted_balances": f"""
WITH {_T}, v AS (SELECT t, w, 'q' AS covariate, q AS v FROM t UNION ALL SELECT t, w, 'x', x FROM t), m AS (SELECT covariate, t, sum(w * v) / sum(w) AS m, sum(w * v * v) / sum(w) - pow(sum(w * v) / sum(w), 2) AS s FROM v GROUP BY 1, 2)
SELECT covariate, round((a.m - b.m) / sqrt((a.s + b.s) / 2), 5) AS smd, round(a.s / b.s, 5) AS variance_ratio FROM m a JOIN m b USING (covariate) WHERE a.t = 1 AND b.t = 0""",
    "score_overlap": f"""
WITH {_T}, s AS (SELECT t, 1 / (1 + exp(-(x - 5) / 3)) AS p FROM t) SELECT round(min(p), 5) AS least, round(max(p), 5) AS greatest, round(avg(p) FILTER (t = 1), 5) AS treated_mean, round(avg(p) FILTER (t = 0), 5) AS control_mean,
min(p) FILTER (t = 1) <= max(p) FILTER (t = 0) AND min(p) FILTER (t = 0) <= max(p) FILTER (t = 1) AS overlap_ok FROM s""",
    "weight_sizes": f"WITH {_T} SELECT round(pow(sum(w) FILTER (t = 1), 2) / sum(w * w) FILTER (t = 1), 3) AS ess_treated, round(pow(sum(w) FILTER (t = 0), 2) / sum(w * w) FILTER (t = 0), 3) AS ess_control FROM t",
    "effect_scenarios": f"""
WITH e AS (SELECT r_regionkey - 1.5::DOUBLE AS x, r_regionkey - 2.5::DOUBLE AS lo, r_regionkey - 0.5::DOUBLE AS hi FROM region), s AS (SELECT *, unnest([0.0::DOUBLE, 0.625, 1.25]) * abs(x) AS bias, CASE WHEN x >= 0 THEN 1.0 ELSE -1.0 END AS g FROM e)
SELECT round(bias, 5) AS bias, round(x - g * bias, 5) AS effect, round(lo - g * bias, 5) AS ci_low, round(hi - g * bias, 5) AS ci_high, round({_EV.format(x="x")}, 5) AS e_value, round(CASE WHEN lo <= 0 AND hi >= 0 THEN 1.0 ELSE {_EV.format(x="least(abs(lo), abs(hi))")} END, 5) AS e_value_ci FROM s""",
    "hidden_bias": f"""
WITH {_O}, {_RANKS.format(w="")}, s AS (SELECT sum(r) FILTER (d > 0) AS plus, sum(r) AS total, sum(r * r) AS squares, unnest([1.0::DOUBLE, 1.2, 1.5]) AS g FROM r),
p AS (SELECT g, {_HALF.format(z=_UP, p=_tail(_UP))} AS p FROM s) SELECT g AS gamma, round(p, 5) AS p_upper, p < 0.05 AS significant FROM p""",
    "paired_means": f"""
WITH {_O}, s AS (SELECT avg(a - b) AS m, stddev_samp(a - b) AS sd, count(*) AS n FROM o)
SELECT round(m, 5) AS mean_difference, round(m / (sd / sqrt(n)), 5) AS t, round(m / sd, 5) AS cohens_d, n, round({_tail("m / (sd / sqrt(n))")}, 5) AS p_value FROM s""",
    "paired_ranks": f"""
WITH {_O}, {_RANKS.format(w=" WHERE a <> b")}, s AS (SELECT sum(r) FILTER (d > 0) AS plus, sum(r) AS total, count(*)::DOUBLE AS n, sum(k * k - 1)::DOUBLE AS ties FROM r)
SELECT round(least(plus, total - plus), 5) AS statistic, round({_Z}, 5) AS z, CAST(n AS BIGINT) AS n, round({_tail(_Z)}, 5) AS p_value FROM s""",
    "method_ranks": f"""
WITH {_O}, v AS (SELECT o_orderkey AS k, unnest(['a', 'b', 'c']) AS m, unnest([a, b, c]) AS v FROM o), r AS (SELECT k, m, rank() OVER (PARTITION BY k ORDER BY v) + (count(*) OVER (PARTITION BY k, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY k, v) AS e FROM v),
t AS (SELECT sum(e * e - 1) AS ties, count(DISTINCT k)::DOUBLE AS n FROM r), u AS (SELECT m, sum(r) AS s FROM r GROUP BY m), x AS (SELECT sum(s * s) AS q FROM u),
c AS (SELECT (12 * q / (n * 12) - 12 * n) / (1 - ties / (n * 24)) AS chi, n FROM x, t) SELECT round(chi, 4) AS statistic, CAST(n AS BIGINT) AS n, round({_HALF.format(z=_WH, p=_tail(_WH))}, 4) AS p_value FROM c""",
}
