"""Grouped statistics: conformal intervals, causal estimates, classification and scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import quantile_at, value_ranks


def conformal_quantiles(scores: DataFrame, group: str, score: str, alpha: float = 0.1) -> DataFrame:
    """``(group, quantile, n)``: the interpolated quantile of scores at ceil((n + 1)(1 - alpha)) / n, above one the greatest score.

    Scores are ranked in ranges over all groups, so no task holds a group.
    """
    rows = scores.where(F.col(score).isNotNull()).select(F.col(group).alias("_g"), F.col(score).cast("double").alias("_s"))
    level = F.least(F.lit(1.0), F.ceil((F.col("size") + 1) * (1 - alpha)) / F.col("size"))
    return quantile_at(value_ranks(rows, ["_g"], "_s"), ["_g"], "_s", level).select(F.col("_g").alias(group), "quantile", "n")


def conformal_intervals(rows: DataFrame, quantiles: DataFrame, group: str, prediction: str, sigma: str | None = None) -> DataFrame:
    """``lower`` and ``upper`` for each row; a group without scores has infinite ones, and a null group is a group."""
    q = F.coalesce("quantile", F.lit(float("inf"))) * (F.col(sigma) if sigma else F.lit(1.0))
    known = quantiles.select(F.col(group).alias("_quantile_of"), "quantile")
    joined = rows.join(known, F.col(group).eqNullSafe(F.col("_quantile_of")), "left")
    return joined.withColumns({"lower": F.col(prediction) - q, "upper": F.col(prediction) + q}).drop("quantile", "_quantile_of")


def coverage(rows: DataFrame, group: str, label: str) -> DataFrame:
    """``(group, coverage, mean_width, n)``."""
    inside = F.col(label).between(F.col("lower"), F.col("upper"))
    return rows.groupBy(group).agg(
        F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col("upper") - F.col("lower")).alias("mean_width"), F.count("*").alias("n")
    )


def neighbour_sigma(nodes: DataFrame, edges: DataFrame, residual: str, strength: float = 0.5) -> DataFrame:
    """``(node, sigma)``: one plus the mean absolute residual of in-neighbours, weighted."""
    known = nodes.where(F.col(residual).isNotNull()).select(F.col("node").alias("from_node"), F.abs(residual).alias("_r"))
    mean = edges.join(known, "from_node").groupBy(F.col("to_node").alias("node")).agg(F.avg("_r").alias("_m"))
    return nodes.join(mean, "node", "left").select("node", (1 + strength * F.coalesce("_m", F.lit(0.0))).alias("sigma"))


def rmse_by(rows: DataFrame, group: str, prediction: str, label: str) -> DataFrame:
    return rows.groupBy(group).agg(F.sqrt(F.avg(F.pow(F.col(prediction) - F.col(label), F.lit(2.0)))).alias("rmse"))


def confusion(rows: DataFrame, predicted: str, label: str) -> DataFrame:
    """One row of counts, accuracy, precision, recall and F1 for 0/1 columns."""
    p, y = F.col(predicted) == 1, F.col(label) == 1
    c = rows.agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn")
    )
    ratio = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 4), F.lit(0.0))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    c = c.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    pr, re = F.col("precision"), F.col("recall")
    return c.withColumn("f1", F.coalesce(F.round(2 * pr * re / F.nullif(pr + re, F.lit(0.0)), 4), F.lit(0.0)))


def centroids(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    return rows.groupBy(label).agg(*[F.avg(f).alias(f) for f in features])


def nearest_centroid(rows: DataFrame, centres: DataFrame, id_col: str, label: str, features: list[str]) -> DataFrame:
    """``(id, predicted)``; classes are few, so their centres are one row of an array."""
    packed = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.array(*features).alias("at")))).alias("_c"))
    own = F.array(*[F.col(f).cast("double") for f in features])
    far = lambda c: F.aggregate(F.zip_with(own, c["at"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.transform("_c", lambda c: F.struct(far(c).alias("d"), c["label"].alias("label"))))
    return rows.join(F.broadcast(packed)).select(id_col, best["label"].alias("predicted"))


# --- causal estimates


def standardized_difference(rows: DataFrame, treatment: str, covariates: list[str]) -> DataFrame:
    """``(covariate, smd, variance_ratio)`` between treated and others."""
    t = F.col(treatment) == 1
    stats = []
    for c in covariates:
        one, other = F.when(t, F.col(c)), F.when(~t, F.col(c))
        pooled = F.sqrt((F.var_samp(one) + F.var_samp(other)) / 2)
        stats.append(
            F.struct(
                F.lit(c).alias("covariate"), ((F.avg(one) - F.avg(other)) / F.nullif(pooled, F.lit(0.0))).alias("smd"),
                (F.var_samp(one) / F.nullif(F.var_samp(other), F.lit(0.0))).alias("variance_ratio")
            )
        )
    return rows.agg(F.array(*stats).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def stratum_propensity(rows: DataFrame, treatment: str, stratum: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows with the clipped share of treated in their stratum as ``propensity``.

    The strata's shares go to the rows, since rows dealt by a few strata would be a few tasks.
    """
    share = rows.groupBy(stratum).agg(
        F.greatest(F.lit(low), F.least(F.lit(high), F.avg(F.col(treatment).cast("double")))).alias("propensity")
    )
    return rows.join(F.broadcast(share), stratum)


def ipw_effect(rows: DataFrame, treatment: str, outcome: str, cap: float = 20.0) -> DataFrame:
    """Hajek estimate of the average effect, with effective sample sizes."""
    t, p = F.col(treatment) == 1, F.col("propensity")
    w1, w0 = F.when(t, F.least(F.lit(cap), 1 / p)), F.when(~t, F.least(F.lit(cap), 1 / (1 - p)))
    y = F.col(outcome)
    effect = F.sum(w1 * y) / F.sum(w1) - F.sum(w0 * y) / F.sum(w0)
    ess = lambda w: F.pow(F.sum(w), F.lit(2.0)) / F.sum(w * w)
    return rows.agg(effect.alias("effect"), ess(w1).alias("ess_treated"), ess(w0).alias("ess_control"), F.count("*").alias("n"))


def doubly_robust_effect(rows: DataFrame, treatment: str, outcome: str, stratum: str) -> DataFrame:
    """Augmented weighting with stratum means as the outcome models; these go to the rows, as in ``stratum_propensity``."""
    t = F.col(treatment) == 1
    means = rows.groupBy(stratum).agg(F.avg(F.when(t, F.col(outcome))).alias("_m1"), F.avg(F.when(~t, F.col(outcome))).alias("_m0"))
    r = rows.join(F.broadcast(means), stratum).where("_m1 is not null and _m0 is not null")
    y, p = F.col(outcome), F.col("propensity")
    score = F.col("_m1") - F.col("_m0") + F.when(t, (y - F.col("_m1")) / p).otherwise(-(y - F.col("_m0")) / (1 - p))
    return r.agg(
        F.avg(score).alias("effect"), (F.stddev_samp(score) / F.sqrt(F.count("*"))).alias("standard_error"), F.count("*").alias("n")
    )


def difference_in_differences(rows: DataFrame, treated: Column, after: Column, outcome: str) -> DataFrame:
    cell = lambda a, b: F.avg(F.when(a & b, F.col(outcome)))
    return rows.agg(
        (cell(treated, after) - cell(treated, ~after) - cell(~treated, after) + cell(~treated, ~after)).alias("effect"),
        F.count("*").alias("n")
    )


def two_stage_least_squares(rows: DataFrame, instrument: str, treatment: str, outcome: str) -> DataFrame:
    """One instrument: the ratio of covariances, and the first stage's F."""
    z, d, y = (F.col(c).cast("double") for c in (instrument, treatment, outcome))
    r2 = F.pow(F.corr(z, d), F.lit(2.0))
    return rows.agg((F.covar_samp(z, y) / F.covar_samp(z, d)).alias("effect"), (r2 / (1 - r2) * (F.count("*") - 2)).alias("first_stage_f"))


def regression_line(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    return rows.groupBy(group).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.regr_r2(y, x))).alias("r2"), F.count("*").alias("n")
    )


def e_value(ratio: Column) -> Column:
    r = F.when(ratio < 1, 1 / ratio).otherwise(ratio)
    return r + F.sqrt(r * (r - 1))


def gini(df: DataFrame, group: str, value: str) -> DataFrame:
    """Gini of values clamped at zero, per group; values are ranked in ranges over all groups."""
    v = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.greatest(F.lit(0.0), F.col(value).cast("double")).alias("_v"))
    v = value_ranks(v, ["_g"], "_v")
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("_v"))
    weighted = F.sum(F.col("_v") * (F.col("n") * F.col("before") + F.col("n") * (F.col("n") + 1) / 2))
    g = F.when(total > 0, 2 * weighted / F.nullif(n * total, F.lit(0.0)) - (n + 1) / n).otherwise(F.lit(0.0))
    return v.groupBy("_g").agg(g.alias("gini")).select(F.col("_g").alias(group), "gini")


# --- scenarios


def compare_scenarios(metrics: DataFrame, baseline: str) -> DataFrame:
    """``(scenario, metric, base, value, delta, percent, direction)`` over the union of metrics."""
    base = metrics.where(F.col("scenario") == baseline).select("metric", F.col("value").alias("base"))
    others = metrics.where(F.col("scenario") != baseline)
    names = others.select("scenario").distinct()
    grid = names.join(F.broadcast(metrics.select("metric").distinct()), how="cross")  # scenario and metric names only
    out = grid.join(base, "metric", "left").join(others, ["scenario", "metric"], "left")
    delta = F.coalesce("value", F.lit(0.0)) - F.coalesce("base", F.lit(0.0))
    return out.select(
        "scenario", "metric", "base", "value", delta.alias("delta"), (100 * delta / F.nullif(F.col("base"), F.lit(0.0))).alias("percent"),
        F.when(delta > 1e-9, "up").when(delta < -1e-9, "down").otherwise("flat").alias("direction")
    )


def bins_2d(df: DataFrame, x: Column, y: Column, x_max: float, y_max: float, n: int = 10, success: Column | None = None) -> DataFrame:
    """``(bx, by, n, successes)`` on an n by n grid; the upper edges belong to the last bins."""
    bx = F.least(F.floor(x / x_max * n), F.lit(n - 1)).cast("long")
    by = F.least(F.floor(y / y_max * n), F.lit(n - 1)).cast("long")
    return df.groupBy(bx.alias("bx"), by.alias("by")).agg(
        F.count("*").alias("n"), F.count_if(success if success is not None else F.lit(False)).alias("successes")
    )


def two_line_effect(rows: DataFrame, treatment: str, x: str, outcome: str) -> DataFrame:
    """The mean difference of two outcome lines, one fitted to each arm, over all rows."""
    t = F.col(treatment) == 1
    y, v = F.col(outcome), F.col(x)
    fit = lambda arm: (F.regr_slope(F.when(arm, y), F.when(arm, v)), F.regr_intercept(F.when(arm, y), F.when(arm, v)))
    (b1, a1), (b0, a0) = fit(t), fit(~t)
    return rows.agg((a1 - a0 + (b1 - b0) * F.avg(v)).alias("effect"), F.count("*").alias("n"))


def matched_effect(rows: DataFrame, treatment: str, outcome: str, score: str, stratum: str, caliper: float, id_col: str) -> DataFrame:
    """``(stratum, pairs, effect)`` of greedy one-to-one matches within strata, treated in ascending order of score; without a pair the effect is null.

    A match takes its partner away from later ones, so what may depend on each
    other is one ordered fold. Scores that are further apart than the caliper are
    never matched, so a stratum is cut at such gaps; these runs are spread over
    tasks and are the unit that has to fit into one.
    """
    import bisect

    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        treated = pdf[pdf[treatment] == 1].sort_values([score, id_col])
        others = pdf[pdf[treatment] == 0].sort_values([score, id_col])
        scores, outcomes = others[score].tolist(), others[outcome].tolist()
        gaps, pairs = 0.0, 0
        for s, y in zip(treated[score], treated[outcome], strict=True):
            at = bisect.bisect_left(scores, s)
            near = [k for k in (at - 1, at) if 0 <= k < len(scores) and abs(scores[k] - s) <= caliper]
            if near:
                k = min(near, key=lambda i: (abs(scores[i] - s), i))
                gaps, pairs = gaps + y - outcomes[k], pairs + 1
                del scores[k], outcomes[k]
        return pd.DataFrame({"stratum": pdf[stratum].iloc[:1].to_numpy(), "pairs": [pairs], "gaps": [float(gaps)]})

    kept = rows.select(id_col, treatment, outcome, score, stratum).dropna()
    ordered = Window.partitionBy(stratum).orderBy(score)
    cut = F.coalesce((F.col(score) - F.lag(score).over(ordered) > caliper).cast("int"), F.lit(0))
    runs = kept.withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(ordered)).drop("_cut")
    found = runs.groupBy(stratum, "_run").applyInPandas(fold, f"stratum {dict(rows.dtypes)[stratum]}, pairs long, gaps double")
    pairs = F.sum("pairs")
    return found.groupBy("stratum").agg(pairs.alias("pairs"), F.when(pairs > 0, F.sum("gaps") / pairs).alias("effect"))


def calibrate_decay(rows: DataFrame, distance: str, observed: str, scales: list[float], powers: list[float]) -> DataFrame:
    """The grid's ``(scale, power, rmse)`` of least error, the first of equal ones; every row meets every pair of a small grid."""
    grid = F.array(*[F.struct(F.lit(float(s)).alias("scale"), F.lit(float(p)).alias("power")) for s in scales for p in powers])
    tried = rows.select(distance, observed, F.explode(grid).alias("g")).select(distance, observed, "g.*")
    miss = F.pow(1 + F.col(distance) / F.col("scale"), -F.col("power")) - F.col(observed)
    errors = tried.groupBy("scale", "power").agg(F.sqrt(F.avg(miss * miss)).alias("rmse"))
    return errors.orderBy(F.round("rmse", 9), "scale", "power").limit(1)


def sensitivity(rows: DataFrame, parameters: dict[str, float], model, share: float = 0.1) -> DataFrame:
    """``(parameter, low, base, high)`` of a model's mean with one parameter at a time moved by a share of itself.

    ``model`` maps a dict of numbers to a column of ``rows``.
    """
    mean = lambda p: F.avg(model(p))
    cases = [
        F.struct(
            F.lit(name).alias("parameter"), mean(parameters | {name: v * (1 - share)}).alias("low"), mean(parameters).alias("base"),
            mean(parameters | {name: v * (1 + share)}).alias("high")
        ) for name,
        v in parameters.items()
    ]
    return rows.agg(F.array(*cases).alias("x")).select(F.explode("x").alias("x")).select("x.*")
