"""Scorecards, profiles and fits of series, propagated conformal intervals, and losses over pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import equations
from ..session import settle
from . import statistics
from .ranking import value_ranks

# Fixed values of the risk scorecard: weights of its features, and the score from which a risk is high.
SCORE_WEIGHTS = {
    "recent_mean": 0.12,
    "variability": 0.8,
    "trend": 6.0,
    "anomaly_rate": 12.0,
    "maintenance_lag": 0.35,
    "exceedance_days": 0.9,
}
HIGH_SCORE = 8.3
# Fixed values of the fit categories: least R squared, from the best.
FIT_CATEGORIES = [(0.8, "very_strong"), (0.6, "adequate"), (0.25, "weak_to_moderate")]


# --- risk


def risk_score() -> Column:
    """The weighted sum of the six features, to two digits."""
    return F.round(sum((F.col(f) * w for f, w in SCORE_WEIGHTS.items()), F.lit(0.0)), 2)


def scorecard_label() -> Column:
    return F.when(risk_score() >= HIGH_SCORE, "high").otherwise("low")


def rules_label() -> Column:
    """Many anomalies, a steep and variable series, or late maintenance with exceedances are a high risk."""
    steep = (F.col("trend") >= 0.45) & (F.col("variability") >= 2.0)
    late = (F.col("maintenance_lag") >= 6) & (F.col("exceedance_days") >= 3)
    return F.when((F.col("anomaly_rate") >= 0.25) | steep | late, "high").otherwise("low")


def top_drivers(k: int = 3) -> Column:
    """The features that add most to the score, as ``(feature, contribution)``, the first of equal ones first."""
    parts = [
        F.struct(F.round(F.col(f) * w, 2).alias("contribution"), F.lit(-i).alias("_order"), F.lit(f).alias("feature")) for i,
        (f, w) in enumerate(SCORE_WEIGHTS.items())
    ]
    ordered = F.slice(F.sort_array(F.array(*parts), asc=False), 1, k)
    return F.transform(ordered, lambda p: F.struct(p["feature"].alias("feature"), p["contribution"].alias("contribution")))


def training_profile(samples: DataFrame, label: str) -> DataFrame:
    """``(label, n, mean_risk, mean_recent, mean_anomaly_rate)`` for each class."""
    return samples.groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("n"), F.round(F.avg(risk_score()), 2).alias("mean_risk"), F.round(F.avg("recent_mean"), 2).alias("mean_recent"),
        F.round(F.avg("anomaly_rate"), 2).alias("mean_anomaly_rate")
    )


def classifier_leaderboard(rows: DataFrame, label: str, predictions: list[str], positive: str = "high") -> DataFrame:
    """``(model, accuracy, precision, recall, f1, rank)`` of columns of predicted classes; by F1, then accuracy, then name."""
    out = None
    for name in predictions:
        p, y = F.col(name) == positive, F.col(label) == positive
        one = rows.agg(
            F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn")
        ).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    ratio = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 2), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    pr, re = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", F.coalesce(F.round(2 * pr * re / F.nullif(pr + re, F.lit(0.0)), 2), F.lit(0.0)))
    order = F.struct(-F.col("f1"), -F.col("accuracy"), F.col("model"))
    every = F.array_sort(F.collect_list(order))
    ranks = out.agg(every.alias("_all"))  # a row for each model
    return out.join(F.broadcast(ranks)).select(
        "model", "accuracy", "precision", "recall", "f1", F.array_position("_all", order).alias("rank")
    )


# --- series


def feature_profile(s: DataFrame, short: int = 3, long: int = 5) -> DataFrame:
    """``(key, latest, mean, short_mean, long_mean, short_deviation, recent_change, slope, variability)`` of each series, to two digits."""
    last = s.groupBy("key").agg(F.max("position").alias("_n"))
    v, back = F.col("value"), F.col("_n") - F.col("position")
    at = lambda k: F.max(F.when(back == k, v))
    out = s.join(last, "key").groupBy("key").agg(
        at(0).alias("latest"), F.avg(v).alias("mean"), F.avg(F.when(back < short, v)).alias("short_mean"), F.avg(F.when(back < long, v)).alias("long_mean"),
        F.coalesce(
            F.stddev_samp(F.when(back < short, v)), F.lit(0.0)
        ).alias("short_deviation"), F.coalesce(at(0) - at(1), F.lit(0.0)).alias("recent_change"),
        (
            (at(0) - F.max(F.when(F.col("position") == 1, v))) / F.greatest(F.max("_n") - 1, F.lit(1))
        ).alias("slope"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("variability"),
    )
    return out.select("key", *[F.round(c, 2).alias(c) for c in out.columns if c != "key"])


def fit_percent(rows: DataFrame, by: str, actual: str, predicted: str) -> DataFrame:
    """``(by, fit)``: explained variance in per cent; 100 where the actual values don't vary."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    spread = F.var_pop(a) * F.count(a)
    return rows.groupBy(by).agg(
        F.when(spread == 0, F.lit(100.0)).otherwise(
            F.round((1 - F.sum((a - p) * (a - p)) / F.nullif(spread, F.lit(0.0))) * 100, 2)
        ).alias("fit")
    )


def fit_category(r_squared: Column) -> Column:
    out = F.lit("poor")
    for least, name in reversed(FIT_CATEGORIES):
        out = F.when(r_squared >= least, name).otherwise(out)
    return out


def gauge_report(rows: DataFrame, gauge: str, x: str, y: str) -> DataFrame:
    """``(gauge, n, x_range, y_range, r2, slope, intercept, category)`` of a line through each gauge's values."""
    ranges = rows.groupBy(F.col(gauge).alias("gauge")).agg(
        F.round(F.max(x) - F.min(x), 3).alias("x_range"), F.round(F.max(y) - F.min(y), 3).alias("y_range")
    )
    lines = statistics.regression_line(rows.withColumnRenamed(gauge, "gauge"), "gauge", x, y)
    r2 = F.round("r2", 4)
    return ranges.join(lines, "gauge").select(
        "gauge", "n", "x_range", "y_range", r2.alias("r2"), "slope", "intercept", fit_category(r2).alias("category")
    )


# --- conformal intervals with propagated difficulty


def neighbour_difficulty(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, difficulty)``: the mean absolute residual of the in-neighbours that trained, zero without any. ``nodes`` has node, part, label and prediction."""
    known = nodes.where(F.col("part") == "train").select(
        F.col("node").alias("from_node"), F.abs(F.col("label") - F.col("prediction")).alias("_r")
    )
    mean = edges.select("from_node", "to_node").join(known, "from_node").groupBy(
        F.col("to_node").alias("node")
    ).agg(F.avg("_r").alias("_m"))
    return nodes.select("node").join(mean, "node", "left").select("node", F.coalesce("_m", F.lit(0.0)).alias("difficulty"))


def propagated_intervals(nodes: DataFrame, edges: DataFrame, weight: float = 0.3, alpha: float = 0.1) -> DataFrame:
    """The nodes that don't train with ``lower`` and ``upper``: quantiles of the calibrating nodes' scores in units of one plus the weighted difficulty, by type."""
    rows = nodes.join(neighbour_difficulty(nodes, edges), "node").withColumn("sigma", 1 + weight * F.col("difficulty"))
    scores = rows.where(F.col("part") == "calibration").select(
        "type", (F.abs(F.col("label") - F.col("prediction")) / F.col("sigma")).alias("score")
    )
    out = statistics.conformal_intervals(
        rows.where(F.col("part") != "train"), statistics.conformal_quantiles(scores, "type", "score", alpha), "type", "prediction", "sigma"
    )
    return out.select("node", "type", "part", "label", "lower", "upper")


def tuned_weights(
    nodes: DataFrame, edges: DataFrame, weights: list[float], alpha: float = 0.1, slack: float = 0.02, least: int = 10
) -> DataFrame:
    """``(type, weight)``: for each type the weight of the difficulty with the narrowest intervals that still cover.

    Half of the calibrating nodes, by a hash, give the quantiles and the others
    judge them; types with fewer than ``least`` nodes in a half have weight zero.
    Every node meets every weight of a short list.
    """
    rows = nodes.where(F.col("part") == "calibration").join(neighbour_difficulty(nodes, edges), "node")
    rows = rows.withColumn("_tune", F.pmod(F.crc32(F.col("node").cast("string").cast("binary")), F.lit(2)) == 0)
    tried = rows.withColumn(
        "weight", F.explode(F.array(*[F.lit(float(w)) for w in weights]))
    ).withColumn("sigma", 1 + F.col("weight") * F.col("difficulty"))
    tried = settle(
        tried.select(
            F.concat_ws("|", F.col("type").cast("string"), F.col("weight").cast("string")).alias("case"), "type", "weight", "sigma",
            "_tune", F.abs(F.col("label") - F.col("prediction")).alias("miss")
        ),
        "tuning"
    )
    q = statistics.conformal_quantiles(
        tried.where("_tune").select("case", (F.col("miss") / F.col("sigma")).alias("score")), "case", "score", alpha
    )
    half = tried.where(~F.col("_tune")).join(q.withColumnRenamed("n", "_n"), "case").withColumn(
        "_width", F.col("quantile") * F.col("sigma")
    )
    judged = half.groupBy("type", "weight").agg(
        F.avg((F.col("miss") <= F.col("_width")).cast("double")).alias("covered"), F.avg("_width").alias("width"), F.min("_n").alias("n")
    )
    good = judged.where((F.col("covered") >= 1 - alpha - slack) & (F.col("n") >= least))
    best = good.groupBy("type").agg(F.min_by("weight", F.struct(F.round("width", 9), "weight")).alias("weight"))
    return nodes.select("type").distinct().join(best, "type", "left").select("type", F.coalesce("weight", F.lit(0.0)).alias("weight"))


# --- pixels


def physical_loss(pixels: DataFrame, nir: str, red: str, blue: str) -> DataFrame:
    """One row: the mean distance of vegetation indices from what they can be (NDVI -1 to 1, EVI -0.2 to 1)."""
    n, r, b = (F.col(c) for c in (nir, red, blue))
    ndvi = equations.ndvi(n, r)
    evi = 2.5 * (n - r) / F.greatest(n + 6 * r - 7.5 * b + 1, F.lit(1e-6))
    outside = lambda v, low, high: F.greatest(low - v, F.lit(0.0)) + F.greatest(v - high, F.lit(0.0))
    return pixels.agg(((F.avg(outside(ndvi, -1.0, 1.0)) + F.avg(outside(evi, -0.2, 1.0))) / 2).alias("physical"))


def cloud_loss(pixels: DataFrame, logit: str, cloudy: str) -> DataFrame:
    """One row: binary cross-entropy of logits, in the form that does not overflow."""
    z, y = F.col(logit).cast("double"), F.col(cloudy).cast("double")
    return pixels.agg(F.avg(F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))).alias("cloud"))


def curriculum_weight(epoch: int, start: int = 0, ramp: int = 10) -> float:
    """Nothing before the start, then in a line to one."""
    return 0.0 if epoch < start else min(1.0, (epoch - start) / max(ramp, 1))


# Fixed values of the combined loss: weights next to the reconstruction's.
LOSS_WEIGHTS = {"nll": 0.1, "physical": 0.05, "smoothness": 0.01, "cloud": 0.01}


def combined_loss(losses: DataFrame, epoch: int, start: int = 0, ramp: int = 10) -> DataFrame:
    """Rows with ``total``: the reconstruction's ``l1`` and the other losses that are there, weighted and ramped up over the epochs."""
    w = curriculum_weight(epoch, start, ramp)
    more = sum((F.lit(w * v) * F.coalesce(F.col(k), F.lit(0.0)) for k, v in LOSS_WEIGHTS.items() if k in losses.columns), F.lit(0.0))
    return losses.withColumn("total", F.col("l1") + more)


def kept_by_uncertainty(pixels: DataFrame, sigma: str, error: str, shares: list[float]) -> DataFrame:
    """``(share, threshold, rmse, n)``: of the least uncertain share of pixels, those with the threshold's value included, the error that is left."""
    ranks = value_ranks(pixels, [], sigma)
    sums = pixels.groupBy(sigma).agg(F.sum(F.col(error) * F.col(error)).alias("_s"))
    total = ranks.agg(F.sum("n").alias("_all"))
    wanted = total.select("_all", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    wanted = wanted.withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_all") * F.col("share"))))
    holds = (F.col("before") < F.col("_k")) & (F.col("_k") <= F.col("before") + F.col("n"))
    marks = ranks.join(F.broadcast(wanted), holds).select("share", F.col(sigma).alias("threshold"))  # a row for each share
    per = ranks.join(sums, sigma).join(F.broadcast(marks), F.col(sigma) <= F.col("threshold"))
    return per.groupBy("share", "threshold").agg(F.sqrt(F.sum("_s") / F.sum("n")).alias("rmse"), F.sum("n").alias("n"))


# --- tables of formulas


def gravity_table(rows: DataFrame, origin: str, destination: str, cost: str, **options: float) -> DataFrame:
    """Rows with ``gravity``, the interaction of two masses over a cost."""
    return rows.withColumn("gravity", equations.gravity_interaction(F.col(origin), F.col(destination), F.col(cost), **options))


def service_table(rows: DataFrame, predictors: list[str], coefficients: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """Rows with ``service``, the logistic probability of their predictors."""
    return rows.withColumn("service", equations.logistic_probability({p: F.col(p) for p in predictors}, coefficients, intercept))


def accessibility_table(rows: DataFrame, key: str, supply: str, cost: str, method: str = "power", **options: float) -> DataFrame:
    """``(key, accessibility, n)``: the decayed supplies of each key, from a row for each supply."""
    return rows.groupBy(key).agg(
        F.sum(F.col(supply) * equations.decay(F.col(cost), method, **options)).alias("accessibility"), F.count("*").alias("n")
    )
