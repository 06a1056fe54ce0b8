"""Series operators: rolling figures, detectors, forecasts and change points.

A series is rows of ``(key, position, value)``; windows are per key, so keys are
spread over tasks. Positions count from one without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``(key, position, value)`` from rows in a given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.select(F.col(key).alias("key"), F.row_number().over(w).cast("long").alias("position"), F.col(value).alias("value"))


def _w() -> Window:
    return Window.partitionBy("key").orderBy("position")


def rolling_mean(s: DataFrame, size: int) -> DataFrame:
    """Means of full windows only."""
    w = _w().rowsBetween(-(size - 1), 0)
    return s.withColumn("mean", F.avg("value").over(w)).where(F.col("position") >= size)


def differences(s: DataFrame) -> DataFrame:
    return s.withColumn("difference", F.col("value") - F.lag("value").over(_w())).where("position > 1")


def _safe(std: Column) -> Column:
    """A population standard deviation in which zero and none count one."""
    return F.coalesce(F.when(std > 0, std), F.lit(1.0))


def detector_scores(s: DataFrame, size: int = 5, warm_up: int = 5) -> DataFrame:
    """Scores of each value against strictly earlier ones: expanding and rolling z, and z of the change."""
    past, near = _w().rowsBetween(Window.unboundedPreceding, -1), _w().rowsBetween(-size, -1)
    s = s.withColumn("change", F.col("value") - F.lag("value").over(_w()))
    z = lambda c, w: (F.col(c) - F.avg(c).over(w)) / _safe(F.stddev_pop(c).over(w))
    out = s.withColumns({"z": z("value", past), "rolling_z": z("value", near), "change_z": z("change", past)})
    return out.where(F.col("position") > warm_up)


def mad_scores(s: DataFrame, size: int | None = None, warm_up: int = 5) -> DataFrame:
    """0.6745 |x - median| / MAD over all earlier values, or the last ``size`` of them; zero where MAD is zero."""
    start = Window.unboundedPreceding if size is None else -size
    middle = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, F.floor((F.size(a) + 2) / 2).cast("int"))) / 2
    s = s.withColumn("_past", F.array_sort(F.collect_list("value").over(_w().rowsBetween(start, -1)))).where(F.col("position") > warm_up)
    s = s.withColumn("_median", middle(F.col("_past")))
    s = s.withColumn("_mad", middle(F.array_sort(F.transform("_past", lambda v: F.abs(v - F.col("_median"))))))
    score = F.when(F.col("_mad") > 0, 0.6745 * F.abs(F.col("value") - F.col("_median")) / F.col("_mad")).otherwise(F.lit(0.0))
    return s.withColumn("mad_score", score).drop("_past", "_median", "_mad")


def anomalies(s: DataFrame, threshold: float = 2.5, size: int = 5, warm_up: int = 5) -> DataFrame:
    return detector_scores(s, size, warm_up).where(F.abs("rolling_z") >= threshold)


def detector_quality(flags: DataFrame, flag: str, truth: str) -> DataFrame:
    """Counts, precision, recall and F1; F1 from the rounded two."""
    counted = flags.agg(
        F.count_if(F.col(flag) & F.col(truth)).alias("tp"), F.count_if(F.col(flag) & ~F.col(truth)).alias("fp"),
        F.count_if(~F.col(flag) & F.col(truth)).alias("fn")
    )
    ratio = lambda a, b: F.when(F.col("tp") + F.col(b) > 0, F.round(F.col(a) / F.nullif(F.col("tp") + F.col(b), F.lit(0)), 2)).otherwise(F.lit(0.0))
    counted = counted.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})
    p, r = F.col("precision"), F.col("recall")
    return counted.withColumn("f1", F.when(p + r > 0, F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), 2)).otherwise(F.lit(0.0)))


def candidate_forecasts(s: DataFrame, size: int = 3, season: int = 4) -> DataFrame:
    """One-step forecasts of four candidates for every position with enough past."""
    w = _w()
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("position") - 1
    slope = (F.lag("value").over(w) - F.first("value").over(past)) / F.nullif(n - 1, F.lit(0))
    out = s.withColumns(
        {
            "last_value": F.lag("value").over(w), "trailing_mean": F.avg("value").over(w.rowsBetween(-size, -1)),
            "drift": F.lag("value").over(w) + slope, "seasonal_naive": F.lag("value", season).over(w)
        }
    )
    return out.where(F.col("position") > max(size, season, 2))


CANDIDATES = ("drift", "last_value", "seasonal_naive", "trailing_mean")


def leaderboard(s: DataFrame, holdout: int, size: int = 3, season: int = 4) -> DataFrame:
    """``(key, model, mae, rank)`` of the candidates over the last positions of each series, ties by name."""
    last = s.groupBy("key").agg(F.max("position").alias("last"))
    tail = candidate_forecasts(s, size, season).join(last, "key").where(F.col("position") > F.col("last") - holdout)
    errors = tail.groupBy("key").agg(*[F.round(F.avg(F.abs(F.col("value") - F.col(c))), 6).alias(c) for c in CANDIDATES])
    long = errors.unpivot("key", list(CANDIDATES), "model", "mae")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("mae", "model")).cast("long"))


def linear_trend(s: DataFrame) -> DataFrame:
    """Least-squares slope, intercept, fit and the forecast of the next position."""
    out = s.groupBy("key").agg(
        F.regr_slope("value", "position").alias("slope"), F.regr_intercept("value", "position").alias("intercept"),
        F.regr_r2("value", "position").alias("r2"), (F.max("position") + 1).alias("next_position")
    )
    return out.withColumn("forecast", F.col("intercept") + F.col("slope") * F.col("next_position"))


def change_point(s: DataFrame) -> DataFrame:
    """The split after which the mean differs most from the mean before, with two values on each side at least."""
    before, all_ = _w().rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("key")
    n, total = F.count("*").over(all_), F.sum("value").over(all_)
    sums = s.withColumns({"_n": n, "_sum": F.sum("value").over(before), "_total": total})
    sums = sums.where((F.col("position") >= 2) & (F.col("_n") - F.col("position") >= 2))
    shift = (F.col("_total") - F.col("_sum")) / (F.col("_n") - F.col("position")) - F.col("_sum") / F.col("position")
    best = sums.withColumn("shift", shift).groupBy("key").agg(
        F.max_by(F.struct("position", "shift"), F.struct(F.round(F.abs("shift"), 6), -F.col("position"))).alias("b")
    )
    return best.select("key", F.col("b.position").alias("position"), F.col("b.shift").alias("shift"))


def autocorrelation(s: DataFrame, lags: int) -> DataFrame:
    """``(key, lag, acf)`` for lags one to ``lags``, over the series' own mean and sum of squares."""
    centred = s.withColumn("c", F.col("value") - F.avg("value").over(Window.partitionBy("key")))
    terms = [(F.col("c") * F.lag("c", k).over(_w())).alias(f"l{k}") for k in range(1, lags + 1)]
    sums = centred.select("key", "c", *terms).groupBy("key").agg(
        F.sum(F.col("c") * F.col("c")).alias("v"), *[F.sum(f"l{k}").alias(f"l{k}") for k in range(1, lags + 1)]
    )
    long = sums.select(
        "key",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("lag"), (F.coalesce(F.col(f"l{k}"), F.lit(0.0)) / F.nullif(F.col("v"), F.lit(0.0))).alias("acf")
                    )
                    for k in range(1, lags + 1)
                ]
            )
        ).alias("x")
    )
    return long.select("key", F.col("x.lag").cast("long").alias("lag"), F.coalesce("x.acf", F.lit(0.0)).alias("acf"))


def seasonal_profile(s: DataFrame, season: int) -> DataFrame:
    """``(key, phase, mean, n)`` by position within the season."""
    return s.groupBy("key", ((F.col("position") - 1) % season).alias("phase")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def volatility(s: DataFrame) -> DataFrame:
    return differences(s).groupBy("key").agg(F.stddev_samp("difference").alias("volatility"))


def partial_autocorrelation(acf: DataFrame) -> DataFrame:
    """``(key, lag, pacf)`` from ``(key, lag, acf)`` by the Levinson-Durbin recursion; lags are few for each key."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = [1.0, *pdf.sort_values("lag")["acf"]]
        phi: list[float] = []
        out = []
        for k in range(1, len(r)):
            rest = 1 - sum(p * r[j + 1] for j, p in enumerate(phi))
            last = (r[k] - sum(p * r[k - 1 - j] for j, p in enumerate(phi))) / rest if rest else 0.0
            phi = [p - last * phi[k - 2 - j] for j, p in enumerate(phi)] + [last]
            out.append(last)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "lag": range(1, len(r)), "pacf": out})

    return acf.groupBy("key").applyInPandas(one, f"key {dict(acf.dtypes)['key']}, lag long, pacf double")
