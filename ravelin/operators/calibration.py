"""Diagnostics of intervals, rasters of uncertainty, and tests of independence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.equations import normal_two_sided


def _inside(label: str) -> Column:
    return F.col(label).between(F.col("lower"), F.col("upper")).cast("double")


def percentile_bins(df: DataFrame, value: str, n: int, name: str = "bin") -> DataFrame:
    """Rows with the number of their bin between ``n - 1`` interpolated percentiles; edges belong to the upper bin."""
    edges = df.agg(F.percentile(value, F.array(*[F.lit(k / n) for k in range(1, n)])).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e <= F.col(value)))
    return df.join(F.broadcast(edges)).withColumn(name, below.cast("long")).drop("_edges")  # one row of edges


def coverage_by_bin(rows: DataFrame, label: str, by: str, n: int = 10) -> DataFrame:
    """``(bin, coverage, mean_by, n)`` over percentile bins of a column: width, feature, degree or sigma."""
    return percentile_bins(rows, by, n).groupBy("bin").agg(
        F.avg(_inside(label)).alias("coverage"), F.avg(by).alias("mean_by"), F.count("*").alias("n")
    )


def calibration_error(rows: DataFrame, label: str, target: float, n: int = 10) -> DataFrame:
    """One row: the weighted distance of coverage from the target over bins of width."""
    bins = coverage_by_bin(rows.withColumn("_width", F.col("upper") - F.col("lower")), label, "_width", n)
    return bins.agg((F.sum(F.abs(F.col("coverage") - target) * F.col("n")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def expected_coverage(rows: DataFrame, score: str, split: Column, levels: list[float]) -> DataFrame:
    """``(level, actual)``: the share of other rows whose score lies under the quantile of the calibration rows."""
    q = rows.where(split).agg(F.percentile(score, F.array(*[F.lit(v) for v in levels])).alias("_q"))
    rest = rows.where(~split).join(F.broadcast(q))  # one row of quantiles
    out = rest.agg(*[F.avg((F.col(score) <= F.col("_q")[k]).cast("double")).alias(f"l{k}") for k in range(len(levels))])
    return out.select(
        F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"l{k}").alias("actual")) for k, v in enumerate(levels)])).alias("x")
    ).select("x.*")


def pinball_loss(prediction: Column, target: Column, tau: float) -> Column:
    miss = target - prediction
    return F.greatest(tau * miss, (tau - 1) * miss)


def cqr_scores(low: Column, high: Column, label: Column, sigma: Column | None = None) -> Column:
    """How far a label lies outside its quantiles, negative inside, in units of sigma."""
    out = F.greatest(low - label, label - high)
    return out / sigma if sigma is not None else out


def ensemble(members: DataFrame, node: str, prediction: str) -> DataFrame:
    """``(node, mean, variance)`` over the members' predictions."""
    return members.groupBy(node).agg(F.avg(prediction).alias("mean"), F.var_pop(prediction).alias("variance"))


def feature_attribution(rows: DataFrame, sigma: str, features: list[str], top: int = 5) -> DataFrame:
    """The features with the strongest correlation to sigma: ``(feature, correlation)``."""
    found = rows.agg(F.array(*[F.struct(F.lit(f).alias("feature"), F.corr(sigma, f).alias("correlation")) for f in features]).alias("x"))
    return found.select(F.explode("x").alias("x")).select("x.*").orderBy(F.desc_nulls_last(F.abs("correlation")), "feature").limit(top)


def runs_test(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``(key, runs, n_above, n_below, expected, z, p_value)`` of each key's ordered values, at or above their median and below.

    With fewer than ten values, or values on one side only, there is no z and the
    p-value is one.
    """
    middle = rows.groupBy(key).agg(F.median(value).alias("_m"))
    w = Window.partitionBy(key).orderBy(*order)
    r = rows.join(middle, key).withColumn("_up", F.col(value) >= F.col("_m"))
    r = r.withColumn("_new", F.coalesce((F.lag("_up").over(w) != F.col("_up")).cast("int"), F.lit(1)))
    out = r.groupBy(key).agg(F.sum("_new").alias("runs"), F.count_if("_up").alias("n_above"), F.count_if(~F.col("_up")).alias("n_below"))
    a, b = F.col("n_above").cast("double"), F.col("n_below").cast("double")
    n = a + b
    expected = 1 + 2 * a * b / n
    variance = 2 * a * b * (2 * a * b - n) / (n * n * F.nullif(n - 1, F.lit(0.0)))
    tested = (n >= 10) & (F.col("n_above") > 0) & (F.col("n_below") > 0)
    z = F.when(tested, (F.col("runs") - expected) / F.sqrt(F.greatest(variance, F.lit(1e-12))))
    return out.withColumns(
        {"expected": F.when(tested, expected).otherwise(F.lit(0.0)), "z": z, "p_value": F.coalesce(normal_two_sided(z), F.lit(1.0))}
    )


def morans_i(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row of Moran's I for ``values(id, value)`` over neighbours ``pairs(left_id, right_id)``, with z for variance 1 / (n - 1)."""
    mean = values.agg(F.avg("value").alias("_m"), F.count("*").alias("_n"), F.var_pop("value").alias("_v"))
    centred = values.join(F.broadcast(mean)).select("id", (F.col("value") - F.col("_m")).alias("c"))  # one row of moments
    met = pairs.join(centred.toDF("left_id", "a"), "left_id").join(centred.toDF("right_id", "b"), "right_id")
    sums = met.agg(F.sum(F.col("a") * F.col("b")).alias("s"), F.count("*").alias("w"))
    out = sums.join(F.broadcast(mean))
    i = F.col("s") / F.col("w") / F.nullif(F.col("_v"), F.lit(0.0))
    return out.select(i.alias("moran"), ((i + 1 / (F.col("_n") - 1)) * F.sqrt(F.col("_n") - 1)).alias("z"))


def coverage_curve(rows: DataFrame, error: str, sigma: str, shares: list[float], buckets: int = 1000) -> DataFrame:
    """``(share, rmse, n)``: errors of the rows with the least sigma, for each share of rows that is kept.

    Rows are first counted in percentile buckets of sigma, so no task sorts them all.
    """
    binned = percentile_bins(rows, sigma, buckets).groupBy("bin").agg(
        F.sum(F.pow(F.col(error), F.lit(2.0))).alias("s"), F.count("*").alias("n")
    )
    w = Window.orderBy("bin")  # at most as many rows as buckets
    total = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = binned.select("bin", F.sum("s").over(w).alias("s"), F.sum("n").over(w).alias("n"), F.sum("n").over(total).alias("all"))
    every = cum.select(
        "*", F.explode(F.array(*[F.lit(v) for v in shares])).alias("share")
    ).where(F.col("n") >= F.col("share") * F.col("all"))
    best = every.groupBy("share").agg(F.min_by(F.struct("s", "n"), "n").alias("x"))
    return best.select("share", F.sqrt(F.col("x.s") / F.col("x.n")).alias("rmse"), F.col("x.n").alias("n"))


# --- rasters in long form: (patch, t, y, x, value)


def cloud_frequency(masks: DataFrame, pixel: list[str], cloudy: str, threshold: float = 0.8, temperature: float = 10.0) -> DataFrame:
    """Share of cloudy times of each pixel, whether it is void, and how far it can be known."""
    out = masks.groupBy(*pixel).agg(F.avg(F.col(cloudy).cast("double")).alias("frequency"))
    return out.withColumns(
        {"void": F.col("frequency") > threshold, "knowability": 1 / (1 + F.exp(-temperature * (threshold - F.col("frequency"))))}
    )


def masked_losses(pixels: DataFrame, prediction: str, target: str, sigma: str, mask: str) -> DataFrame:
    """Absolute error and Gaussian negative log likelihood over the pixels of a mask."""
    m, e, s = F.col(mask).cast("double"), F.col(prediction) - F.col(target), F.col(sigma)
    n = F.nullif(F.sum(m), F.lit(0.0))
    return pixels.agg((F.sum(F.abs(e) * m) / n).alias("l1"), (F.sum((e * e / (2 * s * s) + F.log(s)) * m) / n).alias("nll"))


def smoothness_loss(pixels: DataFrame, pixel: list[str], time: str, value: str) -> DataFrame:
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*pixel).orderBy(time))
    return pixels.select(step.alias("d")).agg(F.avg(F.col("d") * F.col("d")).alias("smoothness"))
