"""Fitted models: autoregression by key, propensities, and synthetic controls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_tail(series: DataFrame, validation: int, test: int) -> DataFrame:
    """Rows ``(key, position, value)`` with ``part``: the last are for test, those before for validation."""
    last = series.groupBy("key").agg(F.max("position").alias("_last"))
    back = F.col("_last") - F.col("position")
    return series.join(last, "key").withColumn(
        "part", F.when(back < test, "test").when(back < test + validation, "validation").otherwise("train")
    ).drop("_last")


def _fit_ar(values: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """Intercept and coefficients by least squares, and the residuals' standard deviation."""
    rows = len(values) - order
    x = np.column_stack([np.ones(rows), *[values[order - k : order - k + rows] for k in range(1, order + 1)]])
    y = values[order:]
    w = np.linalg.lstsq(x, y, rcond=None)[0]
    return w, float(np.std(y - x @ w, ddof=1)) if rows > 1 else 0.0


def _forecast(values: np.ndarray, w: np.ndarray, steps: int, noise: np.ndarray | None = None) -> np.ndarray:
    order, out = len(w) - 1, list(values[-(len(w) - 1) :])
    for s in range(steps):
        step = w[0] + sum(w[k] * out[-k] for k in range(1, order + 1))
        out.append(step + (noise[s] if noise is not None else 0.0))
    return np.array(out[order:])


def autoregression(series: DataFrame, holdout: int, orders: list[int], paths: int = 250, seed: int = 7) -> DataFrame:
    """``(key, order, pmse, step, forecast, p10, median, p90)``: the order with the least error over a holdout, and paths from there.

    A key's series is one group and has to fit into a task; keys are spread.
    Series too short for an order leave it out, and those too short for all have
    no rows.
    """
    kind = dict(series.dtypes)["key"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("position")["value"].to_numpy(float)
        train, tail = values[:-holdout], values[-holdout:]
        tried = []
        for order in orders:
            if len(train) > 2 * order + 1:
                guess = _forecast(train, _fit_ar(train, order)[0], holdout)
                tried.append((round(float(np.mean((guess - tail) ** 2)), 4), order))
        pmse, order = min(tried)
        w, sd = _fit_ar(values, order)
        rng = np.random.default_rng(seed)
        runs = np.sort([_forecast(values, w, holdout, rng.normal(0.0, sd, holdout)) for _ in range(paths)], axis=0)
        at = lambda q: runs[int(q * (paths - 1))]
        return pd.DataFrame(
            {
                "key": pdf["key"].iloc[0], "order": order, "pmse": pmse, "step": range(1, holdout + 1),
                "forecast": _forecast(values, w, holdout), "p10": at(0.1), "median": at(0.5), "p90": at(0.9)
            }
        )

    enough = series.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") - holdout > 2 * min(orders) + 1)
    return series.join(enough.select("key"), "key", "left_semi").groupBy("key").applyInPandas(
        fit, f"key {kind}, order long, pmse double, step long, forecast double, p10 double, median double, p90 double"
    )


def logistic_propensity(rows: DataFrame, treatment: str, covariates: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows with ``propensity`` from an L2 logistic model of the standardised covariates, clipped; fitted by Spark's own optimiser."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    moments = rows.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in covariates],
        *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{c}") for c in covariates], F.count("*").alias("_n")
    )
    n = moments.first()["_n"]
    scaled = rows.dropna(subset=[treatment, *covariates]).join(F.broadcast(moments))  # one row of moments
    scaled = scaled.withColumns(
        {f"_z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in covariates}
    ).withColumn("_y", F.col(treatment).cast("double"))
    points = VectorAssembler(inputCols=[f"_z_{c}" for c in covariates], outputCol="_x").transform(scaled)
    model = LogisticRegression(
        featuresCol="_x", labelCol="_y", regParam=1.0 / max(n, 1), standardization=False, maxIter=100, tol=1e-8, probabilityCol="_p",
        rawPredictionCol="_r", predictionCol="_k"
    ).fit(points)
    p = vector_to_array(F.col("_p"))[1]
    return model.transform(points).withColumn(
        "propensity", F.greatest(F.lit(low), F.least(F.lit(high), p))
    ).select(*rows.columns, "propensity")


def synthetic_control(panel: DataFrame, unit: str, time: str, value: str, treated, start, steps: int = 4000) -> DataFrame:
    """``(time, observed, synthetic, gap)``: the treated unit against a convex mix of the others.

    Weights minimise squares before ``start`` by projected gradient on the
    simplex. The panel is pivoted to one row a time in Spark; only the sums of
    products before the start, as many as pairs of units, come to the driver.
    """
    units = sorted(r[0] for r in panel.select(unit).distinct().collect())
    donors = [u for u in units if u != treated]
    wide = panel.groupBy(time).pivot(unit, units).agg(F.avg(value)).dropna()
    col = {u: F.col(f"`{u}`") for u in units}
    before = wide.where(F.col(time) < start)
    sums = before.agg(
        *[F.sum(col[a] * col[b]).alias(f"{i}_{j}") for i, a in enumerate(donors) for j, b in enumerate(donors)],
        *[F.sum(col[a] * col[treated]).alias(f"y_{i}") for i, a in enumerate(donors)]
    ).first()
    gram = np.array([[sums[f"{i}_{j}"] or 0.0 for j in range(len(donors))] for i in range(len(donors))], float)
    cross = np.array([sums[f"y_{i}"] or 0.0 for i in range(len(donors))], float)
    w = np.full(len(donors), 1 / len(donors))
    rate = 1 / (np.linalg.norm(gram, 2) or 1.0)
    for _ in range(steps):
        w = _to_simplex(w - rate * (gram @ w - cross))
    mix = sum((F.lit(float(x)) * col[u] for x, u in zip(w, donors, strict=True)), F.lit(0.0))
    return wide.select(
        time, col[treated].alias("observed"), mix.alias("synthetic")
    ).withColumn("gap", F.col("observed") - F.col("synthetic"))


def _to_simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    over = np.cumsum(u) - 1
    k = np.nonzero(u - over / np.arange(1, len(v) + 1) > 0)[0][-1]
    return np.maximum(v - over[k] / (k + 1), 0.0)
