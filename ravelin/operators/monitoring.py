"""What a monitoring service asks for: feature lists, recent observations, rollups, exports.

``features(feature_id, category, region, x, y)``, ``observations(observation_id,
feature_id, observed_at, metric, value, status)`` and ``thresholds(feature_id,
metric, low, high)`` are DataFrames; optional filters are added only when given,
so that they can be pushed down to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.equations import alert_score, threshold_status

FALLBACK_SCORES = {"alert": 1.0, "offline": 0.8, "normal": 0.2}


def in_time(observations: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Observations from a start to an end, both inclusive."""
    kind = observations.schema["observed_at"].dataType
    if start is not None:
        observations = observations.where(F.col("observed_at") >= F.lit(start).cast(kind))
    if end is not None:
        observations = observations.where(F.col("observed_at") <= F.lit(end).cast(kind))
    return observations


def latest_observations(observations: DataFrame) -> DataFrame:
    """The newest row of each feature, ties by the greater id."""
    newest = F.max_by(
        F.struct(*[c for c in observations.columns if c != "feature_id"]), F.struct("observed_at", "observation_id")
    ).alias("x")
    return observations.groupBy("feature_id").agg(newest).select("feature_id", "x.*")


def with_status(features: DataFrame, observations: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Features with their latest value and the status and score that it gives; limits of another metric don't count."""
    last = latest_observations(observations).select("feature_id", "metric", "value", F.col("status").alias("_status"), "observed_at")
    limits = thresholds.select("feature_id", F.col("metric").alias("_metric"), "low", "high")
    out = features.join(last, "feature_id", "left").join(limits, "feature_id", "left")
    same = F.col("_metric") == F.col("metric")
    low, high = F.when(same, F.col("low")), F.when(same, F.col("high"))
    status = F.when(
        F.col("value").isNull(), F.coalesce("_status", F.lit("normal"))
    ).otherwise(threshold_status(F.col("value"), low, high, F.col("_status")))
    fallback = F.lit(0.0)
    for name, score in FALLBACK_SCORES.items():
        fallback = F.when(F.col("status") == name, F.lit(score)).otherwise(fallback)
    out = out.withColumns({"status": status, "_low": low, "_high": high})
    return out.withColumn(
        "alert_score", alert_score(F.col("value"), F.col("_low"), F.col("_high"), fallback)
    ).drop("_status", "_metric", "_low", "_high", "low", "high")


def list_features(
    features: DataFrame, category: str | None = None, region: str | None = None, status: str | None = None,
    bbox: tuple[float, float, float, float] | None = None, exact_case: bool = False
) -> DataFrame:
    """Features that pass the filters given; names compare without case unless asked otherwise."""
    same = (lambda c, v: F.col(c) == v) if exact_case else (lambda c, v: F.lower(c) == v.lower())
    for column, wanted in (("category", category), ("region", region)):
        if wanted is not None:
            features = features.where(same(column, wanted))
    if status is not None:
        features = features.where(F.lower("status") == status.lower())
    if bbox is not None:
        if len(bbox) != 4 or bbox[0] > bbox[2] or bbox[1] > bbox[3]:
            raise ValueError("a box has a lower and an upper corner")
        features = features.where(F.col("x").between(bbox[0], bbox[2]) & F.col("y").between(bbox[1], bbox[3]))
    return features


def recent_observations(
    observations: DataFrame, limit: int = 5, feature_id=None, start: str | None = None, end: str | None = None
) -> DataFrame:
    rows = in_time(observations, start, end)
    if feature_id is not None:
        rows = rows.where(F.col("feature_id") == feature_id)
    return rows.orderBy(F.desc("observed_at"), F.desc("observation_id")).limit(limit)


def recent_per_feature(observations: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("feature_id").orderBy(F.desc("observed_at"), F.desc("observation_id"))
    return observations.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def summary(features: DataFrame) -> DataFrame:
    """Counts by category, by status and by region, from one pass: ``(kind, name, n)``."""
    rows = features.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("name"))
                    for c in ("category", "status", "region")
                ]
            )
        ).alias("x")
    )
    return rows.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def operations_summary(features: DataFrame, observations: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """By region: features, those in alert, alert observations in the time asked for, and the rate of alerts."""
    seen = in_time(observations, start, end).where(F.col("status") == "alert").groupBy("feature_id").agg(F.count("*").alias("_alerts"))
    out = features.join(seen, "feature_id", "left").groupBy("region").agg(
        F.count("*").alias("n_features"), F.count_if(F.col("status") == "alert").alias("n_alert_features"),
        F.coalesce(F.sum("_alerts"), F.lit(0)).alias("n_alerts")
    )
    return out.withColumn("alert_rate", F.round(F.col("n_alert_features") / F.col("n_features"), 4))


def export_observations(
    observations: DataFrame, features: DataFrame, thresholds: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Observations of the given features with attributes and limits, missing text as empty."""
    rows = in_time(observations, start, end).join(features.select("feature_id"), "feature_id", "left_semi")
    limits = thresholds.select("feature_id", F.col("metric").alias("_metric"), "low", "high")
    out = rows.join(features.select("feature_id", "category", "region"), "feature_id", "left").join(limits, "feature_id", "left")
    same = F.col("_metric") == F.col("metric")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return out.select(
        "observation_id", "feature_id", text(F.col("category")).alias("category"), text(F.col("region")).alias("region"), "observed_at",
        "metric", "value", "status", text(F.when(same, F.col("low"))).alias("low"), text(F.when(same, F.col("high"))).alias("high")
    )


def upsert_thresholds(thresholds: DataFrame, changes: DataFrame) -> DataFrame:
    """Limits with those of ``changes`` put in or replaced, by feature and metric."""
    return thresholds.join(changes, ["feature_id", "metric"], "left_anti").unionByName(changes)
