"""Ratings as ordered folds, seeded simulations, and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def elo_ratings(matches: DataFrame, league: str, order: list[str], start: float = 1500.0, k: float = 20.0) -> DataFrame:
    """``(league, team, rating, played)`` after all matches of ``(home, away, home_score, away_score)``.

    Every rating depends on the ones before, so a league is one ordered fold over
    sorted batches, which holds the ratings and no matches; leagues are spread over
    tasks. Ratings are rounded to a tenth after each match.
    """
    types = dict(matches.dtypes)
    sorted_matches = matches.repartition(F.col(league)).sortWithinPartitions(league, *order).select(
        F.col(league).alias("league"), "home", "away", "home_score", "away_score"
    )

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rating, played = None, {}, {}

        def standings() -> pd.DataFrame:
            return pd.DataFrame(
                {
                    "league": [now] * len(rating), "team": list(rating), "rating": list(rating.values()),
                    "played": [played[t] for t in rating]
                }
            )

        for pdf in frames:
            for row in pdf.itertuples(index=False):
                if row.league != now:
                    if rating:
                        yield standings()
                    now, rating, played = row.league, {}, {}
                a, b = rating.get(row.home, start), rating.get(row.away, start)
                diff = row.home_score - row.away_score
                expected = 1 / (1 + 10 ** ((b - a) / 400))
                won = 0.5 if diff == 0 else float(diff > 0)
                step = k * (np.log(abs(diff) + 1) * 2.2 / (0.001 * abs(diff) + 2.2) if diff else 1.0) * (won - expected)
                rating[row.home], rating[row.away] = round(a + step, 1), round(b - step, 1)
                for team in (row.home, row.away):
                    played[team] = played.get(team, 0) + 1
        if rating:
            yield standings()

    return sorted_matches.mapInPandas(fold, f"league {types[league]}, team {types['home']}, rating double, played long")


def team_table(matches: DataFrame) -> DataFrame:
    """``(team, wins, draws, losses, scored, conceded)`` from both sides of each match."""
    sides = [("home", "home_score", "away_score"), ("away", "away_score", "home_score")]
    rows = None
    for team, own, other in sides:
        side = matches.select(F.col(team).alias("team"), F.col(own).alias("own"), F.col(other).alias("other"))
        rows = side if rows is None else rows.unionByName(side)
    return rows.groupBy("team").agg(
        F.count_if(F.col("own") > F.col("other")).alias("wins"), F.count_if(F.col("own") == F.col("other")).alias("draws"),
        F.count_if(F.col("own") < F.col("other")).alias("losses"), F.sum("own").alias("scored"), F.sum("other").alias("conceded")
    )


def simulate(spark: SparkSession, problems: DataFrame, n_sims: int, seed: int = 1) -> DataFrame:
    """``(problem, mean, p10, p90)`` of Poisson score differences for rows ``(problem, home_rate, away_rate)``.

    Each problem has its own seeded generator, so results don't depend on partitions.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                g = np.random.default_rng([seed, int(r.problem)])
                diff = np.sort(g.poisson(r.home_rate, n_sims) - g.poisson(r.away_rate, n_sims))
                rows.append((r.problem, float(diff.mean()), float(diff[int(0.1 * (n_sims - 1))]), float(diff[int(0.9 * (n_sims - 1))])))
            yield pd.DataFrame(rows, columns=["problem", "mean", "p10", "p90"])

    return problems.select(
        F.col("problem").cast("long").alias("problem"), "home_rate", "away_rate"
    ).mapInPandas(run, "problem long, mean double, p10 double, p90 double")


def bootstrap_interval(
    rows: DataFrame, group: str, value: str, n_resamples: int = 500, seed: int = 42, level: float = 0.95, buckets: int = 512
) -> DataFrame:
    """``(group, lower, upper)`` of the mean by a Poisson bootstrap over hashed buckets.

    Rows are first added up into a fixed number of buckets for each group, which
    are then resampled, so a task gets at most ``buckets`` rows of a group.
    """
    types = dict(rows.dtypes)
    known = rows.where(F.col(value).isNotNull())
    small = known.groupBy(
        F.col(group).alias("g"), F.pmod(F.xxhash64(*rows.columns), F.lit(buckets)).alias("bucket")
    ).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("c"))

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        w = np.random.default_rng(seed).poisson(1.0, (n_resamples, len(pdf)))
        means = (w @ pdf["s"].to_numpy()) / np.maximum(w @ pdf["c"].to_numpy(), 1)
        low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "lower": [low], "upper": [high]})

    return small.groupBy("g").applyInPandas(resample, f"g {types[group]}, lower double, upper double").withColumnRenamed("g", group)
