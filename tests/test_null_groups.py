"""Null groups are groups in quantiles and intervals."""

import numpy as np

from ravelin.operators import ranking, statistics


def test_quantiles_and_intervals_of_a_null_group(spark):
    rows = [(g, float(k * k % 37)) for g in (None, "a") for k in range(40 if g else 25)]
    scores = spark.createDataFrame(rows, "g string, s double")
    found = statistics.conformal_quantiles(scores, "g", "s", 0.1)
    got = {r["g"]: (r["quantile"], r["n"]) for r in found.collect()}
    for g in (None, "a"):
        own = [s for k, s in rows if k == g]
        level = min(1.0, np.ceil((len(own) + 1) * 0.9) / len(own))
        assert got[g] == (np.quantile(own, level), len(own))
    wanted = spark.createDataFrame([(None, 1.0), ("a", 2.0), ("b", 3.0)], "g string, p double")
    intervals = {r["g"]: (r["lower"], r["upper"]) for r in statistics.conformal_intervals(wanted, found, "g", "p").collect()}
    assert intervals[None] == (1.0 - got[None][0], 1.0 + got[None][0]) and intervals["a"] == (2.0 - got["a"][0], 2.0 + got["a"][0])
    assert intervals["b"] == (float("-inf"), float("inf"))


def test_quantile_without_keys(spark):
    df = spark.createDataFrame([(float(k),) for k in range(11)], "v double")
    ranks = ranking.value_ranks(df, [], "v")
    assert ranking.quantile_at(ranks, [], "v", ranking.F.lit(0.25)).first()["quantile"] == 2.5
