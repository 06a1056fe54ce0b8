"""Estimates from sums of products against NumPy on whole columns, and rank tests against plain Python."""

import math
import random

import numpy as np
import pytest

from ravelin.operators import estimators, ranking


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 800
    x = rng.normal(size=(n, 2)) * [1.0, 4.0] + [0.0, 10.0]
    t = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.1 * (x[:, 1] - 10))))).astype(int)
    y = 2.0 * t + 1.5 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n)
    rows = [(i, int(t[i]), float(y[i]), float(x[i, 0]), float(x[i, 1]), i % 3) for i in range(n)]
    frame = spark.createDataFrame([*rows, (n, 1, None, 0.0, 1.0, 0)], "id long, t int, y double, a double, b double, g int").cache()
    return frame, t, y, x


def ols(design, y):
    return np.linalg.lstsq(design, y, rcond=None)[0]


def shares(t, x, train=None):
    """Ridge logistic regression on standardised columns, by plain Newton steps."""
    z = np.column_stack([np.ones(len(t)), (x - x.mean(0)) / x.std(0)])
    zt, tt = (z, t) if train is None else (z[train], t[train])
    beta, ridge = np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-zt @ beta))
        beta = beta + np.linalg.solve((zt * (p * (1 - p))[:, None]).T @ zt + ridge, zt.T @ (tt - p) - ridge @ beta)
    return np.clip(1 / (1 + np.exp(-z @ beta)), 0.01, 0.99)


def pseudo(t, y, m1, m0, p):
    return m1 - m0 + t * (y - m1) * np.minimum(20, 1 / p) - (1 - t) * (y - m0) * np.minimum(20, 1 / (1 - p))


def test_regression(data):
    frame, t, y, x = data
    design = np.column_stack([np.ones(len(t)), t, x])
    beta = ols(design, y)
    rest = y - design @ beta
    se = math.sqrt(rest @ rest / (len(t) - 4) * np.linalg.inv(design.T @ design)[1, 1])
    got = estimators.regression_adjustment(frame, "t", "y", ["a", "b"]).first()
    assert (got["effect"], got["se"], got["n"]) == (pytest.approx(beta[1]), pytest.approx(se), 800)
    assert estimators.single_learner(frame, "t", "y", ["a", "b"]).first()["cate"] == pytest.approx(beta[1])
    per = {r["subgroup"]: r["effect"] for r in estimators.subgroup_effects(frame, "g", "t", "y", ["a", "b"]).collect()}
    for g in range(3):
        assert per[str(g)] == pytest.approx(ols(design[g::3], y[g::3])[1])


def test_weighting_and_double_robustness(data):
    frame, t, y, x = data
    p = shares(t, x)
    w = np.minimum(20, np.where(t == 1, 1 / p, 1 / (1 - p)))
    want = np.average(y[t == 1], weights=w[t == 1]) - np.average(y[t == 0], weights=w[t == 0])
    assert estimators.inverse_weighting(frame, "t", "y", ["a", "b"]).first()["effect"] == pytest.approx(want, abs=1e-6)
    one = np.column_stack([np.ones(len(t)), x])
    score = pseudo(t, y, one @ ols(one[t == 1], y[t == 1]), one @ ols(one[t == 0], y[t == 0]), p)
    got = estimators.doubly_robust(frame, "t", "y", ["a", "b"]).first()
    assert (got["effect"], got["se"]) == (
        pytest.approx(score.mean(), abs=1e-6), pytest.approx(score.std(ddof=1) / math.sqrt(len(t)), abs=1e-6)
    )


def test_cross_fitting(data, spark):
    from pyspark.sql import functions as F

    frame, t, y, x = data
    fold = np.array(
        [r["f"] for r in frame.where("y is not null").orderBy("id").select(F.pmod(F.xxhash64("id"), F.lit(4)).alias("f")).collect()]
    )
    one, score = np.column_stack([np.ones(len(t)), x]), np.zeros(len(t))
    for k in range(4):
        train, own = fold != k, fold == k
        m1, m0 = (one @ ols(one[train & (t == a)], y[train & (t == a)]) for a in (1, 0))
        score[own] = pseudo(t, y, m1, m0, shares(t, x, train))[own]
    assert estimators.cross_fitted(frame, "t", "y", ["a", "b"], "id", 4).first()["effect"] == pytest.approx(score.mean(), abs=1e-6)


def test_ranks(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(20)) for _ in range(300)] + [("c", 5), ("a", None)]
    got = ranking.value_ranks(spark.createDataFrame(rows, "k string, v int"), ["k"], "v").collect()
    for r in got:
        own = [v for k, v in rows if k == r["k"] and v is not None]
        assert (r["n"], r["before"]) == (own.count(r["v"]), sum(v < r["v"] for v in own))
    assert len(got) == len({x for x in rows if x[1] is not None})
    assert ranking.value_ranks(spark.createDataFrame([], "k string, v int"), ["k"], "v").isEmpty()
