"""Causal estimates with covariates from sums of products.

A least-squares fit needs only the sums of products of its columns, which one
aggregation finds over all rows; the equations, as many as there are columns,
are solved with the driver. Sums can be added and taken away, so the fits that
leave out one fold, or one group each, come from the same aggregation. Rows with
a null in a column that is used are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.equations import normal_two_sided

WEIGHT_CAP = 20.0
CLIP = 0.01


def _terms(names: list[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(n).cast("double") for n in names]]


def _products(xs: list[str], y: str) -> Column:
    """An array of all sums of products of the constant, the columns and the outcome, the upper triangle by rows."""
    terms = [*_terms(xs), F.col(y).cast("double")]
    return F.array(*[F.sum(a * b) for i, a in enumerate(terms) for b in terms[i:]])


def _square(flat: list[float] | np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = np.asarray(flat, float)
    return out + np.triu(out, 1).T


def _solve(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their standard errors and the residuals' variance from the matrix of sums."""
    gram, cross, yy, n = sums[:-1, :-1], sums[:-1, -1], sums[-1, -1], sums[0, 0]
    inverse = np.linalg.pinv(gram)
    beta = inverse @ cross
    free = max(n - len(beta), 1.0)
    variance = max(yy - beta @ cross, 0.0) / free
    return beta, np.sqrt(np.maximum(np.diag(inverse) * variance, 0.0)), variance


def _line(beta: np.ndarray, xs: list[str]) -> Column:
    out = F.lit(0.0)
    for b, x in zip(beta, _terms(xs), strict=True):
        out = out + F.lit(float(b)) * x
    return out


def _complete(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.dropna(subset=columns)


def _effect(df: DataFrame, pseudo: Column) -> DataFrame:
    """One row of the mean of a pseudo-outcome, its standard error, interval and p-value."""
    s = df.agg(F.avg(pseudo).alias("effect"), (F.stddev_samp(pseudo) / F.sqrt(F.count(pseudo))).alias("se"), F.count(pseudo).alias("n"))
    return _with_interval(s)


def _with_interval(s: DataFrame) -> DataFrame:
    z = F.col("effect") / F.nullif(F.col("se"), F.lit(0.0))
    return s.select(
        "*", (F.col("effect") - 1.959964 * F.col("se")).alias("ci_low"), (F.col("effect") + 1.959964 * F.col("se")).alias("ci_high"),
        F.coalesce(normal_two_sided(z), F.lit(0.0)).alias("p_value")
    )


def _linear(rows: DataFrame, y: str, xs: list[str], where: Column | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    found = (rows if where is None else rows.where(where)).agg(_products(xs, y).alias("s")).first()["s"]
    return _solve(_square([v or 0.0 for v in found], len(xs) + 2))


def regression_adjustment(rows: DataFrame, treatment: str, outcome: str, covariates: list[str]) -> DataFrame:
    """One row ``(effect, se, n, ci_low, ci_high, p_value)``: the treatment's coefficient next to the covariates."""
    used = _complete(rows, [treatment, outcome, *covariates])
    beta, se, _ = _linear(used, outcome, [treatment, *covariates])
    return _with_interval(used.agg(F.lit(float(beta[1])).alias("effect"), F.lit(float(se[1])).alias("se"), F.count("*").alias("n")))


def single_learner(rows: DataFrame, treatment: str, outcome: str, covariates: list[str]) -> DataFrame:
    """Rows with ``cate``: what one linear outcome model with the treatment as a column says of treating each."""
    beta, _, _ = _linear(_complete(rows, [treatment, outcome, *covariates]), outcome, [*covariates, treatment])
    return rows.withColumn("cate", F.when(F.col(covariates[0]).isNotNull() if covariates else F.lit(True), F.lit(float(beta[-1]))))


def two_learner(rows: DataFrame, treatment: str, outcome: str, covariates: list[str]) -> DataFrame:
    """Rows with ``cate``: the difference of two linear outcome models, one for each arm."""
    used = _complete(rows, [treatment, outcome, *covariates])
    one, _, _ = _linear(used, outcome, covariates, F.col(treatment) == 1)
    other, _, _ = _linear(used, outcome, covariates, F.col(treatment) == 0)
    return rows.withColumn("cate", _line(one - other, covariates))


def logistic_fit(
    rows: DataFrame, treatment: str, covariates: list[str], leave: list[Column] | None = None, rounds: int = 25, ridge: float = 1.0
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Coefficients of logistic models on standardised covariates with a ridge, by Newton steps from sums; with the means and deviations.

    ``leave`` holds a condition for each model, whose rows it leaves out; all
    models take their steps in the same aggregations.
    """
    leave = leave or [F.lit(False)]
    moments = rows.agg(
        *[F.avg(F.col(c).cast("double")) for c in covariates], *[F.stddev_pop(F.col(c).cast("double")) for c in covariates]
    ).first()
    p = len(covariates)
    mean = np.array([m or 0.0 for m in moments[:p]])
    sd = np.array([s or 1.0 for s in moments[p:]])
    scaled = [F.lit(1.0), *[(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(covariates, mean, sd, strict=True)]]
    size, betas = p + 1, [np.zeros(p + 1) for _ in leave]
    penalty = np.diag([0.0, *[ridge] * p])
    t = F.col(treatment).cast("double")
    for _ in range(rounds):
        sums = []
        for beta, out in zip(betas, leave, strict=True):
            score = sum((F.lit(float(b)) * x for b, x in zip(beta, scaled, strict=True)), F.lit(0.0))
            share = 1 / (1 + F.exp(-score))
            keep = F.when(out, F.lit(0.0)).otherwise(F.lit(1.0))
            sums += [F.sum(keep * (t - share) * x) for x in scaled]
            sums += [F.sum(keep * share * (1 - share) * a * b) for i, a in enumerate(scaled) for b in scaled[i:]]
        found = np.array([v or 0.0 for v in rows.agg(F.array(*sums).alias("s")).first()["s"]]).reshape(len(leave), -1)
        steps = []
        for k, row in enumerate(found):
            step = np.linalg.pinv(_square(row[size:], size) + penalty) @ (row[:size] - penalty @ betas[k])
            betas[k] = betas[k] + step
            steps.append(np.abs(step).max())
        if max(steps) < 1e-9:
            break
    return betas, mean, sd


def _share(beta: np.ndarray, mean: np.ndarray, sd: np.ndarray, covariates: list[str]) -> Column:
    score = F.lit(float(beta[0]))
    for b, m, s, c in zip(beta[1:], mean, sd, covariates, strict=True):
        score = score + F.lit(float(b)) * ((F.col(c).cast("double") - float(m)) / float(s))
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), 1 / (1 + F.exp(-score))))


def propensity(rows: DataFrame, treatment: str, covariates: list[str]) -> DataFrame:
    """Complete rows with ``propensity``, clipped to 0.01 to 0.99."""
    used = _complete(rows, [treatment, *covariates])
    (beta,), mean, sd = logistic_fit(used, treatment, covariates)
    return used.withColumn("propensity", _share(beta, mean, sd, covariates))


def _pseudo(treatment: str, outcome: str, mu1: Column, mu0: Column, share: Column) -> Column:
    t, y = F.col(treatment).cast("double"), F.col(outcome).cast("double")
    w1, w0 = F.least(F.lit(WEIGHT_CAP), 1 / share), F.least(F.lit(WEIGHT_CAP), 1 / (1 - share))
    return mu1 - mu0 + t * (y - mu1) * w1 - (1 - t) * (y - mu0) * w0


def inverse_weighting(rows: DataFrame, treatment: str, outcome: str, covariates: list[str]) -> DataFrame:
    """One row ``(effect, se, n, ...)``: the difference of capped inverse-propensity means; the standard error takes propensities as known."""
    p = propensity(_complete(rows, [outcome]), treatment, covariates)
    t, y, e = F.col(treatment).cast("double"), F.col(outcome).cast("double"), F.col("propensity")
    w = F.least(F.lit(WEIGHT_CAP), F.when(t == 1, 1 / e).otherwise(1 / (1 - e)))
    arm = lambda v: F.when(t == v, w)
    s = p.agg(
        *[f(arm(v)).alias(f"{n}{v}") for v in (0, 1) for n, f in (("w", F.sum),)], F.sum(arm(1) * y).alias("y1"),
        F.sum(arm(0) * y).alias("y0"), F.count("*").alias("n")
    )
    s = s.withColumns({"m1": F.col("y1") / F.col("w1"), "m0": F.col("y0") / F.col("w0")})
    # one row of means
    spread = p.join(F.broadcast(s)).agg(
        F.sqrt(
            F.sum(F.pow(F.when(t == 1, w * (y - F.col("m1")) / F.col("w1")).otherwise(w * (y - F.col("m0")) / F.col("w0")), F.lit(2.0)))
        ).alias("se")
    )
    return _with_interval(s.join(F.broadcast(spread)).select((F.col("m1") - F.col("m0")).alias("effect"), "se", "n"))


def doubly_robust(rows: DataFrame, treatment: str, outcome: str, covariates: list[str]) -> DataFrame:
    """One row ``(effect, se, n, ...)``: outcome lines for each arm, corrected by capped inverse propensities."""
    p = propensity(_complete(rows, [outcome]), treatment, covariates)
    one, _, _ = _linear(p, outcome, covariates, F.col(treatment) == 1)
    other, _, _ = _linear(p, outcome, covariates, F.col(treatment) == 0)
    return _effect(p, _pseudo(treatment, outcome, _line(one, covariates), _line(other, covariates), F.col("propensity")))


def cross_fitted(rows: DataFrame, treatment: str, outcome: str, covariates: list[str], id_col: str, folds: int = 5) -> DataFrame:
    """One row ``(effect, se, n, ...)``: doubly robust, with models for each fold that have not seen its rows.

    Folds are dealt by a hash of the id. The lines that leave out a fold come from
    the sums of all rows less the fold's own.
    """
    used = _complete(rows, [treatment, outcome, *covariates]).withColumn("_fold", F.pmod(F.xxhash64(id_col), F.lit(folds)).cast("int"))
    size = len(covariates) + 2
    # two rows a fold
    sums = {
        (r["_fold"], int(r["_arm"])): _square([v or 0.0 for v in r["s"]], size)
        for r in used.groupBy("_fold", F.col(treatment).cast("int").alias("_arm")).agg(_products(covariates, outcome).alias("s")).collect()
    }
    whole = {arm: sum((m for (_, a), m in sums.items() if a == arm), np.zeros((size, size))) for arm in (0, 1)}
    betas, mean, sd = logistic_fit(used, treatment, covariates, [F.col("_fold") == k for k in range(folds)])
    mu, share = {1: F.lit(None).cast("double"), 0: F.lit(None).cast("double")}, F.lit(None).cast("double")
    for k in range(folds):
        own = F.col("_fold") == k
        for arm in (0, 1):
            beta, _, _ = _solve(whole[arm] - sums.get((k, arm), np.zeros((size, size))))
            mu[arm] = F.when(own, _line(beta, covariates)).otherwise(mu[arm])
        share = F.when(own, _share(betas[k], mean, sd, covariates)).otherwise(share)
    return _effect(used, _pseudo(treatment, outcome, mu[1], mu[0], share))


def subgroup_effects(
    rows: DataFrame, subgroup: str, treatment: str, outcome: str, covariates: list[str], min_rows: int = 40, min_arm: int = 10
) -> DataFrame:
    """``(subgroup, n, treated, effect, se, ci_low, ci_high)``: regression adjustment in every subgroup with enough rows in both arms.

    Each group is one row of sums, so groups are solved in parallel, however many
    there are and however large.
    """
    used = _complete(rows, [treatment, outcome, *covariates])
    xs = [treatment, *covariates]
    sums = used.groupBy(F.col(subgroup).cast("string").alias("subgroup")).agg(
        F.count("*").alias("n"), F.sum(F.col(treatment).cast("long")).alias("treated"), _products(xs, outcome).alias("s")
    )
    sums = sums.where((F.col("n") >= min_rows) & (F.col("treated") >= min_arm) & (F.col("n") - F.col("treated") >= min_arm))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [_solve(_square(s, len(xs) + 2)) for s in pdf["s"]]
            yield pd.DataFrame(
                {
                    "subgroup": pdf["subgroup"], "n": pdf["n"], "treated": pdf["treated"], "effect": [float(b[1]) for b, _, _ in found],
                    "se": [float(e[1]) for _, e, _ in found]
                }
            )

    out = sums.mapInPandas(solve, "subgroup string, n long, treated long, effect double, se double")
    return out.select(
        "*", (F.col("effect") - 1.959964 * F.col("se")).alias("ci_low"), (F.col("effect") + 1.959964 * F.col("se")).alias("ci_high")
    )


def placebo_test(rows: DataFrame, treatment: str, placebo: str, covariates: list[str]) -> DataFrame:
    """``(method, effect, ci_low, ci_high, passes)`` of three estimators on an outcome from before the treatment, where all should find nothing."""
    methods = {"regression": regression_adjustment, "weighting": inverse_weighting, "doubly_robust": doubly_robust}
    out = None
    for name, f in methods.items():
        one = f(rows, treatment, placebo, covariates).select(
            F.lit(name).alias("method"), "effect", "ci_low", "ci_high",
            F.lit(0.0).between(F.col("ci_low"), F.col("ci_high")).alias("passes")
        )
        out = one if out is None else out.unionByName(one)
    return out


def overlap(rows: DataFrame, treatment: str, score: str = "propensity") -> DataFrame:
    """One row: least and greatest propensity, the arms' means, and whether their ranges meet."""
    t, p = F.col(treatment) == 1, F.col(score)
    one, other = F.when(t, p), F.when(~t, p)
    return rows.agg(
        F.min(p).alias("least"), F.max(p).alias("greatest"), F.avg(one).alias("treated_mean"), F.avg(other).alias("control_mean"),
        ((F.min(one) <= F.max(other)) & (F.min(other) <= F.max(one))).alias("overlap_ok"),
    )


def weighted_balance(rows: DataFrame, treatment: str, covariates: list[str], weight: str) -> DataFrame:
    """``(covariate, smd, variance_ratio)`` between the weighted arms."""
    t, w = F.col(treatment) == 1, F.col(weight)
    stats = []
    for c in covariates:
        x = F.col(c).cast("double")
        mean = lambda arm, x=x: F.sum(F.when(arm, w * x)) / F.sum(F.when(arm, w))
        square = lambda arm, x=x: F.sum(F.when(arm, w * x * x)) / F.sum(F.when(arm, w))
        v1, v0 = (F.greatest(square(a) - mean(a) * mean(a), F.lit(0.0)) for a in (t, ~t))
        smd = (mean(t) - mean(~t)) / F.sqrt(F.greatest((v1 + v0) / 2, F.lit(1e-12)))
        stats.append(F.struct(F.lit(c).alias("covariate"), smd.alias("smd"), (v1 / F.greatest(v0, F.lit(1e-12))).alias("variance_ratio")))
    return rows.agg(F.array(*stats).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def effective_sizes(rows: DataFrame, treatment: str, weight: str) -> DataFrame:
    """One row of Kish's effective sample sizes of both arms."""
    t, w = F.col(treatment) == 1, F.col(weight)
    size = lambda arm: F.coalesce(F.pow(F.sum(F.when(arm, w)), F.lit(2.0)) / F.nullif(F.sum(F.when(arm, w * w)), F.lit(0.0)), F.lit(0.0))
    return rows.agg(size(t).alias("ess_treated"), size(~t).alias("ess_control"))


def effect_e_value(effect: Column, deviation: Column) -> Column:
    """The E-value of an effect in units of the outcome's standard deviation; one for no effect."""
    ratio = F.exp(0.91 * F.abs(effect) / F.nullif(deviation, F.lit(0.0)))
    return F.when((deviation < 1e-12) | (F.abs(effect) < 1e-12), F.lit(1.0)).otherwise(ratio + F.sqrt(ratio * (ratio - 1)))


def bias_scenarios(estimate: DataFrame, deviation: float, steps: int = 6, most: float = 1.25) -> DataFrame:
    """``(bias, effect, ci_low, ci_high, e_value, e_value_ci)``: an estimate's row with biases of up to ``most`` times its effect taken away."""
    sign = F.when(F.col("effect") >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    shares = F.explode(F.array(*[F.lit(most * k / (steps - 1)) for k in range(steps)])).alias("_share")
    nothing = F.lit(0.0).between(F.col("ci_low"), F.col("ci_high"))
    near = F.least(F.abs("ci_low"), F.abs("ci_high"))
    bias = F.abs("effect") * F.col("_share")
    return estimate.select("*", shares).select(
        bias.alias("bias"), (F.col("effect") - sign * bias).alias("effect"), (F.col("ci_low") - sign * bias).alias("ci_low"), (
            F.col("ci_high") - sign * bias
        ).alias("ci_high"),
        effect_e_value(F.col("effect"), F.lit(deviation)).alias("e_value"), F.when(nothing, F.lit(1.0)).otherwise(
            effect_e_value(near, F.lit(deviation))
        ).alias("e_value_ci"),
    )


def parallel_trends(rows: DataFrame, treatment: str, period: str, outcome: str) -> DataFrame:
    """One row ``(f_statistic, n_periods, df)``: whether the arms' difference changes over the periods before the treatment.

    The model with an effect of each period and one difference is compared with
    the one of a difference in each period; both follow from the cells' means.
    """
    y = F.col(outcome).cast("double")
    cells = rows.groupBy(period).agg(
        *[
            F.count(F.when(F.col(treatment) == a, y)).alias(f"n{a}") for a in (0, 1)
        ], *[F.avg(F.when(F.col(treatment) == a, y)).alias(f"m{a}") for a in (0, 1)],
        *[
            F.coalesce(F.var_pop(F.when(F.col(treatment) == a, y)) * F.count(F.when(F.col(treatment) == a, y)), F.lit(0.0)).alias(f"s{a}")
            for a in (0, 1)
        ],
    ).where("n0 > 0 and n1 > 0")
    cells = cells.select(
        (F.col("m1") - F.col("m0")).alias("d"), (F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1"))).alias("w"),
        (F.col("s0") + F.col("s1")).alias("s"), (F.col("n0") + F.col("n1")).alias("n")
    )
    s = cells.agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("d")).alias("wd"), F.sum(F.col("w") * F.col("d") * F.col("d")).alias("wdd"),
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.count("*").alias("p")
    )
    free = F.col("n") - 2 * F.col("p")
    f = (
        (F.col("wdd") - F.col("wd") * F.col("wd") / F.nullif(F.col("w"), F.lit(0.0))) / F.nullif(F.col("p") - 1, F.lit(0))
    ) / F.nullif(F.col("s") / F.nullif(free, F.lit(0)), F.lit(0.0))
    return s.select(F.coalesce(f, F.lit(0.0)).alias("f_statistic"), F.col("p").alias("n_periods"), free.alias("df"))
