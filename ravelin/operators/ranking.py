"""Ranks within groups without a group in one task, and rank statistics over them.

Rows are first counted by value, so repeated values are one row; the values are
sorted in ranges over all groups at once, counts are summed within each range,
and the sums of the ranges before are added. The largest task holds one range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.equations import normal_two_sided
from ..session import settle


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(*keys, value, n, before)``: each distinct value of a group, how often it is there, and how many rows are less. Nulls are left out."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    n_ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(counted.repartitionByRange(n_ranges, *keys, value).withColumn("_range", F.spark_partition_id()), "ranges")
    within = ranged.withColumn("_sum", F.sum("n").over(Window.partitionBy("_range").orderBy(*keys, value)) - F.col("n"))
    sizes = ranged.groupBy("_range").agg(F.sum("n").alias("_size"))
    # a row for each range
    offsets = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_offset"))
    placed = within.join(F.broadcast(offsets), "_range").withColumn("_at", F.col("_sum") + F.col("_offset"))
    if not keys:
        return placed.select(value, "n", F.col("_at").alias("before"))
    starts = placed.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.min("_at").alias("_start"))
    joined = placed.join(starts, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return joined.select(*keys, value, "n", (F.col("_at") - F.col("_start")).alias("before"))


def mean_rank() -> Column:
    """The rank of a value from one, the mean of the ranks of equal ones."""
    return F.col("before") + (F.col("n") + 1) / 2


def quantile_at(ranks: DataFrame, keys: list[str], value: str, level: Column) -> DataFrame:
    """``(*keys, quantile, n)``: the interpolated quantile of each group; ``level`` may depend on the group's size ``size``."""
    sizes = ranks.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.sum("n").alias("size")).withColumn("_at", (F.col("size") - 1) * level)
    # without keys one row
    joined = ranks.join(sizes, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]) if keys else ranks.join(F.broadcast(sizes))
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    low, high = F.floor("_at"), F.ceil("_at")
    out = joined.groupBy(*keys).agg(
        F.max(F.when(holds(low), F.col(value))).alias("_low"), F.max(F.when(holds(high), F.col(value))).alias("_high"),
        F.first("_at").alias("_at"), F.first("size").alias("n")
    )
    return out.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))).alias("quantile"), "n")


def rosenbaum_bounds(pairs: DataFrame, difference: str, gammas: list[float]) -> DataFrame:
    """``(gamma, p_upper, significant)`` of matched differences: how strong a hidden bias would have to be."""
    ranks = value_ranks(pairs.select(F.abs(difference).alias("_abs")), [], "_abs").withColumn("rank", mean_rank())
    signed = pairs.select(
        F.abs(difference).alias("_abs"), (F.col(difference) > 0).alias("_up")
    ).groupBy("_abs").agg(F.count_if("_up").alias("_ups"))
    sums = ranks.join(signed, "_abs").agg(
        F.sum(F.col("rank") * F.col("_ups")).alias("plus"), F.sum(F.col("rank") * F.col("n")).alias("total"),
        F.sum(F.col("rank") * F.col("rank") * F.col("n")).alias("squares")
    )
    g = F.explode(F.array(*[F.lit(float(x)) for x in gammas])).alias("gamma")
    p = F.col("gamma") / (1 + F.col("gamma"))
    variance = p * (1 - p) * F.col("squares")
    z = (F.col("plus") - p * F.col("total")) / F.sqrt(F.nullif(variance, F.lit(0.0)))
    tail = F.when(z >= 0, normal_two_sided(z) / 2).otherwise(1 - normal_two_sided(z) / 2)
    upper = F.when(F.col("total").isNull(), F.lit(1.0)).otherwise(F.coalesce(tail, F.lit(0.5)))
    return sums.select("*", g).select("gamma", upper.alias("p_upper"), (upper < 0.05).alias("significant"))


def paired_t(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``(mean_difference, t, cohens_d, n, p_value)`` of paired columns; the p-value is normal, which n rows of hundreds allow."""
    d = F.col(a) - F.col(b)
    s = rows.agg(F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_sd"), F.count(d).alias("n"))
    t = F.col("mean_difference") / F.nullif(F.col("_sd") / F.sqrt("n"), F.lit(0.0))
    return s.select(
        "mean_difference", t.alias("t"), (F.col("mean_difference") / F.nullif(F.col("_sd"), F.lit(0.0))).alias("cohens_d"), "n",
        F.coalesce(normal_two_sided(t), F.lit(1.0)).alias("p_value")
    )


def wilcoxon(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``(statistic, z, n, p_value)`` of the signed-rank test of paired columns; zero differences are left out, ties corrected."""
    d = rows.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0")
    ranks = value_ranks(d.select(F.abs("d").alias("_abs")), [], "_abs").withColumn("rank", mean_rank())
    ups = d.groupBy(F.abs("d").alias("_abs")).agg(F.count_if(F.col("d") > 0).alias("_ups"))
    s = ranks.join(ups, "_abs").agg(
        F.sum(F.col("rank") * F.col("_ups")).alias("plus"), F.sum(F.col("rank") * F.col("n")).alias("total"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties")
    )
    least = F.least(F.col("plus"), F.col("total") - F.col("plus"))
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = (least - n * (n + 1) / 4) / F.sqrt(F.nullif(variance, F.lit(0.0)))
    return s.select(least.alias("statistic"), z.alias("z"), "n", F.coalesce(normal_two_sided(z), F.lit(1.0)).alias("p_value"))


def friedman(rows: DataFrame, block: str, methods: list[str]) -> DataFrame:
    """One row ``(statistic, n, p_value)``: whether methods, a column each, rank differently over the blocks of rows; ties have mean ranks.

    A block is one row, so ranks are found within it. The p-value is that of a
    chi-squared variable, by the Wilson-Hilferty transformation.
    """
    k = len(methods)
    values = F.array(*[F.col(m).cast("double") for m in methods])
    rank = lambda m: F.size(F.filter(values, lambda v: v < F.col(m))) + (F.size(F.filter(values, lambda v: v == F.col(m))) + 1) / 2
    equal = lambda m: F.size(F.filter(values, lambda v: v == F.col(m)))
    ranked = rows.select(
        block, *[rank(m).alias(f"_r{i}") for i, m in enumerate(methods)],
        sum((equal(m) * equal(m) - 1 for m in methods), F.lit(0)).alias("_ties")
    )
    s = ranked.agg(
        *[F.sum(f"_r{i}").alias(f"_r{i}") for i in range(k)], F.count("*").cast("double").alias("n"), F.sum("_ties").alias("_ties")
    )
    n = F.col("n")
    squares = sum((F.col(f"_r{i}") * F.col(f"_r{i}") for i in range(k)), F.lit(0.0))
    raw = 12 * squares / (n * k * (k + 1)) - 3 * n * (k + 1)
    chi = raw / F.nullif(1 - F.col("_ties") / (n * k * (k * k - 1)), F.lit(0.0))
    df = k - 1
    z = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    tail = F.when(z >= 0, normal_two_sided(z) / 2).otherwise(1 - normal_two_sided(z) / 2)
    return s.select(chi.alias("statistic"), n.cast("long").alias("n"), F.coalesce(tail, F.lit(1.0)).alias("p_value"))
