"""Table operations with explicit null and order rules.

Keys match null with null, aggregates skip nulls and give null where nothing is
left (counts too), and sorting puts nulls last going up and first going down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = ("sum", "mean", "min", "max", "first", "count")


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no such columns: {missing}")
    return df.select(*columns)


def where(df: DataFrame, predicate: Column | None = None, **equals) -> DataFrame:
    """Rows that satisfy the predicate and equal the given values; ``None`` equals null."""
    for name, value in equals.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df if predicate is None else df.where(predicate)


def sort_values(df: DataFrame, by: str, descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    key = F.desc_nulls_first(by) if descending else F.asc_nulls_last(by)
    return df.orderBy(key, *[F.asc_nulls_last(c) for c in ties])


def join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", suffix: str = "right") -> DataFrame:
    """Equi-join in which null keys meet; the right key goes and clashing names get a suffix."""
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    names = {c: f"{c}_{suffix}" if c in left.columns else c for c in right.columns}
    names[on] = "_right_key"
    renamed = right.select(*[F.col(c).alias(n) for c, n in names.items()])
    return left.join(renamed, left[on].eqNullSafe(renamed["_right_key"]), how).drop("_right_key")


def aggregate(column: str, how: str, order: str | None = None) -> Column:
    c = F.col(column)
    if how == "count":
        return F.nullif(F.count(c), F.lit(0))
    if how == "first":
        if order is None:
            raise ValueError("first needs a column that orders the rows")
        return F.min_by(c, F.when(c.isNotNull(), F.col(order)))
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {how}")
    return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[how](c)


def summarize(df: DataFrame, by: str | Sequence[str], aggregations: dict[str, str] | None = None, order: str | None = None) -> DataFrame:
    """Row count and one aggregate for each named column; null is a group."""
    keys = [by] if isinstance(by, str) else list(by)
    extra = [aggregate(c, how, order).alias(f"{c}_{how}") for c, how in (aggregations or {}).items()]
    return df.groupBy(*keys).agg(F.count("*").alias("row_count"), *extra)


def pivot(df: DataFrame, index: str, columns: str, values: str, how: str = "sum", labels: Sequence | None = None) -> DataFrame:
    """One column for each label, in the order of their text; cells without rows are null.

    With ``labels`` given no extra pass over the data finds them.
    """
    if labels is not None:
        labels = sorted(labels, key=str)
    return df.groupBy(index).pivot(columns, labels).agg(aggregate(values, how))


def scalar_check(df: DataFrame, name: str, condition: Column) -> DataFrame:
    """One row with the number of rows that break a contract."""
    return df.agg(F.count_if(condition).alias("failures")).select(
        F.lit(name).alias("check_name"), "failures", (F.col("failures") == 0).alias("passed")
    )


def unique_violations(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    repeated = df.groupBy(*keys).count().where("count > 1")
    return repeated.agg(F.count("*").alias("failures")).select(
        F.lit(name).alias("check_name"), "failures", (F.col("failures") == 0).alias("passed")
    )
