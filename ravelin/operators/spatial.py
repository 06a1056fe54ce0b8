"""Spatial filters and joins by grid cells.

Spark has no range or spatial join, so rows meet in grid cells: every row of one
side is put into all cells that it can reach, the other into its own, an
equi-join on the cell finds candidates, and the exact test decides. Distances
are between centroids, columns ``x`` and ``y``; rows at one place are compared once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import equations, geometry
from ..session import settle
from .tables import aggregate


def query_bounds(
    df: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float, mode: str = "intersects", geometry_col: str = "geometry"
) -> DataFrame:
    """Rows whose bounds, or centroid, meet or lie within a box; edges belong to it."""
    g = F.col(geometry_col)
    own = geometry.bounds(g)
    window = F.struct(*[F.lit(float(v)).alias(k) for k, v in (("min_x", min_x), ("min_y", min_y), ("max_x", max_x), ("max_y", max_y))])
    if mode == "centroid":
        c = geometry.centroid(g)
        return df.where(c["x"].between(min_x, max_x) & c["y"].between(min_y, max_y))
    if mode not in ("intersects", "within"):
        raise ValueError(f"unknown mode: {mode}")
    return df.where(geometry.bounds_intersect(own, window) if mode == "intersects" else geometry.bounds_within(own, window))


def query_radius(df: DataFrame, x: float, y: float, max_distance: float, method: str = "euclidean") -> DataFrame:
    """Rows within a distance of a place, with that distance."""
    found = df.withColumn("distance", equations.coordinate_distance(F.lit(float(x)), F.lit(float(y)), F.col("x"), F.col("y"), method))
    return found.where(F.col("distance") <= max_distance)


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


#: Coordinates that rows meet by: the plane's, or those of the sphere's surface in space.
_AXES = {"euclidean": ["x", "y"], "haversine": ["_u", "_v", "_w"]}


def _placed(df: DataFrame, method: str) -> DataFrame:
    """Rows with the coordinates of the method; on the sphere x and y are degrees of longitude and latitude."""
    if method not in _AXES:
        raise ValueError(f"unknown distance method: {method}")
    if method == "euclidean":
        return df
    lon, lat, r = F.radians("x"), F.radians("y"), equations.EARTH_RADIUS_KM
    return df.withColumns({"_u": r * F.cos(lat) * F.cos(lon), "_v": r * F.cos(lat) * F.sin(lon), "_w": r * F.sin(lat)})


def _ranking_distance(x1: Column, y1: Column, x2: Column, y2: Column, method: str) -> Column:
    """Distances that decide which of nearly equal ones comes first.

    On the sphere by the C library: the JVM's arc tangent is off by up to two units in
    the last place, so that nearly equal distances tie or change places.
    """
    if method != "haversine":
        return equations.coordinate_distance(x1, y1, x2, y2, method)
    diameter = 2.0 * equations.EARTH_RADIUS_KM

    def kilometres(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
        if not all(map(math.isfinite, (lon1, lat1, lon2, lat2))):
            return math.nan
        half = lambda a, b: math.pow(math.sin((math.radians(b) - math.radians(a)) / 2), 2.0)
        a = half(lat1, lat2) + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * half(lon1, lon2)
        return diameter * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))

    return F.udf(kilometres, "double", useArrow=True)(x1, y1, x2, y2)


def _straight(distance: float, method: str) -> float:
    """The length of the straight line through the sphere for a distance on it."""
    if method == "euclidean":
        return distance
    r = equations.EARTH_RADIUS_KM
    return 2 * r * math.sin(min(distance / (2 * r), math.pi / 2))


def _places(rows: DataFrame, side: str, method: str) -> tuple[DataFrame, DataFrame]:
    """The distinct places of rows with the number of their rows ``n``, and the rows with their place's number instead of ``x`` and ``y``.

    Rows at one place have one distance to others, so that places are compared and not rows.
    """
    number, n = f"_{side}", f"_n_{side}"
    plain = rows.where("x is not null and y is not null and not isnan(x) and not isnan(y)").withColumns({c: F.col(c) + F.lit(0.0) for c in "xy"})
    places = plain.groupBy("x", "y").agg(F.count("*").alias(n)).withColumn(number, F.monotonically_increasing_id())
    places = settle(places, "places")
    return _placed(places, method), plain.join(places.select("x", "y", number), ["x", "y"]).drop("x", "y")


def _near_places(left: DataFrame, right: DataFrame, size: float, method: str) -> DataFrame:
    """Pairs of places that may be within ``size`` as the crow flies, with both places' columns, the right's with ``_r`` before its coordinates."""
    axes = _AXES[method]
    cells = [f"_c{k}" for k in range(len(axes))]
    around = lambda x: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: _cell(F.col(x), size) + k)
    a = left.withColumns({c: _cell(F.col(x), size) for c, x in zip(cells, axes, strict=True)})
    b = right
    for c, x in zip(cells, axes, strict=True):  # each place in its own cell and those around it
        b = b.withColumn(c, F.explode(around(x)))
    names = list(dict.fromkeys(["x", "y", *axes]))
    return a.join(b.withColumnsRenamed({x: f"_r{x}" for x in names}), cells)


def _met(left: DataFrame, right: DataFrame, reach: float, method: str) -> DataFrame:
    """All pairs of rows ``(x, y, ...)`` within reach, with ``distance`` and the other columns of both sides.

    Places meet first; then their rows, dealt by what they make, so that no task has a crowded place to itself.
    """
    if reach <= 0:
        raise ValueError("the distance must be positive")
    one, left_rows = _places(left, "left", method)
    two, right_rows = _places(right, "right", method)
    # A little more than the straight line, against rounding; the exact distance decides.
    near = _near_places(one, two, _straight(reach, method) * (1 + 1e-9) + 1e-9, method)
    distance = equations.coordinate_distance(F.col("x"), F.col("y"), F.col("_rx"), F.col("_ry"), method)
    near = near.select("_left", "_right", "_n_left", "_n_right", distance.alias("distance")).where(F.col("distance") <= reach)
    near = settle(near, "near")
    n = near.agg(F.coalesce(F.sum(F.col("_n_left") * F.col("_n_right")), F.lit(0))).first()[0]
    tasks = min(max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // _PAIRS_A_TASK)), 20_000)
    out = near.drop("_n_left", "_n_right").join(left_rows, "_left").withColumn("_salt", F.pmod(F.xxhash64("left_id"), F.lit(_SALTS)))
    spread = right_rows.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    return out.repartition(tasks, "_right", "_salt").join(spread, ["_right", "_salt"]).drop("_left", "_right", "_salt")


#: Pairs that a task makes, about, and parts that the left rows near a place are dealt into.
_PAIRS_A_TASK, _SALTS = 2_000_000, 8


def _keep_left(pairs: DataFrame, left: DataFrame, left_id: str, how: str) -> DataFrame:
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    return pairs if how == "inner" else left.select(F.col(left_id).alias("left_id")).distinct().join(pairs, "left_id", "left")


def proximity_join(
    left: DataFrame, right: DataFrame, max_distance: float, left_id: str, right_id: str, how: str = "inner", method: str = "euclidean"
) -> DataFrame:
    """All pairs within a distance: ``(left_id, right_id, distance)``; with ``how="left"`` also left rows without any."""
    if method not in _AXES:
        raise ValueError(f"unknown distance method: {method}")
    one, two = left.select(F.col(left_id).alias("left_id"), "x", "y"), right.select(F.col(right_id).alias("right_id"), "x", "y")
    found = _met(one, two, max_distance, method)
    return _keep_left(found.select("left_id", "right_id", "distance"), left, left_id, how)


def nearest_join(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int = 1, max_distance: float | None = None,
    exclude_self: bool = False, how: str = "inner", method: str = "euclidean"
) -> DataFrame:
    """The k nearest rows of ``right``: ``(left_id, right_id, distance, rank)``, ties by the text of the id.

    Exact: places are dealt into blocks along a curve, and only pairs of blocks are
    compared whose bounds leave it open whether one has a nearest place of the
    other. With ``how="left"`` left rows without a match stay. Distances on the
    sphere grow with straight ones, which are searched by.
    """
    if method not in _AXES:
        raise ValueError(f"unknown distance method: {method}")
    one, left_rows = _places(left.select(F.col(left_id).alias("left_id"), "x", "y"), "left", method)
    two, right_rows = _places(right.select(F.col(right_id).alias("right_id"), "x", "y"), "right", method)
    own = right_rows.groupBy("right_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] if exclude_self else 0
    wanted = k + own  # a row's own id can be among the nearest, as often as it is there
    limit = None if max_distance is None else _straight(max_distance, method) * (1 + _NEARLY) + _NEARLY
    near = _nearest_places(one, two, wanted, limit, _AXES[method]).join(
        one.select("_left", "x", "y"), "_left"
    ).join(two.select("_right", F.col("x").alias("_rx"), F.col("y").alias("_ry")), "_right")
    distance = _ranking_distance(F.col("x"), F.col("y"), F.col("_rx"), F.col("_ry"), method)
    near = near.select("_left", "_right", distance.alias("distance"))
    if max_distance is not None:
        near = near.where(F.col("distance") <= max_distance)
    text = F.col("right_id").cast("string")
    first = right_rows.withColumn("_k", F.row_number().over(Window.partitionBy("_right").orderBy(text))).where(F.col("_k") <= wanted).drop("_k")
    ranked = near.join(first, "_right").withColumn("rank", F.row_number().over(Window.partitionBy("_left").orderBy("distance", text)))
    found = ranked.where(F.col("rank") <= wanted).join(left_rows, "_left")
    if exclude_self:
        again = Window.partitionBy("left_id").orderBy("distance", text)
        found = found.where(F.col("left_id") != F.col("right_id")).withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)
    return _keep_left(found.select("left_id", "right_id", "distance", "rank"), left, left_id, how)


#: Places of a block, about; and what distances may differ by for rounding.
_BLOCK_PLACES, _NEARLY = 1024, 1e-9


def _place_blocks(places: DataFrame, number: str, axes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Places with a ``block``, by a Z-order of their axes, and the bounds and number of places of the blocks."""
    spans = places.agg(F.count("*"), *[f(x) for x in axes for f in (F.min, F.max)]).first()
    key = F.lit(0).cast("long")
    for a, x in enumerate(axes):
        low, high = spans[1 + 2 * a] or 0.0, spans[2 + 2 * a] or 0.0
        step = F.floor((F.col(x) - low) / max(high - low, 1e-300) * 65535).cast("long")
        for bit in range(16):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(step, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(axes) + a))
    n = max(1, -(-spans[0] // _BLOCK_PLACES))
    dealt = places.select(number, *axes, key.alias("_key")).repartitionByRange(n, "_key", *axes)
    dealt = settle(dealt.withColumn("block", F.spark_partition_id()).drop("_key"), "blocks")
    bounds = dealt.groupBy("block").agg(
        F.count("*").alias("n"), *[F.min(x).alias(f"{x}_0") for x in axes], *[F.max(x).alias(f"{x}_1") for x in axes]
    )
    return dealt, settle(bounds, "bounds")


def _nearest_places(left: DataFrame, right: DataFrame, k: int, limit: float | None, axes: list[str]) -> DataFrame:
    """``(_left, _right)``: among others, for each left place its k nearest right ones by straight distance, with all that tie."""
    a, a_bounds = _place_blocks(left, "_left", axes)
    b, b_bounds = _place_blocks(right, "_right", axes)
    one = a_bounds.select(F.col("block").alias("_a"), *[F.col(f"{x}_{e}").alias(f"a{x}_{e}") for x in axes for e in "01"])
    both = one.join(F.broadcast(b_bounds.withColumnRenamed("block", "_b")), how="cross")  # bounds of blocks of 1024 places
    gap = lambda x: F.greatest(F.lit(0.0), F.col(f"{x}_0") - F.col(f"a{x}_1"), F.col(f"a{x}_0") - F.col(f"{x}_1"))
    wide = lambda x: F.greatest(F.col(f"{x}_1") - F.col(f"a{x}_0"), F.col(f"a{x}_1") - F.col(f"{x}_0"))
    both = both.select(
        "_a", "_b", "n", F.sqrt(sum((gap(x) * gap(x) for x in axes), F.lit(0.0))).alias("low"),
        F.sqrt(sum((wide(x) * wide(x) for x in axes), F.lit(0.0))).alias("high")
    )
    # The blocks that are near as a whole and have k places say how far the k-th can be.
    both = both.withColumn("_sum", F.sum("n").over(Window.partitionBy("_a").orderBy("high", "_b")))
    far = F.min(F.when(F.col("_sum") >= k, F.col("high"))).over(Window.partitionBy("_a"))
    far = F.coalesce(far, F.lit(float("inf")))
    far = far if limit is None else F.least(far, F.lit(limit))
    pairs = settle(both.withColumn("far", far).where(F.col("low") <= F.col("far") * (1 + _NEARLY) + _NEARLY).select("_a", "_b"), "block-pairs")

    def nearest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        square = np.zeros((len(x), len(y)))
        for c in axes:
            square += (x[c].to_numpy()[:, None] - y[c].to_numpy()[None, :]) ** 2
        d = np.sqrt(square)
        most = np.full(len(x), np.inf) if k >= d.shape[1] else np.partition(d, k - 1, axis=1)[:, k - 1]
        most = most if limit is None else np.minimum(most, limit)
        i, j = np.nonzero(d <= (most * (1 + _NEARLY) + _NEARLY)[:, None])
        return pd.DataFrame({"_left": x["_left"].to_numpy()[i], "_right": y["_right"].to_numpy()[j], "d": d[i, j]})

    x = pairs.join(a.withColumnRenamed("block", "_a"), "_a")
    y = pairs.withColumnsRenamed({"_a": "_a2", "_b": "_b2"}).join(b.withColumnRenamed("block", "_b2"), "_b2")
    n = max(1, min(pairs.count(), 2000))
    found = x.repartition(n, "_a", "_b").groupBy("_a", "_b").cogroup(y.repartition(n, "_a2", "_b2").groupBy("_a2", "_b2")).applyInPandas(
        nearest, "_left long, _right long, d double"
    )
    # Of the nearest of several blocks only the nearest stay.
    found = found.withColumn("_k", F.row_number().over(Window.partitionBy("_left").orderBy("d")))
    most = F.max(F.when(F.col("_k") <= k, F.col("d"))).over(Window.partitionBy("_left"))
    return found.withColumn("_most", most).where(F.col("d") <= F.col("_most") * (1 + _NEARLY) + _NEARLY).select("_left", "_right")


def with_rows(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, suffix: str = "right") -> DataFrame:
    """Pairs with all columns of both sides; those of the right that clash get a suffix."""
    own = left.select(F.col(left_id).alias("_left_id"), *left.columns)
    taken = {*left.columns, *pairs.columns}
    other = right.select(F.col(right_id).alias("_right_id"), *[F.col(c).alias(f"{c}_{suffix}" if c in taken else c) for c in right.columns])
    out = pairs.join(own, F.col("left_id") == F.col("_left_id")).join(other, F.col("right_id") == F.col("_right_id"), "left")
    return out.drop("_left_id", "_right_id", "left_id", "right_id")


def assign_nearest(
    origins: DataFrame, targets: DataFrame, origin_id: str, target_id: str, max_distance: float | None = None, how: str = "inner",
    method: str = "euclidean"
) -> DataFrame:
    """For each target its nearest origin: ``(target_id, origin_id, distance)``."""
    found = nearest_join(targets, origins, target_id, origin_id, 1, max_distance, how=how, method=method)
    return found.select(F.col("left_id").alias("target_id"), F.col("right_id").alias("origin_id"), "distance")


def summarize_assignments(
    origins: DataFrame, targets: DataFrame, origin_id: str, target_id: str, max_distance: float | None = None, how: str = "left",
    method: str = "euclidean", aggregations: dict[str, str] | None = None, order: str | None = None
) -> DataFrame:
    """Counts, distances and aggregates of the targets assigned to each origin; with ``how="left"`` origins without any stay."""
    found = assign_nearest(origins, targets, origin_id, target_id, max_distance, method=method)
    extra = aggregations or {}
    if extra:
        columns = [*extra, *([order] if order and order not in extra else [])]
        found = found.join(
            targets.select(F.col(target_id).alias("_target"), *[F.col(c).alias(f"_{c}") for c in columns]),
            F.col("target_id") == F.col("_target")
        )
    more = [aggregate(f"_{c}", op, f"_{order}" if order else None).alias(f"{c}_{op}") for c, op in extra.items()]
    per = found.groupBy("origin_id").agg(
        F.count("*").alias("n_targets"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"),
        F.avg("distance").alias("mean_distance"), *more
    )
    if how == "inner":
        return per
    own = origins.select(F.col(origin_id).alias("origin_id")).distinct()
    return own.join(per, "origin_id", "left").withColumn("n_targets", F.coalesce("n_targets", F.lit(0)))


_PREDICATES = {"intersects": geometry.intersects, "within": geometry.within, "contains": geometry.contains}


def spatial_join(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, predicate: str = "intersects", how: str = "inner", cell: float = 1.0
) -> DataFrame:
    """Pairs whose ``geometry`` columns satisfy a predicate: ``(left_id, right_id)``.

    Both sides are put into every cell that their bounds touch. Of the cells that
    a pair shares only the one with the lower corner of the overlap of bounds
    counts, so no pair is found twice.
    """
    if predicate not in _PREDICATES or how not in ("inner", "left"):
        raise ValueError("unknown predicate or join type")

    def spread(df: DataFrame, id_col: str, side: str) -> DataFrame:
        rows = df.select(F.col(id_col).alias(f"{side}_id"), F.col("geometry").alias(f"_{side}_g"))
        rows = rows.withColumn(f"_{side}_b", geometry.bounds(F.col(f"_{side}_g")))
        b = F.col(f"_{side}_b")
        xs = F.sequence(_cell(b["min_x"] - geometry.TOLERANCE, cell), _cell(b["max_x"] + geometry.TOLERANCE, cell))
        ys = F.sequence(_cell(b["min_y"] - geometry.TOLERANCE, cell), _cell(b["max_y"] + geometry.TOLERANCE, cell))
        return rows.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))

    met = spread(left, left_id, "left").join(spread(right, right_id, "right"), ["_cx", "_cy"])
    a, b = F.col("_left_b"), F.col("_right_b")
    low = lambda k: _cell(F.greatest(a[f"min_{k}"], b[f"min_{k}"]) - geometry.TOLERANCE, cell)
    met = met.where((F.col("_cx") == low("x")) & (F.col("_cy") == low("y")) & _PREDICATES[predicate](F.col("_left_g"), F.col("_right_g")))
    pairs = met.select("left_id", "right_id")
    if how == "left":
        return left.select(F.col(left_id).alias("left_id")).join(pairs, "left_id", "left")
    return pairs


def coverage_summary(
    areas: DataFrame, targets: DataFrame, area_id: str, target_id: str, predicate: str = "contains", cell: float = 1.0,
    aggregations: dict[str, str] | None = None, order: str | None = None
) -> DataFrame:
    """How many targets each area covers, and aggregates of them; areas without any stay. Ids stay as rows of the pairs."""
    pairs, extra = spatial_join(areas, targets, area_id, target_id, predicate, "inner", cell), aggregations or {}
    if extra:
        columns = [*extra, *([order] if order and order not in extra else [])]
        pairs = pairs.join(targets.select(F.col(target_id).alias("right_id"), *[F.col(c).alias(f"_{c}") for c in columns]), "right_id")
    more = {f"{c}_{op}": aggregate(f"_{c}", op, f"_{order}" if order else None) for c, op in extra.items()}
    per = pairs.groupBy("left_id").agg(
        F.count("*").alias("n_covered"), F.min("right_id").alias("first_id"), *[c.alias(n) for n, c in more.items()]
    )
    return areas.select(F.col(area_id).alias("left_id")).join(per, "left_id", "left").select(
        F.col("left_id").alias("area_id"), F.coalesce("n_covered", F.lit(0)).alias("n_covered"), "first_id", *more
    )


def neighborhood_pressure(df: DataFrame, id_col: str, weight: str, reach: float, scale: float = 1.0, power: float = 2.0) -> DataFrame:
    """Decayed weights of the other rows within reach, summed for each row."""
    if reach <= 0:
        raise ValueError("the distance must be positive")
    rows = df.select(F.col(id_col).alias("left_id"), F.col(weight).alias("_w"), "x", "y").where("left_id is not null")
    places, placed = _places(rows, "left", "euclidean")
    # Weights at one place decay alike, so that they are summed first; a row's own is taken off.
    summed = places.join(placed.groupBy("_left").agg(F.sum("_w").alias("_w")), "_left")
    other = summed.select(F.col("_left").alias("_right"), "_w", "x", "y")
    distance = equations.coordinate_distance(F.col("x"), F.col("y"), F.col("_rx"), F.col("_ry"))
    decayed = equations.influence(F.col("_w"), F.col("distance"), scale, power)
    near = _near_places(places, other, reach * (1 + 1e-9) + 1e-9, "euclidean").withColumn("distance", distance).where(F.col("distance") <= reach)
    per = placed.drop("_w").join(near.groupBy("_left").agg(F.sum(decayed).alias("_p")), "_left").select("left_id", "_p")
    own = rows.drop("_w").join(rows.select("left_id", "_w", F.col("x").alias("_rx"), F.col("y").alias("_ry")), "left_id")
    own = own.withColumn("distance", distance).where(F.col("distance") <= reach).select("left_id", (-decayed).alias("_p"))
    per = per.union(own).groupBy("left_id").agg(F.sum("_p").alias("pressure"))
    return df.select(F.col(id_col).alias("left_id")).join(per, "left_id", "left").select(
        F.col("left_id").alias(id_col), F.coalesce("pressure", F.lit(0.0)).alias("pressure")
    )


def _apart(df: DataFrame, id_col: str, reach: float, method: str, left: dict[str, Column], right: dict[str, Column]) -> DataFrame:
    """Ordered pairs of different rows within reach, with columns of both."""
    side = lambda name, more: df.select(F.col(id_col).alias(f"{name}_id"), "x", "y", *[c.alias(n) for n, c in more.items()])
    return _met(side("left", left), side("right", right), reach, method).where(F.col("left_id") != F.col("right_id"))


def interaction_table(
    df: DataFrame, id_col: str, origin: str, destination: str, reach: float, scale: float = 1.0, power: float = 2.0,
    preferred_bearing: float | None = None, method: str = "euclidean"
) -> DataFrame:
    """Interactions of ordered pairs within reach: ``(left_id, right_id, distance, interaction)``, with ``alignment`` to a preferred bearing if one is given."""
    met = _apart(
        df, id_col, reach, method, {"_o": F.col(origin), "_ox": F.col("x"), "_oy": F.col("y")},
        {"_d": F.col(destination), "_dx": F.col("x"), "_dy": F.col("y")}
    )
    more = [] if preferred_bearing is None else [
        equations.alignment(F.col("_ox"), F.col("_oy"), F.col("_dx"), F.col("_dy"), preferred_bearing).alias("alignment")
    ]
    return met.select(
        "left_id", "right_id", "distance",
        equations.interaction(F.col("_o"), F.col("_d"), F.col("distance"), scale, power).alias("interaction"), *more
    )


def distance_table(df: DataFrame, id_col: str, reach: float, method: str = "euclidean") -> DataFrame:
    """The distances of all pairs within reach, each row to itself included: ``(left_id, right_id, distance)``."""
    return proximity_join(df, df, reach, id_col, id_col, method=method)


def area_similarity_table(
    df: DataFrame, id_col: str, reach: float, scale: float = 1.0, power: float = 1.0, method: str = "euclidean"
) -> DataFrame:
    """``(left_id, right_id, similarity)`` of ordered pairs within reach, by the areas of their geometries."""
    size = geometry.area(F.col("geometry"))
    met = _apart(df, id_col, reach, method, {"_a": size}, {"_b": size})
    return met.select(
        "left_id", "right_id", equations.area_similarity(F.col("_a"), F.col("_b"), F.col("distance"), scale, power).alias("similarity")
    )


def _from_anchor(df: DataFrame, id_col: str, anchor, method: str) -> DataFrame:
    """Rows with their ``distance`` from the row of an id, which has to be there."""
    at = df.where(F.col(id_col) == F.lit(anchor)).select(F.col("x").alias("_ax"), F.col("y").alias("_ay")).limit(1)
    if at.isEmpty():
        raise KeyError(f"no row has the id {anchor}")
    # one row
    return df.join(F.broadcast(at)).withColumn(
        "distance", equations.coordinate_distance(F.col("_ax"), F.col("_ay"), F.col("x"), F.col("y"), method)
    ).drop("_ax", "_ay")


def anchor_influence(
    df: DataFrame, id_col: str, weight: str, anchor, scale: float = 1.0, power: float = 2.0, method: str = "euclidean"
) -> DataFrame:
    """Rows with ``influence``: their weight, decayed by the distance from an anchor."""
    return _from_anchor(df, id_col, anchor, method).withColumn(
        "influence", equations.influence(F.col(weight), F.col("distance"), scale, power)
    )


def corridor_accessibility(
    df: DataFrame, id_col: str, weight: str, anchor, scale: float = 1.0, power: float = 2.0, method: str = "euclidean"
) -> DataFrame:
    """Rows with ``accessibility``: their weight and length, decayed by the distance from an anchor."""
    size = geometry.length(F.col("geometry"))
    return _from_anchor(df, id_col, anchor, method).withColumn(
        "accessibility", equations.corridor_strength(F.col(weight), size, F.col("distance"), scale, power)
    )


def buffer_points(df: DataFrame, distance: float, resolution: int = 16, geometry_col: str = "geometry") -> DataFrame:
    """Points as polygons around them, with ``4 * resolution`` corners at the distance."""
    if distance < 0 or resolution <= 0:
        raise ValueError("the distance must not be negative, and the resolution positive")
    n = 4 * resolution
    centre = F.element_at(F.col(geometry_col)["coords"], 1)
    angle = lambda k: k % n * (-2 * math.pi / n)
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(n)),
        lambda k: geometry.vertex(centre["x"] + distance * F.cos(angle(k)), centre["y"] + distance * F.sin(angle(k)))
    )
    other = F.raise_error(F.lit("only points have buffers here")).cast(geometry.GEOMETRY)
    return df.withColumn(
        geometry_col,
        F.when(F.col(geometry_col)["type"] == "Point", F.struct(F.lit("Polygon").alias("type"), ring.alias("coords"))).otherwise(other)
    )


def buffer_join(
    points: DataFrame, other: DataFrame, distance: float, left_id: str, right_id: str, how: str = "inner", resolution: int = 16
) -> DataFrame:
    """Pairs of points and geometries that meet the polygon around the point."""
    return spatial_join(
        buffer_points(points, distance, resolution), other, left_id, right_id, "intersects", how, cell=max(distance * 2, 1e-6)
    )


def _turned(ring: list) -> list[tuple[float, float]]:
    """The open ring's corners, counter-clockwise."""
    points = [(v["x"], v["y"]) for v in ring][:-1]
    twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))
    return points if twice >= 0 else points[::-1]


def _convex_overlap(subject: list, window: list) -> list | None:
    """What a ring and a convex one have in common, cut by one side after the other."""
    points, sides = _turned(subject), _turned(window)
    for a, b in zip(sides, sides[1:] + sides[:1], strict=True):
        inside = lambda p, a=a, b=b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        kept = []
        for p, q in zip(points, points[1:] + points[:1], strict=True):
            s, t = inside(p), inside(q)
            if s >= 0:
                kept.append(p)
            if (s > 0 > t) or (s < 0 < t):
                f = s / (s - t)
                kept.append((p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])))
        points = kept
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]] if len(points) > 2 else None


def overlay_intersections(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float = 1.0) -> DataFrame:
    """``(left_id, right_id, geometry)``: what polygons of both sides have in common; those of the right have to be convex."""
    pairs = spatial_join(left, right, left_id, right_id, "intersects", "inner", cell)
    cut = F.udf(_convex_overlap, "array<struct<x:double,y:double>>", useArrow=True)
    a = left.select(F.col(left_id).alias("left_id"), F.col("geometry.coords").alias("_a"))
    b = right.select(F.col(right_id).alias("right_id"), F.col("geometry.coords").alias("_b"))
    met = pairs.join(a, "left_id").join(b, "right_id").withColumn("_ring", cut("_a", "_b")).where(F.col("_ring").isNotNull())
    return met.select("left_id", "right_id", F.struct(F.lit("Polygon").alias("type"), F.col("_ring").alias("coords")).alias("geometry"))


def _clip_ring(ring: list, window: tuple[float, float, float, float]) -> list | None:
    """A closed ring cut by the four sides of a box in turn (Sutherland-Hodgman)."""
    points = [(v["x"], v["y"]) for v in ring]
    for axis, limit, sign in ((0, window[0], 1), (0, window[2], -1), (1, window[1], 1), (1, window[3], -1)):
        out = []
        for a, b in zip(points, points[1:], strict=False):
            a_in, b_in = sign * (a[axis] - limit) >= 0, sign * (b[axis] - limit) >= 0
            if a_in != b_in:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                meet = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                meet[axis] = limit
                out.append(tuple(meet))
            if b_in:
                out.append(b)
        points = [*out, out[0]] if out else []
    return [{"x": float(x), "y": float(y)} for x, y in points] if len(points) > 3 else None


def clip_to_box(df: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float, geometry_col: str = "geometry") -> DataFrame:
    """Polygons cut to a box; those outside go."""
    window = (float(min_x), float(min_y), float(max_x), float(max_y))
    cut = F.udf(lambda ring: _clip_ring(ring, window), "array<struct<x:double,y:double>>", useArrow=True)
    box = F.struct(*[F.lit(v).alias(k) for k, v in zip(("min_x", "min_y", "max_x", "max_y"), window, strict=True)])
    near = df.where((F.col(geometry_col)["type"] == "Polygon") & geometry.bounds_intersect(geometry.bounds(F.col(geometry_col)), box))
    near = near.withColumn("_ring", cut(F.col(geometry_col)["coords"])).where(F.col("_ring").isNotNull())
    return near.withColumn(geometry_col, F.struct(F.lit("Polygon").alias("type"), F.col("_ring").alias("coords"))).drop("_ring")
