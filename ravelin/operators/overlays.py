"""Unions, intersections and buffers of polygons, by the edges that bound them.

Edges of all polygons of a group, interiors on their left, are split where they
meet; equal pieces are summed, so that copies are one piece and opposite ones
cancel. Each piece then asks how many polygons lie on its left and on its right: a
cell's corner counts the edges that a level line crosses on its way there, and the
piece the few that lie between it and the corner. Cells that lie within the result
or outside it as a whole, by their corner and the edges in them, are left out, and
crowded ones are quartered, so that only edges near the boundary are split. Pieces
with the result on one side only are its boundary; they are linked by the sharpest
turn and numbered by doubling pointers. All steps are joins within cells and sums:
neither a group nor a polygon is held by one task, only a ring of the result is.

Vertices are rounded to ``10^-DIGITS``. Rings of the result turn left, holes turn
right; parts that meet in a point only are apart; vertices in the middle of a
straight line go.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, shapes
from ..session import settle
from .tables import aggregate

DIGITS = 9
_TIE = 1e-12
#: Edges with which a cell isn't quartered any more, and how often cells are quartered at most.
_EDGES_A_CELL, _QUARTERINGS = 24, 8
_ENDS = ("ax", "ay", "bx", "by")


def _snap(v: Column) -> Column:
    return F.round(v, DIGITS) + F.lit(0.0)


def _meet(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal groups, null ones too, and equal keys; the right side's keys go."""
    names = {k: f"_{k}" for k in ("group", *keys)}
    right = right.withColumnsRenamed(names)
    return left.join(right, [F.col("group").eqNullSafe(F.col("_group")), *(F.col(k) == F.col(f"_{k}") for k in keys)]).drop(*names.values())


def polygon_edges(df: DataFrame, group: str, shape: str) -> DataFrame:
    """``(group, ax, ay, bx, by, w)``: the edges of polygon shapes from the lower to the higher end; ``w`` is how often the inside is on their left, less how often on their right."""
    rings = F.flatten(F.transform(F.col(shape)["parts"], lambda p: F.transform(p, lambda r, i: F.struct(r.alias("ring"), (F.when(i == 0, 1).otherwise(-1) * F.signum(shapes.signed_area(r))).alias("turn")))))
    # Equal shapes of a group are taken apart once.
    polygons = df.where(F.col(shape).isNotNull() & shapes.is_polygon(F.col(shape))).groupBy(F.col(group).alias("group"), F.col(shape).alias(shape)).agg(F.count("*").alias("n"))
    rows = polygons.select("group", "n", F.explode(rings).alias("r"))
    edges = rows.select("group", (F.col("r.turn").cast("int") * F.col("n")).alias("turn"), F.explode(shapes._ring_segments(F.col("r.ring"))).alias("e"))
    edges = edges.select("group", "turn", *(_snap(F.col(f"e.{p}.{k}")).alias(f"{p}{k}") for p in "ab" for k in "xy"))
    return _pieces(edges)


def _pieces(edges: DataFrame) -> DataFrame:
    """Equal edges summed, from their lower to their higher end; those that cancel go, and points."""
    up = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    ends = [F.when(up, F.col(f"{p}{k}")).otherwise(F.col(f"{q}{k}")).alias(f"{p}{k}") for p, q in (("a", "b"), ("b", "a")) for k in "xy"]
    edges = edges.where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))
    summed = edges.select("group", *ends, F.when(up, F.col("turn")).otherwise(-F.col("turn")).alias("turn"))
    return summed.groupBy("group", "ax", "ay", "bx", "by").agg(F.sum("turn").cast("int").alias("w")).where("w <> 0")


def laid_over(edges: DataFrame) -> DataFrame:
    """Level and upright edges of a line as stretches side by side, with the sum of what lies there; other edges as they are.

    Shapes of many sizes from one corner share lines, and no cell is small enough to part their edges.
    """
    upright, level = F.col("ax") == F.col("bx"), F.col("ay") == F.col("by")
    along = lambda p: F.when(upright, F.col(f"{p}y")).otherwise(F.col(f"{p}x"))
    ends = F.array(*(F.struct(along(p).alias("at"), (F.col("w") * sign).alias("d")) for p, sign in (("a", 1), ("b", -1))))
    met = edges.where(upright | level).select("group", upright.alias("upright"), F.when(upright, F.col("ax")).otherwise(F.col("ay")).alias("line"), F.explode(ends).alias("x"))
    turns = met.groupBy("group", "upright", "line", "x.at").agg(F.sum("x.d").alias("d")).where("d <> 0")
    line = Window.partitionBy("group", "upright", "line").orderBy("at")
    runs = turns.select("group", "upright", "line", "at", F.lead("at").over(line).alias("to"), F.sum("d").over(line).cast("int").alias("w")).where("w <> 0")
    x, y = (lambda k: F.when(F.col("upright"), F.col("line")).otherwise(F.col(k))), (lambda k: F.when(F.col("upright"), F.col(k)).otherwise(F.col("line")))
    straight = runs.select("group", x("at").alias("ax"), y("at").alias("ay"), x("to").alias("bx"), y("to").alias("by"), "w")
    return edges.where(~(upright | level)).select(*straight.columns).unionByName(straight)


def cell_size(edges: DataFrame) -> tuple[float, float, float]:
    """A cell about as large as an edge, not below a millionth of the extent, and the grid's origin off the vertices."""
    row = edges.agg(
        F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))).alias("mean"),
        F.min("ax").alias("x0"), F.max("bx").alias("x1"), F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1"),
    ).first()
    if row["mean"] is None:
        return 1.0, 0.0, 0.0
    size = max(row["mean"] * 1.0137, (row["x1"] - row["x0"]) / 1e6, (row["y1"] - row["y0"]) / 1e6, 10.0**-DIGITS)
    return size, row["x0"] - size * 0.3819660112, row["y0"] - size * 0.2360679775


def _cell(v: Column, origin: float, size: float) -> Column:
    return F.floor((v - origin) / size).cast("long")


def _finer(grid: tuple[float, float, float], level: int) -> tuple[float, float, float]:
    """The grid whose cells are quartered so many times."""
    return grid[0] / 2**level, grid[1], grid[2]


def _columns(grid: tuple[float, float, float]) -> tuple[Column, Column]:
    """The first and the last column of cells that an edge goes through; a hair more on both sides, so that rounding can't lose a cell."""
    size, x0, _ = grid
    return _cell(F.col("ax") - size * 1e-9, x0, size), _cell(F.col("bx") + size * 1e-9, x0, size)


def _rows(i: Column, grid: tuple[float, float, float]) -> tuple[Column, Column]:
    """The first and the last row that an edge goes through in a column, with a hair more too."""
    size, x0, y0 = grid
    ax, ay, bx, by = (F.col(c) for c in _ENDS)
    slope = (by - ay) / F.nullif(bx - ax, F.lit(0.0))

    def height(x: Column) -> Column:
        return F.coalesce(ay + slope * (F.least(F.greatest(x, ax), bx) - ax), ay)

    left, right = height(i * size + x0), height((i + 1) * size + x0)
    low, high = F.least(left, right), F.greatest(left, right)
    low, high = F.when(ax == bx, F.least(ay, by)).otherwise(low), F.when(ax == bx, F.greatest(ay, by)).otherwise(high)
    return _cell(low - size * 1e-9, y0, size), _cell(high + size * 1e-9, y0, size)


def in_cells(edges: DataFrame, grid: tuple[float, float, float]) -> DataFrame:
    """A row for each cell ``(i, j)`` that an edge goes through: its columns, and in each column the rows between its ends there."""
    rows = lambda i: F.transform(F.sequence(*_rows(i, grid)), lambda j: F.struct(i.alias("i"), j.alias("j")))
    cells = F.flatten(F.transform(F.sequence(*_columns(grid)), rows))
    return edges.withColumn("c", F.explode(cells)).select(*edges.columns, "c.i", "c.j")


def _in_quarters(placed: DataFrame, grid: tuple[float, float, float]) -> DataFrame:
    """Edges in cells, as a row for each of the cells' quarters, the cells of ``grid``, that they go through."""
    quarters = []
    for k in (0, 1):
        i = F.col("i") * 2 + k
        low, high = _rows(i, grid)
        for j in (F.col("j") * 2, F.col("j") * 2 + 1):
            quarters.append(F.when(i.between(*_columns(grid)) & j.between(low, high), F.struct(i.alias("i"), j.alias("j"))))
    rest = [c for c in placed.columns if c not in ("i", "j")]
    return placed.withColumn("c", F.explode(F.array_compact(F.array(*quarters)))).select(*rest, "c.i", "c.j")


def _corners(edges: DataFrame, cells: DataFrame, grid: tuple[float, float, float]) -> DataFrame:
    """``(group, i, j, depth)``: how many polygons have the lower left corners of cells, by the edges that the level line to there crosses."""
    size, x0, y0 = grid
    level = lambda j: j * size + y0
    rows = F.sequence(_cell(F.least("ay", "by"), y0, size), _cell(F.greatest("ay", "by"), y0, size) + 1)
    lines = edges.withColumn("j", F.explode(rows)).where((F.col("ay") > level(F.col("j"))) != (F.col("by") > level(F.col("j"))))
    at = F.col("ax") + (level(F.col("j")) - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    over = F.when(F.col("by") > F.col("ay"), -F.col("w")).otherwise(F.col("w"))
    crossed = lines.select("group", "j", _cell(at, x0, size).alias("i"), over.alias("d")).groupBy("group", "j", "i").agg(F.sum("d").alias("d"))
    asked = cells.select("group", "j", "i").distinct().withColumn("d", F.lit(0).cast("long"))
    line = Window.partitionBy("group", "j").orderBy("i").rangeBetween(Window.unboundedPreceding, -1)
    corners = crossed.withColumn("real", F.lit(0)).unionByName(asked.withColumn("real", F.lit(1)))
    return corners.withColumn("depth", F.coalesce(F.sum("d").over(line), F.lit(0))).where("real = 1").select("group", "i", "j", "depth")


def _over_level(y: Column, left: Column, right: Column, w: str) -> Column:
    """What the level way from ``left`` to ``right``, which counts to it, adds to the depth where it crosses an edge."""
    x = F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
    sign = F.when(F.col("by") > F.col("ay"), -F.col(w)).otherwise(F.col(w))
    return F.when(((F.col("ay") > y) != (F.col("by") > y)) & (x > left) & (x <= right), sign).otherwise(0)


def _over_upright(x: Column, low: Column, high: Column, w: str) -> Column:
    """The same for the way up from ``low`` to ``high``."""
    y = F.col("ay") + (x - F.col("ax")) * (F.col("by") - F.col("ay")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))
    return F.when(((F.col("ax") > x) != (F.col("bx") > x)) & (y > low) & (y <= high), F.col(w)).otherwise(0)


def open_cells(edges: DataFrame, grid: tuple[float, float, float], least: int = 1) -> tuple[list[DataFrame], DataFrame]:
    """The cells through which the boundary of what ``least`` polygons have may go, and the edges in them.

    For each number of quarterings the cells ``(group, i, j, depth, crowded)`` with the depth of their lower left
    corners, of which the crowded ones go on as their quarters; and ``(group, i, j, level, e, ...)``, the edges in the others.
    A way within a cell crosses each of its edges once at most, so the depth differs by no more than their sum
    anywhere in it: a cell that lies within or outside by that holds no boundary, however many edges it has.
    """
    rows = settle(in_cells(edges, grid), "placed")
    corners = _corners(edges, rows, grid)
    tree, near = [], []
    for level in range(_QUARTERINGS + 1):
        size, x0, y0 = _finer(grid, level)
        half = _finer(grid, level + 1)[0]
        left, low, middle, centre = F.col("i") * size + x0, F.col("j") * size + y0, (F.col("i") * 2 + 1) * half + x0, (F.col("j") * 2 + 1) * half + y0
        ways = {"east": _over_level(low, left, middle, "w"), "north": _over_upright(left, low, centre, "w"), "up": _over_upright(middle, low, centre, "w")}
        sums = rows.groupBy("group", "i", "j").agg(F.count("*").alias("n"), F.sum(F.abs("w")).alias("most"), *(F.sum(c).alias(k) for k, c in ways.items()))
        seen = _meet(corners, sums, "i", "j").where((F.col("depth") - F.col("most") < least) & (F.col("depth") + F.col("most") >= least))
        crowded = (F.col("n") > _EDGES_A_CELL) & F.lit(level < _QUARTERINGS)
        seen = settle(seen.select("group", "i", "j", "depth", crowded.alias("crowded"), *ways), "cells")
        tree.append(seen.select("group", "i", "j", "depth", "crowded"))
        near.append(_meet(rows, seen.where("NOT crowded").select("group", "i", "j"), "i", "j").withColumn("level", F.lit(level)))
        full = seen.where("crowded")
        if full.isEmpty():
            break
        rows = settle(_in_quarters(_meet(rows, full.select("group", "i", "j"), "i", "j"), _finer(grid, level + 1)), "placed")
        more = {(0, 0): F.lit(0), (1, 0): F.col("east"), (0, 1): F.col("north"), (1, 1): F.col("east") + F.col("up")}
        quarters = F.array(*(F.struct((F.col("i") * 2 + k).alias("i"), (F.col("j") * 2 + m).alias("j"), (F.col("depth") + d).alias("depth")) for (k, m), d in more.items()))
        corners = full.select("group", F.explode(quarters).alias("c")).select("group", "c.i", "c.j", "c.depth")
    edges_there = near[0]
    for others in near[1:]:
        edges_there = edges_there.unionByName(others)
    return tree, edges_there


def _in_open_cells(pieces: DataFrame, tree: list[DataFrame], grid: tuple[float, float, float]) -> DataFrame:
    """A row for each open cell that a piece goes through, with the place and depth of its corner, and whether the piece's middle lies there."""
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    rows, found = in_cells(pieces, grid), None
    for level, cells in enumerate(tree):
        size, x0, y0 = _finer(grid, level)
        here = _meet(rows, cells.where("NOT crowded").drop("crowded"), "i", "j")
        own = (F.col("i") == _cell(mx, x0, size)) & (F.col("j") == _cell(my, y0, size))
        here = here.withColumns({"level": F.lit(level), "cx": F.col("i") * size + x0, "cy": F.col("j") * size + y0, "own": own})
        found = here if found is None else found.unionByName(here)
        if level + 1 < len(tree):
            crowded = cells.where("crowded").select("group", "i", "j")
            rows = settle(_in_quarters(_meet(rows, crowded, "i", "j"), _finer(grid, level + 1)), "placed")
    return settle(found, "placed")


def _cuts(a: Column, b: Column) -> Column:
    """The points where two edges meet: a crossing, or ends of one on the other."""
    d = lambda p, q, k: q[k] - p[k]
    p, q, r, s = (F.struct(e[f"{n}x"].alias("x"), e[f"{n}y"].alias("y")) for e in (a, b) for n in "ab")
    cross = d(p, q, "x") * d(r, s, "y") - d(p, q, "y") * d(r, s, "x")
    t = (d(p, r, "x") * d(r, s, "y") - d(p, r, "y") * d(r, s, "x")) / F.nullif(cross, F.lit(0.0))
    u = (d(p, r, "x") * d(p, q, "y") - d(p, r, "y") * d(p, q, "x")) / F.nullif(cross, F.lit(0.0))
    meet = F.when(
        (F.abs(cross) > _TIE) & t.between(0, 1) & u.between(0, 1),
        F.struct(_snap(p["x"] + t * d(p, q, "x")).alias("x"), _snap(p["y"] + t * d(p, q, "y")).alias("y")),
    )
    near = 10.0**-DIGITS

    def on(v: Column, m: Column, n: Column) -> Column:
        """Closer than the rounding to the edge from m to n."""
        long = F.hypot(n["x"] - m["x"], n["y"] - m["y"])
        off = F.abs((n["x"] - m["x"]) * (v["y"] - m["y"]) - (n["y"] - m["y"]) * (v["x"] - m["x"])) / long
        along = ((n["x"] - m["x"]) * (v["x"] - m["x"]) + (n["y"] - m["y"]) * (v["y"] - m["y"])) / long
        return F.when((off <= near) & along.between(-near, long + near), v)

    return F.array(meet, on(r, p, q), on(s, p, q), on(p, r, s), on(q, r, s))


def split(edges: DataFrame, near: DataFrame, grid: tuple[float, float, float]) -> DataFrame:
    """Pieces of the edges ``(e, ...)`` of each group that meet in their ends only, as far as they go through the cells of ``near``; edges that are not there go."""
    one = near.select("group", "level", "i", "j", F.struct("e", *_ENDS).alias("one"))
    two = near.select("group", "level", "i", "j", F.struct("e", *_ENDS).alias("two"))
    met = _meet(one, two, "level", "i", "j").where(F.col("one.e") < F.col("two.e"))
    # Edges whose bounds are apart by more than the rounding have no cuts.
    least, most = (lambda e, k: F.least(f"{e}.a{k}", f"{e}.b{k}")), (lambda e, k: F.greatest(f"{e}.a{k}", f"{e}.b{k}") + 4 * 10.0**-DIGITS)
    for k in "xy":
        met = met.where((least("one", k) <= most("two", k)) & (least("two", k) <= most("one", k)))
    cuts = met.select(F.col("one.e").alias("e1"), F.col("two.e").alias("e2"), "level", "i", "j", F.explode(F.array_compact(_cuts(F.col("one"), F.col("two")))).alias("v"))
    # A cut counts in the cell that it lies in.
    size, slack = F.lit(grid[0]) / F.pow(F.lit(2.0), F.col("level")), 4 * 10.0**-DIGITS
    for k, n, origin in (("x", "i", grid[1]), ("y", "j", grid[2])):
        cuts = cuts.where(F.col(f"v.{k}").between(F.col(n) * size + origin - slack, (F.col(n) + 1) * size + origin + slack))
    each = cuts.select(F.explode(F.array("e1", "e2")).alias("e"), "v").distinct()
    cut_at = each.groupBy("e").agg(F.collect_list("v").alias("cuts"))
    a, b = (F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for p in "ab")
    along = lambda v: (v["x"] - F.col("ax")) * (F.col("bx") - F.col("ax")) + (v["y"] - F.col("ay")) * (F.col("by") - F.col("ay"))
    inner = F.filter(F.coalesce("cuts", F.array().cast("array<struct<x:double,y:double>>")), lambda v: (along(v) > 0) & (along(v) < along(b)))
    chain = F.transform(F.array_sort(F.transform(F.array_union(F.array(a, b), inner), lambda v: F.struct(along(v).alias("t"), v.alias("v")))), lambda x: x["v"])
    there = edges.join(near.select("e").distinct(), "e", "left_semi")
    chain = there.join(cut_at, "e", "left").select("group", "w", chain.alias("chain"))
    ends = F.transform(F.sequence(F.lit(1), F.size("chain") - 1), lambda k: F.struct(F.element_at("chain", k).alias("a"), F.element_at("chain", k + 1).alias("b")))
    parts = chain.select("group", F.col("w").alias("turn"), F.explode(ends).alias("s"))
    return _pieces(parts.select("group", "turn", *(F.col(f"s.{p}.{k}").alias(f"{p}{k}") for p in "ab" for k in "xy")))


def boundary(edges: DataFrame, least: int = 1) -> DataFrame:
    """``(group, ax, ay, bx, by)``: directed edges, with at least ``least`` polygons on their left and fewer on their right.

    A piece that also goes through cells without boundary isn't cut there. It has no cut in its open cells either,
    so its sides are alike as a whole, and what its middle says holds for it; without an open cell there it isn't kept.
    """
    whole = settle(laid_over(edges).withColumn("e", F.monotonically_increasing_id()), "edges")
    grid = cell_size(whole)
    tree, near = open_cells(whole, grid, least)
    pieces = settle(split(whole, near, grid).withColumn("e", F.monotonically_increasing_id()), "pieces")
    placed = _in_open_cells(pieces, tree, grid)
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    middles = placed.where("own").select("group", "e", "w", (F.col("ax") == F.col("bx")).alias("vertical"), mx.alias("mx"), my.alias("my"), "level", "i", "j", "cx", "cy", "depth")

    # From the corner along the level line and up; to upright pieces up and then to the right. Vertices on the second
    # leg count as lying before it, on its left or below, so the first leg crosses what ends there.
    p = placed.select("group", "level", "i", "j", F.col("e").alias("f"), *_ENDS, F.col("w").alias("v"))
    met = _meet(middles, p, "level", "i", "j")
    other = F.col("e") != F.col("f")
    cx, cy = F.col("cx"), F.col("cy")

    def level_leg(y: Column, left: Column, right: Column) -> Column:
        x = F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
        sign = F.when(F.col("by") > F.col("ay"), -F.col("v")).otherwise(F.col("v"))
        return F.when(((F.col("ay") > y) != (F.col("by") > y)) & (x > left) & ((x < right) | (~F.col("vertical") & (x == right))), sign).otherwise(0)

    def upright_leg(x: Column, low: Column, high: Column) -> Column:
        y = F.col("ay") + (x - F.col("ax")) * (F.col("by") - F.col("ay")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))
        return F.when(((F.col("ax") > x) != (F.col("bx") > x)) & (y > low) & ((y < high) | (F.col("vertical") & (y == high))), F.col("v")).otherwise(0)

    # The first leg may cross the piece itself; the second ends on it.
    upright = F.when(other, upright_leg(cx, cy, F.col("my")) + level_leg(F.col("my"), cx, F.col("mx"))).otherwise(0)
    slanted = level_leg(cy, cx, F.col("mx")) + F.when(other, upright_leg(F.col("mx"), cy, F.col("my"))).otherwise(0)
    step = F.when(F.col("vertical"), upright).otherwise(slanted)
    steps = met.select("e", step.alias("step")).groupBy("e").agg(F.sum("step").alias("step"))
    known = middles.select("e", "w", "vertical", "depth").join(steps, "e", "left")
    came = F.col("depth") + F.coalesce("step", F.lit(0))
    sides = known.select("e", F.when(F.col("vertical"), came).otherwise(came + F.col("w")).alias("left"), F.when(F.col("vertical"), came - F.col("w")).otherwise(came).alias("right"))
    on_left, on_right = F.col("left") >= least, F.col("right") >= least
    kept = pieces.join(sides.where(on_left != on_right), "e")
    ends = [F.when(on_left, F.col(f"{a}{k}")).otherwise(F.col(f"{b}{k}")).alias(f"{a}{k}") for a, b in (("a", "b"), ("b", "a")) for k in "xy"]
    return kept.select("group", *ends)


def _linked(edges: DataFrame) -> DataFrame:
    """``(e, next, ...)``: each edge with the one that goes on with the same side inside, the first to the left of the way back."""
    e = settle(edges.withColumn("e", F.monotonically_increasing_id()), "boundary")
    away = e.select("group", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("e").alias("next"), F.col("bx").alias("nx"), F.col("by").alias("ny"))
    met = _meet(e, away, "bx", "by")
    back = F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx"))
    turn = F.pmod(back - F.atan2(F.col("ny") - F.col("by"), F.col("nx") - F.col("bx")), F.lit(2 * math.pi))
    turn = F.when(turn <= 1e-15, F.lit(2 * math.pi)).otherwise(turn)
    chosen = met.groupBy("e").agg(F.min_by("next", F.struct(turn, F.col("next"))).alias("next"))
    return e.join(chosen, "e")


def ring_vertices(edges: DataFrame) -> DataFrame:
    """``(group, ring, position, x, y)`` of the rings that directed edges form.

    Pointers double: after k rounds an edge knows the least number among the next
    2^k, and then, counted from there, its place.
    """
    linked = settle(_linked(edges), "links")
    if linked.select("next").distinct().count() != linked.count():
        raise ValueError("the edges do not form rings")

    def nearer(rows: DataFrame) -> DataFrame:
        ahead = rows.select(F.col("e").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("ring").alias("ring2"))
        return rows.join(ahead, "ptr").select("e", F.col("ptr2").alias("ptr"), F.least("ring", "ring2").alias("ring"))

    state, rounds, moved = linked.select("e", F.col("next").alias("ptr"), F.least("e", "next").alias("ring")), 1, True
    while moved:
        twice = nearer(nearer(state)).join(state.select("e", F.col("ring").alias("old")), "e")
        state, rounds = settle(twice.select("e", "ptr", "ring", (F.col("ring") < F.col("old")).alias("moved")), "rings"), rounds + 2
        moved, state = not state.where("moved").isEmpty(), state.drop("moved")

    def farther(rows: DataFrame) -> DataFrame:
        ahead = rows.select(F.col("e").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("left").alias("left2"))
        return rows.join(ahead, "ptr", "left").select("e", "ring", F.col("ptr2").alias("ptr"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left"))

    # Each edge's distance to the last edge of its ring, the one before the least.
    goes_on = F.col("next") != F.col("ring")
    ranks = linked.select("e", "next").join(state, "e").select("e", "ring", F.when(goes_on, F.col("next")).alias("ptr"), goes_on.cast("long").alias("left"))
    for _ in range(0, rounds, 2):
        ranks = settle(farther(farther(ranks)), "ranks")
    return linked.join(ranks, "e").select("group", "ring", (-F.col("left")).alias("position"), F.col("ax").alias("x"), F.col("ay").alias("y"))


def _loops(ring: list) -> list:
    """A closed walk as rings that visit no vertex twice: a loop is cut off where the walk comes back."""
    out, path, at = [], [], {}
    for v in ring:
        p = (v["x"], v["y"])
        if p in at:
            k = at[p]
            out.append(path[k:])
            for q in path[k:]:
                at.pop(q, None)
            path = path[:k]
        at[p] = len(path)
        path.append(p)
    out.append(path)
    return [[{"x": x, "y": y} for x, y in loop] for loop in out if len(loop) > 2]


def _straightened(v: Column) -> Column:
    """A ring's open list of vertices without those in the middle of a straight line."""
    n = F.size(v)
    before = lambda k: F.get(v, F.pmod(k - 1, n))
    after = lambda k: F.get(v, F.pmod(k + 1, n))

    def bends(p: Column, k: Column) -> Column:
        a, b = before(k), after(k)
        cross = (p["x"] - a["x"]) * (b["y"] - p["y"]) - (p["y"] - a["y"]) * (b["x"] - p["x"])
        return F.abs(cross) > 10.0**-DIGITS * F.hypot(b["x"] - a["x"], b["y"] - a["y"])

    return F.filter(v, bends)


def polygons_of(edges: DataFrame) -> DataFrame:
    """``(group, shape)``: a row for each polygon that a boundary's rings form, with its holes."""
    found = ring_vertices(edges).groupBy("group", "ring").agg(F.sort_array(F.collect_list(F.struct("position", "x", "y"))).alias("v"))
    open_ring = F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    walks = settle(found.select("group", open_ring.alias("v")).withColumn("simple", F.size(F.array_distinct("v")) == F.size("v")), "walks")
    rings, touching = walks.where("simple"), walks.where("NOT simple")
    if not touching.isEmpty():
        loops = F.udf(_loops, "array<array<struct<x:double,y:double>>>", useArrow=True)
        rings = rings.unionByName(touching.select("group", F.explode(loops("v")).alias("v"), "simple"))
    rings = settle(rings.select("group", _straightened(F.col("v")).alias("v")), "straight_rings").where(F.size("v") > 2)
    rings = settle(rings.select("group", F.concat("v", F.slice("v", 1, 1)).alias("ring")).withColumn("id", F.monotonically_increasing_id()), "result_rings")
    rings = rings.withColumn("area", shapes.signed_area(F.col("ring")))
    outer, holes = rings.where("area > 0"), rings.where("area < 0")
    # A hole belongs to the smallest outer ring that has it; both lie in one cell of a grid of its own scale.
    own = _holes_in(outer, holes)
    per = own.groupBy("outer").agg(F.array_sort(F.collect_list("ring")).alias("holes"))
    parts = outer.join(per, outer["id"] == per["outer"], "left")
    return parts.select("group", shapes.polygon(F.col("ring")).alias("whole"), F.coalesce("holes", F.array().cast(f"array<{shapes.RING}>")).alias("holes")).select(
        "group", shapes.shape(F.lit("Polygon"), F.array(F.concat(F.col("whole.parts")[0], F.col("holes")))).alias("shape")
    )


def _holes_in(outer: DataFrame, holes: DataFrame) -> DataFrame:
    """``(outer, ring)``: the outer ring that each hole belongs to.

    Outer rings stand in the cells of a grid as large as themselves, four at most, so
    that a hole looks in one cell of each size of ring that there is.
    """
    box = lambda r: geometry.bounds(F.struct(F.lit("Polygon").alias("type"), r.alias("coords")))
    rings = outer.select("group", F.col("id").alias("outer"), F.col("ring").alias("around"), F.col("area").alias("size"), box(F.col("ring")).alias("b"))
    scale = F.ceil(F.log2(F.greatest(F.col("b.max_x") - F.col("b.min_x"), F.col("b.max_y") - F.col("b.min_y")))).cast("int")
    cell = lambda v, s: F.floor(v / F.pow(F.lit(2.0), s)).cast("long")
    rings = rings.withColumn("scale", scale)
    rings = rings.withColumn("i", F.explode(F.sequence(cell(F.col("b.min_x"), F.col("scale")), cell(F.col("b.max_x"), F.col("scale")))))
    rings = rings.withColumn("j", F.explode(F.sequence(cell(F.col("b.min_y"), F.col("scale")), cell(F.col("b.max_y"), F.col("scale")))))
    scales = [r["scale"] for r in rings.select("scale").distinct().collect()]  # powers of two of a double: 2 100 at most
    middle = F.struct(((F.col("ring")[0]["x"] + F.col("ring")[1]["x"]) / 2).alias("x"), ((F.col("ring")[0]["y"] + F.col("ring")[1]["y"]) / 2).alias("y"))
    asking = holes.select("group", F.col("id").alias("hole"), "ring", middle.alias("p"))
    asking = asking.withColumn("scale", F.explode(F.array(*(F.lit(s) for s in scales)) if scales else F.array().cast("array<int>")))
    asking = asking.withColumns({"i": cell(F.col("p.x"), F.col("scale")), "j": cell(F.col("p.y"), F.col("scale"))})
    met = _meet(asking, rings, "scale", "i", "j").where(shapes.covers_point(shapes.polygon(F.col("around")), F.col("p")))
    return met.groupBy("hole").agg(F.min_by(F.struct("outer", "ring"), F.struct("size", "outer")).alias("x")).select("x.outer", "x.ring")


def dissolve(df: DataFrame, by: str, shape: str = "shape", aggregations: dict[str, str] | None = None, order: str | None = None) -> DataFrame:
    """The union of each group's polygons: ``(by, aggregates, shape)``, a row for each polygon of it.

    ``aggregations`` maps columns to operations, over the group's rows. Rows without a
    polygon count in the aggregates only; a null group is a group.
    """
    parts = polygons_of(boundary(polygon_edges(df, by, shape)))
    extra = {f"{c}_{op}": aggregate(c, op, order) for c, op in (aggregations or {}).items()}
    if not extra:
        return parts.select(F.col("group").alias(by), "shape")
    per = df.groupBy(F.col(by).alias("_g")).agg(*(c.alias(n) for n, c in extra.items()))
    return parts.join(per, parts["group"].eqNullSafe(per["_g"])).select(F.col("group").alias(by), *extra, "shape")


def intersection(left: DataFrame, right: DataFrame, left_id: str, right_id: str, shape: str = "shape", cell: float | None = None) -> DataFrame:
    """``(left_id, right_id, shape)``: what polygons of both sides have in common, a row for each part; neither needs to be convex, and holes stay holes.

    A polygon's parts must not overlap each other. ``cell`` is the size of the cells in which bounds are compared.
    """
    pairs = bounds_join(left, right, left_id, right_id, shape, cell)
    sides = [side.select(F.col(name).alias(f"{end}_id"), F.col(shape).alias("shape")) for side, name, end in ((left, left_id, "left"), (right, right_id, "right"))]
    group = F.struct("left_id", "right_id").alias("pair")
    rows = [pairs.join(side, f"{end}_id").select(group, "shape") for side, end in zip(sides, ("left", "right"), strict=True)]
    parts = polygons_of(boundary(polygon_edges(rows[0].unionByName(rows[1]), "pair", "shape"), least=2))
    return parts.select("group.left_id", "group.right_id", "shape")


def _slopes(s: Column) -> Column:
    """A polygon's edges that are not upright, from left to right: of each ``x0, x1, y0, y1``, and 1 where the inside is below and -1 where it is above."""
    def of(part: Column) -> Column:
        turn = lambda r, k: F.when(k == 0, 1.0).otherwise(-1.0) * F.signum(shapes.signed_area(r))
        back = lambda e: e["b"]["x"] < e["a"]["x"]
        end = lambda e, p, q, x: F.when(back(e), e[q][x]).otherwise(e[p][x])
        rings = F.transform(part, lambda r, k: F.struct(shapes._ring_segments(r).alias("edges"), turn(r, k).alias("turn")))  # a ring's turn is found once
        edges = lambda r: F.transform(
            F.filter(r["edges"], lambda e: e["a"]["x"] != e["b"]["x"]),
            lambda e: F.array(end(e, "a", "b", "x"), end(e, "b", "a", "x"), end(e, "a", "b", "y"), end(e, "b", "a", "y"), F.when(back(e), 1.0).otherwise(-1.0) * r["turn"])
        )
        return F.flatten(F.transform(rings, edges))

    return F.flatten(F.flatten(F.transform(s["parts"], of)))


def intersection_areas(left: DataFrame, right: DataFrame, left_id: str, right_id: str, shape: str = "shape", cell: float | None = None) -> DataFrame:
    """``(left_id, right_id, area)``: how much polygons of both sides have in common, for pairs with more than nothing.

    A polygon is what lies below its upper edges less what lies below its lower ones, so the area is a
    sum over pairs of edges of what lies below both; it needs no pieces and rings. A polygon's parts
    must not overlap each other, and what rounding alone can make counts as nothing.

    Pairs are found and summed where both polygons' rows meet, and are not shuffled; only those of ids with several rows are, to be added up.
    """
    sides, several = [], False
    for df, name, side in ((left, left_id, "left"), (right, right_id, "right")):
        repeated = settle(df.groupBy(F.col(name).alias("id")).count().where("count > 1").select("id"), "repeated")
        rows = df.where(shapes.is_polygon(F.col(shape))).select(F.col(name).alias("_id"), F.col(shape).alias("_shape"), F.lit(False).alias("_again"))
        if not repeated.isEmpty():
            several = True
            rows = rows.drop("_again").join(repeated.withColumn("_again", F.lit(True)), F.col("_id").eqNullSafe(F.col("id")), "left")
        keep = {"edges": _slopes(F.col("_shape")), "again": F.coalesce("_again", F.lit(False))}
        extents = [F.col(f"{side}_max_{k}") - F.col(f"{side}_min_{k}") < float("inf") for k in "xy"]  # not where one is no number
        sides.append(_placed(rows, "_id", side, "_shape", cell, 0.0, keep).where(F.size(f"{side}_edges") > 0).where(extents[0] & extents[1]))
    kind = "left_id {}, right_id {}, area double, all double".format(*(dict(s.dtypes)[f"{n}_id"] for s, n in zip(sides, ("left", "right"), strict=True)))
    met = _met_in_cells(*sides, _PAIRS_A_BLOCK)

    def found(again: bool) -> DataFrame:
        parts = []
        for large, small, rows, pairs in met:
            blocks = max(1, -(-pairs // max(1, _PAIRS_A_BLOCK // 8)), -(-rows // _ROWS_A_BLOCK))
            tasks = min(blocks, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // (_PAIRS_A_BLOCK * 8))), 20_000)
            block = F.pmod(F.xxhash64(*_DEALT), F.lit(blocks)).alias("block")
            one, two = (side.select("*", block).repartition(tasks, "block").groupBy("block") for side in (large, small))
            parts.append(one.cogroup(two).applyInArrow(_block_areas(again), kind))
        return parts[0].unionByName(parts[1])

    areas = found(False)
    if several:
        areas = areas.unionByName(found(True).groupBy("left_id", "right_id").agg(F.sum("area").alias("area"), F.sum("all").alias("all")))
    return areas.where("area > all * 1e-13").drop("all")


#: Numbers that tell an edge.
_SLOPE = 5
#: Candidate pairs of a crowded cell's part, and rows of a block of cells, about.
_PAIRS_A_BLOCK, _ROWS_A_BLOCK = 8_000_000, 16_384
#: Candidates, pairs and pairs of edges looked at in one step, whose arrays then stay in a core's cache, and rows of a batch.
_STEP, _BATCH = 8192, 65_536
#: Edges of polygons that are taken one after the other, for many pairs at once.
_FEW_EDGES = 16


class _Block:
    """One side of a block of cells as arrays, in an order of its rows."""

    def __init__(self, table: pa.Table, side: str, order: np.ndarray | None = None):
        table = table.rename_columns([c.removeprefix(f"{side}_") for c in table.column_names])
        table = (table if order is None else table.take(pa.array(order))).combine_chunks()
        self.id, self.again = table["id"].combine_chunks(), table["again"].to_numpy()
        self.bounds = [table[k].to_numpy() for k in ("min_x", "min_y", "max_x", "max_y")]
        self.size = 2.0 ** table["scale"].to_numpy()
        self.i, self.j = table["i"].to_numpy(), table["j"].to_numpy()
        # 1 where the row begins in its cell by x, and 2 where it does by y.
        starts = [np.floor(self.bounds[k] / self.size).astype(np.int64) == c for k, c in ((0, self.i), (1, self.j))]
        self.first = starts[0].astype(np.int8) + 2 * starts[1].astype(np.int8)
        edges = table["edges"].combine_chunks()
        self.n = pc.list_value_length(edges).to_numpy() // _SLOPE
        self.start = np.cumsum(self.n) - self.n
        self.edges = np.ascontiguousarray(edges.flatten().to_numpy().reshape(-1, _SLOPE).T)
        self.level = bool((self.edges[2] == self.edges[3]).all())

    def by_place(self) -> np.ndarray:
        """The rows' first, second, ... edges; rows of fewer have some of no weight there."""
        rows, k = _runs(np.zeros(len(self.n), dtype=np.int64), self.n)
        out = np.zeros((np.max(self.n, initial=0), _SLOPE, len(self.n)))
        out[:, 1] = 1.0
        out[k, :, rows] = self.edges.T
        return out


def _runs(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of runs and what they hold: ``n`` numbers from ``start`` on, one run after the other."""
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) + np.repeat(start - (np.cumsum(n) - n), n)


def _steps(n: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Cuts of rows that stand for ``n`` each, with about ``size`` in a step."""
    ends = np.cumsum(n)
    cuts = np.unique(np.searchsorted(ends, np.arange(size, ends[-1], size)) + 1) if len(n) else []
    return [(int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(n)], strict=True) if a < b]


def _near_in_block(large: pa.Table, small: pa.Table, sides: tuple[str, str]) -> tuple[_Block, _Block, np.ndarray, np.ndarray]:
    """Both sides, the second in an order in which each row of the first has the rows of its cell that are near it by x in a run ``(start, n)``."""
    cells = pd.concat([t.select(_DEALT).to_pandas() for t in (large, small)], ignore_index=True).groupby(_DEALT, sort=False).ngroup().to_numpy()
    one, two = _Block(large, sides[0]), _Block(small, sides[1])
    # Rows begin less than a cell before theirs; the cells lie side by side in steps of four.
    place = lambda c, b, x: 4.0 * c + np.clip(x / b.size - b.i, -1, 1) + 1
    cell, own = cells[: len(one.n)], place(cells[len(one.n) :], two, two.bounds[0])
    order = np.argsort(own, kind="stable")
    own, width = own[order], np.max((two.bounds[2] - two.bounds[0]) / two.size, initial=0.0) * one.size
    ends = [np.searchsorted(own, place(cell, one, x) + e, side) for x, e, side in ((one.bounds[0] - width, -1e-6, "left"), (one.bounds[2], 1e-6, "right"))]
    return one, _Block(small, sides[1], order), ends[0], np.maximum(ends[1] - ends[0], 0)


def _below_both(e: np.ndarray, f: np.ndarray, foot: np.ndarray, level: bool) -> np.ndarray:
    """The area below both of each two edges, above their foot and with their signs."""
    x0, x1 = np.maximum(e[0], f[0]), np.minimum(e[1], f[1])
    width = np.maximum(x1 - x0, 0.0)
    if level:
        return e[4] * f[4] * width * (np.minimum(e[2], f[2]) - foot)
    height = lambda g, x: g[2] + (x - g[0]) / (g[1] - g[0]) * (g[3] - g[2]) - foot
    e0, f0, e1, f1 = height(e, x0), height(f, x0), height(e, x1), height(f, x1)
    d0, d1, low0, low1 = e0 - f0, e1 - f1, np.minimum(e0, f0), np.minimum(e1, f1)
    mean = low0 + low1
    cross = np.flatnonzero((d0 < 0) & (d1 > 0) | (d0 > 0) & (d1 < 0))
    t = d0[cross] / (d0[cross] - d1[cross])
    middle = e0[cross] + t * (e1[cross] - e0[cross])
    mean[cross] = t * (low0[cross] + middle) + (1 - t) * (middle + low1[cross])
    return np.where(width > 0, e[4] * f[4] * width / 2 * mean, 0.0)


def _areas(one: _Block, two: _Block, foot: str):
    """A function of pairs of rows: the areas that they have in common, and the sums of their parts without signs."""
    level = one.level and two.level
    low = lambda a, b: one.bounds[1][a] if foot == "one" else two.bounds[1][b]

    def few(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        area, whole, ground = np.zeros(len(a)), np.zeros(len(a)), low(a, b)
        fs = [np.take(f, b, axis=1) for f in others]
        for e in own:
            e = np.take(e, a, axis=1)
            for f in fs:
                part = _below_both(e, f, ground, level)
                area += part
                whole += np.abs(part)
        return area, whole

    def many(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        area, whole = np.zeros(len(a)), np.zeros(len(a))
        for first, last in _steps(one.n[a], _STEP):
            p, e = _runs(one.start[a[first:last]], one.n[a[first:last]])
            p += first
            for start, end in _steps(two.n[b[p]], _STEP):
                q, f = _runs(two.start[b[p[start:end]]], two.n[b[p[start:end]]])
                q += start
                over = np.maximum(one.edges[0][e[q]], two.edges[0][f]) < np.minimum(one.edges[1][e[q]], two.edges[1][f])
                if not over.any():
                    continue
                q, f = q[over], f[over]
                r = p[q]
                part = _below_both(one.edges[:, e[q]], two.edges[:, f], low(a[r], b[r]), level)
                for total, v in ((area, part), (whole, np.abs(part))):
                    total[r[0] : r[-1] + 1] += np.bincount(r - r[0], v)
        return area, whole

    if max(np.max(one.n, initial=0), np.max(two.n, initial=0)) > _FEW_EDGES:
        return many
    own, others = one.by_place(), two.by_place()
    return few


def _block_areas(again: bool):
    """Areas in common of pairs in a block of cells, of which an id is on several rows, or neither is."""

    def pairs(one: _Block, two: _Block, start: np.ndarray, n: np.ndarray):
        for first, last in _steps(n, _STEP):
            a, b = _runs(start[first:last], n[first:last])
            a += first
            meets = (one.first[a] | two.first[b]) == 3  # the pair counts in the first cell that both stand in
            for k in (0, 1):
                meets &= (one.bounds[k][a] <= two.bounds[k + 2][b]) & (one.bounds[k + 2][a] >= two.bounds[k][b])
            a, b = a[meets], b[meets]
            wanted = (one.again[a] | two.again[b]) == again
            yield a[wanted], b[wanted]

    def areas(large: pa.Table, small: pa.Table) -> pa.Table:
        turned = "right_id" in large.column_names
        one, two, start, n = _near_in_block(large, small, ("right", "left") if turned else ("left", "right"))
        of, found, waiting, size = _areas(one, two, "two" if turned else "one"), [], [], 0

        def batch() -> pa.RecordBatch:
            a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *side]) for side in (zip(*waiting, strict=True) if waiting else ([], [])))
            cuts = [of(a[k : k + _STEP], b[k : k + _STEP]) for k in range(0, max(len(a), 1), _STEP)]
            ids = [one.id.take(pa.array(a)), two.id.take(pa.array(b))]
            return pa.RecordBatch.from_arrays([*(ids[::-1] if turned else ids), *(np.concatenate(v) for v in zip(*cuts, strict=True))], ["left_id", "right_id", "area", "all"])

        for a, b in pairs(one, two, start, n):
            waiting.append((a, b))
            size += len(a)
            if size >= _BATCH:
                found.append(batch())
                waiting, size = [], 0
        return pa.Table.from_batches([*found, batch()])

    return areas


#: Candidate pairs that a task compares, about.
_PAIRS_A_TASK = 2_000_000
#: The cell that rows meet in, and the parts of a crowded one.
_AT, _DEALT = ["scale", "i", "j"], ["scale", "i", "j", "large_part", "small_part"]


def _placed(df: DataFrame, name: str, side: str, shape: str, cell: float | None, grow: float, keep: dict[str, Column]) -> DataFrame:
    """``(side_id, side_..., side_min_x, ..., side_scale)``: the rows' bounds, and the power of two that they fit in."""
    b = shapes.bounds(F.col(shape))
    rows = df.where(F.col(shape).isNotNull()).select(F.col(name).alias(f"{side}_id"), *(c.alias(f"{side}_{k}") for k, c in keep.items()), b.alias("b"))
    own = [f"{side}_id", *(f"{side}_{k}" for k in keep)]
    rows = rows.select(*own, *((F.col(f"b.{k}") + (grow if k.startswith("max") else -grow)).alias(f"{side}_{k}") for k in ("min_x", "min_y", "max_x", "max_y")))
    extent = F.greatest(F.col(f"{side}_max_x") - F.col(f"{side}_min_x"), F.col(f"{side}_max_y") - F.col(f"{side}_min_y"), F.lit(cell or 1e-12))
    return settle(rows.withColumn(f"{side}_scale", F.ceil(F.log2(extent)).cast("int")), "placed")


def _met_in_cells(left: DataFrame, right: DataFrame, pairs_a_part: int) -> list[tuple[DataFrame, DataFrame, int, int]]:
    """Placed rows in cells ``_DEALT``, as large and small ones that meet there, with their number and that of their pairs.

    Rows stand in the grid as large as themselves; the smaller look for the larger in that one's.
    Both sides of a crowded cell are cut into parts with about ``pairs_a_part`` pairs of each two.
    """
    size = lambda s: F.pow(F.lit(2.0), s)

    def spread(df: DataFrame, side: str, scale: Column) -> DataFrame:
        out = df.withColumn("scale", scale)
        for n, k in (("i", "x"), ("j", "y")):
            ends = [F.floor(F.col(f"{side}_{m}_{k}") / size(F.col("scale"))).cast("long") for m in ("min", "max")]
            out = out.withColumn(n, F.explode(F.sequence(*ends)))
        return out

    def dealt(df: DataFrame, side: str, crowded: DataFrame, own: str, other: str) -> DataFrame:
        number = F.xxhash64(f"{side}_id", *(f"{side}_{m}_{k}" for m in ("min", "max") for k in "xy"))
        out = df.join(F.broadcast(crowded), _AT, "left").withColumn(f"{own}_part", F.pmod(number, F.coalesce(f"{own}_parts", F.lit(1)).cast("long")))
        out = out.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"{other}_parts", F.lit(1)).cast("long") - 1)))
        return out.drop("large_parts", "small_parts", f"{side}_scale")

    def met(large: DataFrame, large_side: str, small: DataFrame, small_side: str, strict: bool) -> tuple[DataFrame, DataFrame, int, int]:
        scales = [sorted(r[0] for r in df.select(f"{side}_scale").distinct().collect() if r[0] is not None) for df, side in ((large, large_side), (small, small_side))]
        wanted = [s for s in scales[0] if scales[1] and (s > scales[1][0] if strict else s >= scales[1][0])]  # powers of two of a double
        wanted = F.array(*(F.lit(s) for s in wanted)) if wanted else F.array().cast("array<int>")
        own = F.col(f"{small_side}_scale")
        looking = small.withColumn("want", F.explode(F.filter(wanted, lambda s: s > own if strict else s >= own)))
        sought = large.where(F.array_contains(wanted, F.col(f"{large_side}_scale")))
        one, two = spread(sought, large_side, F.col(f"{large_side}_scale")), spread(looking, small_side, F.col("want")).drop("want")
        number = lambda df, n: df.groupBy(*_AT).agg(F.count("*").alias(n))
        cells = settle(number(one, "m").join(number(two, "n"), _AT), "cells")
        seen = cells.agg(F.sum(F.col("m") + F.col("n")), F.sum(F.col("m") * F.col("n"))).first()
        # A cell with that many pairs has at least twice the root of them in rows, so there are few such cells.
        most, root = F.lit(float(pairs_a_part)), F.lit(math.sqrt(pairs_a_part))
        parts = lambda own, other: F.ceil(F.col(own) / F.greatest(root, most / F.col(other)))
        crowded = cells.where(F.col("m") * F.col("n") > most).select(*_AT, parts("m", "n").alias("large_parts"), parts("n", "m").alias("small_parts"))
        return dealt(one, large_side, crowded, "large", "small"), dealt(two, small_side, crowded, "small", "large"), seen[0] or 0, seen[1] or 0

    return [met(left, "left", right, "right", False), met(right, "right", left, "left", True)]


def bounds_join(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, shape: str = "shape", cell: float | None = None, reach: float = 0.0, keep: dict[str, Column] | None = None
) -> DataFrame:
    """``(left_id, right_id)`` of shapes whose bounds come within ``reach``, each pair once.

    Bounds stand in cells of a grid as large as themselves, four at most; of two shapes the
    smaller looks for the larger in that one's grid. A given ``cell`` is the least size.
    ``keep`` names columns of both sides that come along as ``left_`` and ``right_``, so that
    pairs needn't be joined to their shapes again. Crowded cells are dealt to several tasks.
    """
    keep = keep or {}
    size = lambda s: F.pow(F.lit(2.0), s)
    a, b = _placed(left, left_id, "left", shape, cell, reach, keep), _placed(right, right_id, "right", shape, cell, 0.0, keep)
    columns = ["left_id", "right_id", *_AT, *(f"{s}_{k}" for s in ("left", "right") for k in ("min_x", "min_y", "max_x", "max_y", *keep))]
    both = []
    for large, small, _, pairs in _met_in_cells(a, b, _PAIRS_A_TASK):
        tasks = min(max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // _PAIRS_A_TASK)), 20_000)
        both.append(large.repartition(tasks, *_DEALT).join(small, _DEALT).select(*columns))
    rows = both[0].unionByName(both[1])
    # The pair counts in the first cell that both stand in.
    first = lambda k: F.floor(F.greatest(f"left_min_{k}", f"right_min_{k}") / size(F.col("scale"))).cast("long")
    meets = lambda k: (F.col(f"left_min_{k}") <= F.col(f"right_max_{k}")) & (F.col(f"left_max_{k}") >= F.col(f"right_min_{k}"))
    found = rows.where(meets("x") & meets("y") & (F.col("i") == first("x")) & (F.col("j") == first("y")))
    return found.select("left_id", "right_id", *(f"{s}_{k}" for s in ("left", "right") for k in keep))


def _predicate(name: str):
    tests = {"intersects": shapes.intersects, "within": shapes.within, "contains": lambda s, t: shapes.within(t, s)}
    if name not in tests:
        raise ValueError(f"unknown predicate: {name}")
    return tests[name]


def shape_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, predicate: str = "intersects", shape: str = "shape", how: str = "inner") -> DataFrame:
    """``(left_id, right_id)`` of shapes of which the left one ``intersects``, is ``within`` or ``contains`` the right one; holes and parts count."""
    test = _predicate(predicate)
    pairs = bounds_join(left, right, left_id, right_id, shape, keep={"shape": F.col(shape)})
    met = pairs.where(test(F.col("left_shape"), F.col("right_shape"))).select("left_id", "right_id")
    return left.select(F.col(left_id).alias("left_id")).join(met, "left_id", "left") if how == "left" else met


def _numbered(df: DataFrame, id_col: str, shape: str) -> tuple[DataFrame, DataFrame]:
    """The distinct shapes of rows ``(number, n, shape)``, with ``n`` rows each, and the rows' ids ``(number, id)``; null shapes have no number."""
    rows = df.select(F.col(id_col).alias("id"), F.col(shape).alias("shape"))
    known = settle(rows.where("shape is not null").groupBy("shape").agg(F.count("*").alias("n")).withColumn("number", F.monotonically_increasing_id()), "shapes")
    return known, rows.join(known.select("number", "shape"), "shape", "left").select("id", "number")


def shape_counts(left: DataFrame, right: DataFrame, left_id: str, predicate: str = "intersects", shape: str = "shape") -> DataFrame:
    """``(left_id, n)``: how many right shapes each left row intersects, is within or contains; rows without any have 0.

    Equal shapes are tried once, for all their rows.
    """
    one, ids = _numbered(left, left_id, shape)
    two = right.where(F.col(shape).isNotNull()).groupBy(F.col(shape).alias("shape")).agg(F.count("*").alias("n"))
    two = settle(two.withColumn("number", F.monotonically_increasing_id()), "shapes")
    met = bounds_join(one, two, "number", "number", keep={"shape": F.col("shape"), "n": F.col("n")})
    per = met.where(_predicate(predicate)(F.col("left_shape"), F.col("right_shape"))).groupBy("left_id").agg(F.sum("right_n").alias("found"))
    return ids.join(per.withColumnRenamed("left_id", "number"), "number", "left").select(F.col("id").alias("left_id"), F.coalesce("found", F.lit(0)).alias("n"))


def _capsule(a: Column, b: Column, distance: float, resolution: int) -> Column:
    """The ring around an edge: a regular polygon of ``4 * resolution`` corners moved from a to b; around a point that polygon."""
    n = 4 * resolution
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]

    def corner(k: Column) -> Column:
        x, y = distance * F.cos(k * (2 * math.pi / n)), distance * F.sin(k * (2 * math.pi / n))
        side = lambda angle: dx * F.cos(angle) + dy * F.sin(angle) > 0
        start, end = side((k - 0.5) * (2 * math.pi / n)), side((k + 0.5) * (2 * math.pi / n))
        at = lambda far: geometry.vertex(F.when(far, b["x"]).otherwise(a["x"]) + x, F.when(far, b["y"]).otherwise(a["y"]) + y)
        return F.when(start == end, F.array(at(start))).otherwise(F.array(at(start), at(end)))

    corners = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), corner))
    return F.concat(corners, F.slice(corners, 1, 1))


def capsules(df: DataFrame, distance: float, resolution: int = 16, shape: str = "shape", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(keep..., shape)``: polygons whose union is the buffer of each row's shape: one around each edge or lone point, and polygons themselves."""
    if distance < 0 or resolution <= 0:
        raise ValueError("the distance must not be negative, and the resolution positive")
    s = F.col(shape)
    lone = F.transform(F.filter(shapes.rings(s), lambda r: F.size(r) == 1), lambda r: F.struct(r[0].alias("a"), r[0].alias("b")))
    edges = df.where(s.isNotNull()).select(*keep, F.explode(F.concat(shapes.segments(s), lone)).alias("e"))
    around = edges.select(*keep, shapes.polygon(_capsule(F.col("e.a"), F.col("e.b"), distance, resolution)).alias("shape"))
    own = df.where(s.isNotNull() & shapes.is_polygon(s)).select(*keep, s.alias("shape"))
    return around.unionByName(own) if distance > 0 else own


def buffer(df: DataFrame, id_col: str, distance: float, resolution: int = 16, shape: str = "shape") -> DataFrame:
    """``(id, shape)``: everything within ``distance`` of each shape, lines and polygons too, a row for each part.

    Circles have ``4 * resolution`` corners at the distance. At distance zero points and lines have none.
    """
    return dissolve(capsules(df, distance, resolution, shape, (id_col,)), id_col)


def buffer_shape_join(left: DataFrame, right: DataFrame, distance: float, left_id: str, right_id: str, how: str = "inner", resolution: int = 16, shape: str = "shape") -> DataFrame:
    """``(left_id, right_id)`` of left shapes whose buffer meets the right one. A buffer is the union of its capsules, so these are tried, and nothing is united."""
    around = capsules(left, distance, resolution, shape, (left_id,)).withColumn("_piece", F.monotonically_increasing_id())
    around = settle(around, "capsules")
    met = shape_join(around, right.select(right_id, F.col(shape).alias("shape")), "_piece", right_id)
    pairs = met.join(around.select(F.col("_piece").alias("left_id"), F.col(left_id).alias("_left")), "left_id").select(F.col("_left").alias("left_id"), "right_id").distinct()
    return left.select(F.col(left_id).alias("left_id")).join(pairs, "left_id", "left") if how == "left" else pairs
