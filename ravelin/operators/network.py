"""Least-cost search and screens over networks in rounds.

An edge table has ``edge_id, from_node, to_node, cost`` and, where needed,
``capacity``. Every round searches the blocks of nodes that something came into
and keeps the least cost of each node, until nothing changes; rounds are
written out, so plans stay short and lost executors cost little. Costs have a total
order with the predecessor's edge, so results don't depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.equations import stress_index
from ..session import settle
from . import blocks


def both_ways(edges: DataFrame) -> DataFrame:
    """An undirected network's edges in both directions."""
    swap = {"from_node": "to_node", "to_node": "from_node"}
    return edges.unionByName(edges.select(*[F.col(c).alias(swap.get(c, c)) for c in edges.columns]))


def impedance(factors: dict[str, float], base: str = "cost") -> Column:
    """A weighted cost: the base times one plus the weighted factors."""
    out = F.lit(1.0)
    for name, weight in sorted(factors.items()):
        out = out + weight * F.coalesce(F.col(name), F.lit(0.0))
    return F.col(base) * out


def least_costs(edges: DataFrame, sources: DataFrame, max_cost: float | None = None, max_rounds: int = 10_000) -> DataFrame:
    """``(source, node, cost, edge_id, hops)`` of all nodes reached from each row of ``sources(source, node)``.

    ``edge_id`` is the last edge of a least path. Negative costs are an error.
    """
    steps, node_blocks = blocks.in_blocks(costed(edges))
    found = blocks.search(steps, node_blocks, sources.select("source", "node", F.lit(0.0).alias("cost")), max_cost, max_rounds=max_rounds)
    return found.select("source", "node", "cost", F.nullif("edge_id", F.lit("")).alias("edge_id"), "hops")


def costed(edges: DataFrame) -> DataFrame:
    """Edges as steps of a search; negative costs are an error."""
    return edges.select(
        "from_node", "to_node",
        F.when(F.col("cost") >= 0, F.col("cost")).otherwise(
            F.raise_error(F.lit("costs must not be negative")).cast("double")
        ).alias("step"),
        F.lit(1).cast("long").alias("hop"), F.col("edge_id").cast("string").alias("by")
    )


#: Edges that a round of a closure goes on.
_HOPS = 4
_union, _compact = blocks.union, blocks.compact


def _closure(start: DataFrame, step, keys: list[str]) -> DataFrame:
    """All rows reached from ``start`` by ``step``, a few steps a round; each round writes only what is new."""
    moved = settle(start.distinct(), "reached")
    found = [moved]
    while True:
        hops = [step(moved).distinct()]
        for _ in range(_HOPS - 1):
            hops.append(step(hops[-1]).distinct())
        moved = settle(_union(hops).distinct().join(_union(found), keys, "left_anti"), "reached")
        if moved.isEmpty():
            return _union(found)
        found = _compact([*found, moved])


def service_area(edges: DataFrame, source, max_cost: float) -> DataFrame:
    """``(node, cost)`` within a cost of one node."""
    start = edges.sparkSession.range(1).select(
        F.lit(source).alias("source"), F.lit(source).cast(edges.schema["from_node"].dataType).alias("node")
    )
    return least_costs(edges, start, max_cost).select("node", "cost")


def od_costs(edges: DataFrame, origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """``(origin, destination, cost)`` from nodes of the network to given nodes; unreachable is infinite."""
    nodes = edges.select(F.col("from_node").alias("node")).union(edges.select("to_node")).distinct()
    known = origins.select(F.col("node")).distinct().join(nodes, "node", "left_semi")
    found = least_costs(edges, known.select(F.col("node").alias("source"), "node"))
    wanted = known.select(F.col("node").alias("origin")).join(
        destinations.select(F.col("node").alias("destination")).distinct(), how="cross"
    )
    out = wanted.join(
        found.select(F.col("source").alias("origin"), F.col("node").alias("destination"), "cost"), ["origin", "destination"], "left"
    )
    return out.select("origin", "destination", F.coalesce("cost", F.lit(float("inf"))).alias("cost"))


def nearest_supply(edges: DataFrame, supplies: DataFrame, demands: DataFrame) -> DataFrame:
    """``(demand_node, supply_node, cost)``: for each demand the supply of least cost, ties by node.

    ``edges`` lead from supplies to demands. One label a node is carried, so the
    search costs no more with many supplies than with one.
    """
    steps = edges.select("from_node", "to_node", F.col("cost").alias("step"))
    least = lambda df: df.groupBy("node").agg(F.min(F.struct("cost", "supply")).alias("best"))
    moved = settle(supplies.select("node", F.lit(0.0).alias("cost"), F.col("node").alias("supply")).distinct(), "supply")
    found = [moved]
    while True:
        tried = moved.join(steps, moved["node"] == steps["from_node"]).select(
            F.col("to_node").alias("node"), F.struct((F.col("cost") + F.col("step")).alias("cost"), "supply").alias("new")
        )
        tried = tried.groupBy("node").agg(F.min("new").alias("new"))
        moved = tried.join(least(_union(found)), "node", "left").where(F.col("best").isNull() | (F.col("new") < F.col("best")))
        moved = settle(moved.select("node", "new.*"), "supply")
        if moved.isEmpty():
            break
        found = _compact([*found, moved], lambda df: least(df).select("node", "best.*"))
    best = least(_union(found)).select("node", "best.*")
    wanted = demands.select(F.col("node")).distinct().join(best, "node", "left")
    return wanted.select(
        F.col("node").alias("demand_node"), F.col("supply").alias("supply_node"), F.coalesce("cost", F.lit(float("inf"))).alias("cost")
    )


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the least node of each undirected component, by alternating star steps."""

    def ordered(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    nodes = edges.select(F.col("from_node").alias("node")).union(edges.select("to_node")).distinct()
    pairs = settle(ordered(edges.select(F.col("from_node").alias("u"), F.col("to_node").alias("v"))), "stars")
    before = mark(pairs)
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ordered(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v"))
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = settle(
            ordered(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v"))), "stars"
        )
        after = mark(pairs)
        if after == before:
            break
        before = after
    return nodes.join(
        pairs.withColumnsRenamed({"u": "node", "v": "component"}), "node", "left"
    ).select("node", F.coalesce("component", "node").alias("component"))


def topology(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, self-loops, repeated undirected pairs."""
    comps = components(edges)
    loops = edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("from_node") == F.col("to_node")).alias("n_loops"))
    pair = edges.where("from_node <> to_node").groupBy(
        F.least("from_node", "to_node").alias("a"), F.greatest("from_node", "to_node").alias("b")
    ).count()
    repeated = pair.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_repeated"))
    counted = comps.agg(F.count("*").alias("n_nodes"), F.countDistinct("component").alias("n_components"))
    return counted.join(F.broadcast(loops)).join(F.broadcast(repeated))  # single rows


def reachable(edges: DataFrame, sources: DataFrame, failed: list[str] = (), open_devices: bool = True) -> DataFrame:
    """Nodes reached from ``sources(node)`` without failed edges and, if asked, open devices."""
    alive = edges.where(~F.col("edge_id").cast("string").isin([str(x) for x in failed])) if failed else edges
    if open_devices and "device_state" in edges.columns:
        alive = alive.where(~F.lower(F.coalesce("device_state", F.lit(""))).isin("open", "normally_open"))
    return blocks.reach(alive.select("from_node", "to_node"), sources.select(F.lit(0).alias("case"), "node")).select("node")


def outage(edges: DataFrame, sources: DataFrame, failed: list[str]) -> DataFrame:
    """``(node, energised)`` of every node of the network."""
    nodes = edges.select(F.col("from_node").alias("node")).union(edges.select("to_node")).distinct()
    fed = reachable(edges, sources, failed).withColumn("energised", F.lit(True))
    return nodes.join(fed, "node", "left").select("node", F.coalesce("energised", F.lit(False)).alias("energised"))


def edge_loads(edges: DataFrame, demands: DataFrame) -> DataFrame:
    """``(edge_id, load, stress)``: demands ``(origin, destination, demand)`` put on least paths.

    From every destination the path is walked back, all demands together.
    """
    steps, node_blocks = blocks.in_blocks(costed(edges))
    origins = demands.select(F.col("origin").alias("source"), F.col("origin").alias("node"), F.lit(0.0).alias("cost")).distinct()
    tree = blocks.rooted(blocks.search(steps, node_blocks, origins), steps)
    at = demands.select(
        F.col("origin").alias("source"), F.lit(0).alias("tag"), F.col("destination").alias("node"), F.col("demand").alias("amount")
    )
    loads = blocks.walk_back(tree, at).select("edge_id", F.col("amount").alias("demand"))
    total = loads.groupBy("edge_id").agg(F.sum("demand").alias("load"))
    capacity = edges.select(F.col("edge_id").cast("string").alias("edge_id"), "capacity").distinct()
    return capacity.join(total, "edge_id", "left").select(
        "edge_id", F.coalesce("load", F.lit(0.0)).alias("load"),
        stress_index(F.coalesce("load", F.lit(0.0)), F.col("capacity")).alias("stress")
    )


def single_edge_screen(edges: DataFrame, sources: DataFrame, demands: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(edge_id, lost_nodes, lost_demand)`` for the failure of each candidate edge alone.

    All failures are searched together: a case is a column, not a loop.
    """
    cases = candidates.select(F.col("edge_id").cast("string").alias("case")).distinct()
    base = reachable(edges, sources)
    start = cases.join(F.broadcast(sources.select("node").distinct()), how="cross")  # a few sources for each case
    found = blocks.reach(edges.select("edge_id", "from_node", "to_node"), start, lambda lanes: lanes.where("case <> by"))
    total = base.join(demands.select("node", "demand"), "node", "left").agg(F.count("*").alias("n"), F.sum("demand").alias("d"))
    kept = found.join(demands.select("node", "demand"), "node", "left").groupBy("case").agg(
        F.count("*").alias("kept_n"), F.sum("demand").alias("kept_d")
    )
    return kept.join(F.broadcast(total)).select(
        F.col("case").alias("edge_id"), (F.col("n") - F.col("kept_n")).alias("lost_nodes"),
        (F.coalesce("d", F.lit(0.0)) - F.coalesce("kept_d", F.lit(0.0))).alias("lost_demand")
    )


def shared_corridors(networks: DataFrame) -> DataFrame:
    """Undirected node pairs that two services of ``(service, from_node, to_node)`` both use."""
    pairs = networks.select("service", F.least("from_node", "to_node").alias("a"), F.greatest("from_node", "to_node").alias("b")).distinct()
    left = pairs.withColumnRenamed("service", "service_a")
    right = pairs.withColumnRenamed("service", "service_b")
    return left.join(right, ["a", "b"]).where("service_a < service_b").groupBy("service_a", "service_b").agg(F.count("*").alias("n_shared"))


def node_removal_screen(edges: DataFrame, sources: DataFrame, demands: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(node, lost_demand)`` for the removal of each candidate node alone."""
    cases = candidates.select(F.col("node").alias("case")).distinct()
    start = cases.join(F.broadcast(sources.select("node").distinct()), how="cross").where("case <> node")  # a few sources for each case
    kept = blocks.reach(edges.select("from_node", "to_node"), start, lambda lanes: lanes.where("to_node <> case")).join(
        demands.select("node", "demand"), "node"
    ).groupBy("case").agg(F.sum("demand").alias("kept"))
    total = reachable(edges, sources).join(demands.select("node", "demand"), "node").agg(
        F.coalesce(F.sum("demand"), F.lit(0.0)).alias("total")
    )
    return cases.join(kept, "case", "left").join(F.broadcast(total)).select(
        F.col("case").alias("node"), (F.col("total") - F.coalesce("kept", F.lit(0.0))).alias("lost_demand")
    )


def dependency_closure(dependencies: DataFrame, failed: DataFrame) -> DataFrame:
    """``(node, level)`` of all that fails with ``failed(node)`` over ``(node, depends_on)``, by the fewest steps."""
    edges = dependencies.select(
        F.col("depends_on").alias("from_node"), F.col("node").alias("to_node"), F.lit(1.0).alias("cost"),
        F.concat_ws(">", "depends_on", "node").alias("edge_id")
    )
    start = failed.select(F.lit("failed").alias("source"), "node")
    return least_costs(edges, start).select("node", F.col("cost").cast("long").alias("level"))


def flow_accumulation(edges: DataFrame, runoff: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``(node, flow)``: own runoff and all that flows in, over an acyclic network with one way out of a node.

    Every parcel of runoff moves one edge a round; parcels that meet go on together.
    """
    start = runoff.groupBy("node").agg(F.sum("runoff").alias("flow"))
    moved = settle(start, "flow")
    parts = [moved]
    out = edges.select("from_node", "to_node").distinct()
    for _ in range(max_rounds):
        moved = moved.join(
            out, F.col("node") == F.col("from_node")
        ).groupBy(F.col("to_node").alias("node")).agg(F.sum("flow").alias("flow"))
        moved = settle(moved, "flow")
        if moved.isEmpty():
            return _union(parts).groupBy("node").agg(F.sum("flow").alias("flow"))
        parts = _compact([*parts, moved], lambda df: df.groupBy("node").agg(F.sum("flow").alias("flow")))
    raise RuntimeError("the network has a cycle")


def pressure_trace(edges: DataFrame, source, inlet: float, drop_per_cost: float) -> DataFrame:
    """``(node, pressure)`` that is left after the least cost from a source; never below zero."""
    return service_area(edges, source, float("inf")).select(
        "node", F.greatest(F.lit(0.0), inlet - F.col("cost") * drop_per_cost).alias("pressure")
    )


def isolation_zone(edges: DataFrame, ends: list, broken: list[str]) -> DataFrame:
    """Nodes that no end reaches once the broken edges are shut."""
    spark = edges.sparkSession
    kind = edges.schema["from_node"].dataType
    start = spark.range(1).select(F.explode(F.array(*[F.lit(e).cast(kind) for e in ends])).alias("node"))
    return outage(edges, start, broken).where(~F.col("energised")).select("node")


def restoration_options(edges: DataFrame, ties: DataFrame, sources: DataFrame, failed: list[str]) -> DataFrame:
    """``(tie_id, restored_nodes)``: what closing each tie ``(tie_id, from_node, to_node)`` alone brings back.

    A tie helps if it links the fed part with another; it then feeds all that is reached from there.
    """
    alive = edges.where(~F.col("edge_id").cast("string").isin([str(x) for x in failed]))
    fed = reachable(alive, sources)
    both = ties.select(
        "tie_id", F.col("from_node").alias("a"), F.col("to_node").alias("b")
    ).union(ties.select("tie_id", "to_node", "from_node"))
    start = both.join(fed.withColumnRenamed("node", "a"), "a", "left_semi").select(
        F.col("tie_id").alias("case"), F.col("b").alias("node")
    ).join(fed, "node", "left_anti")
    step = alive.select("from_node", "to_node")
    walk = lambda df: df.join(step, df["node"] == step["from_node"]).select("case", F.col("to_node").alias("node")).join(fed, "node", "left_anti")
    gained = _closure(start.select("case", "node"), walk, ["case", "node"]).groupBy("case").agg(F.count("*").alias("restored_nodes"))
    return ties.select("tie_id").join(gained.withColumnRenamed("case", "tie_id"), "tie_id", "left").select(
        "tie_id", F.coalesce("restored_nodes", F.lit(0)).alias("restored_nodes")
    )


def shortest_path(edges: DataFrame, source, target) -> DataFrame:
    """``(step, edge_id, from_node, to_node, cost)`` of a least path; empty where there is none."""
    spark = edges.sparkSession
    kind = edges.schema["from_node"].dataType
    node = lambda v: spark.range(1).select(F.lit(v).cast(kind).alias("node"))
    tree = settle(least_costs(edges, node(source).select(F.lit("s").alias("source"), "node")), "tree")
    named = edges.select(F.col("edge_id").cast("string").alias("edge_id"), "from_node", "to_node", "cost")
    last = tree.where("edge_id is not null").select("node", "edge_id", "hops")
    into = last.join(
        named, (last["node"] == named["to_node"]) & (last["edge_id"] == named["edge_id"])
    ).select(named["edge_id"], "from_node", "to_node", named["cost"], "hops")
    on_path = _closure(
        node(target), lambda df: df.join(into, df["node"] == into["to_node"]).select(F.col("from_node").alias("node")), ["node"]
    )
    return on_path.join(into, F.col("node") == F.col("to_node")).select(
        F.col("hops").alias("step"), "edge_id", "from_node", "to_node", "cost"
    )


def landmark_bounds(edges: DataFrame, landmarks: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(origin, target, bound)``: the greatest difference of costs from landmarks is a lower bound of the cost between."""
    costs = settle(
        least_costs(edges, landmarks.select(F.col("node").alias("source"), "node")).select("source", "node", "cost"), "landmarks"
    )
    a = costs.select("source", F.col("node").alias("origin"), F.col("cost").alias("a"))
    b = costs.select("source", F.col("node").alias("target"), F.col("cost").alias("b"))
    return pairs.join(a, "origin").join(b, ["source", "target"]).groupBy("origin", "target").agg(
        F.max(F.abs(F.col("a") - F.col("b"))).alias("bound")
    )


def ring_redundancy(edges: DataFrame, hub, nodes: DataFrame) -> DataFrame:
    """``(node, redundant)``: nodes with two edges of their own and more that still reach the hub without one of them.

    A path leaves its node over one edge, so cutting another leaves it whole:
    being connected, and having a second edge, is all that has to be looked up.
    """
    two_way = both_ways(edges)
    start = edges.sparkSession.range(1).select(F.lit(hub).cast(edges.schema["from_node"].dataType).alias("node"))
    fed = reachable(two_way, start, open_devices=False).withColumn("fed", F.lit(True))
    degree = two_way.groupBy(F.col("from_node").alias("node")).agg(F.countDistinct(F.col("edge_id").cast("string")).alias("degree"))
    out = nodes.select("node").distinct().join(fed, "node", "left").join(degree, "node", "left")
    return out.select("node", (F.coalesce("fed", F.lit(False)) & (F.coalesce("degree", F.lit(0)) >= 2)).alias("redundant"))


def shared_fate(circuits: DataFrame) -> DataFrame:
    """``(edge_id, n_lost)`` of ``(circuit, edge_id)``: how many circuits use each edge and are lost with it."""
    return circuits.select("edge_id", "circuit").distinct().groupBy("edge_id").agg(F.count("*").alias("n_lost"))


def priority_order(projects: DataFrame, benefit: Column, cost: Column, name: str) -> DataFrame:
    """Projects by benefit over cost, ties by name: repairs by served demand an hour, or capital by avoided risk."""
    score = F.coalesce(benefit / F.nullif(cost, F.lit(0.0)), F.lit(0.0))
    return projects.withColumn("score", score).orderBy(F.desc("score"), name)


def fire_flow(edges: DataFrame, demands: DataFrame) -> DataFrame:
    """``(node, spare, enough)``: unused capacity of the edges at a node against its demand."""
    ends = edges.select(F.col("from_node").alias("node"), "capacity", "load").union(edges.select("to_node", "capacity", "load"))
    spare = ends.groupBy("node").agg(F.sum(F.greatest(F.lit(0.0), F.col("capacity") - F.col("load"))).alias("spare"))
    return demands.join(spare, "node", "left").select(
        "node", F.coalesce("spare", F.lit(0.0)).alias("spare"), (F.coalesce("spare", F.lit(0.0)) >= F.col("demand")).alias("enough")
    )


def flow_rounds(edges: DataFrame, demands: DataFrame, rounds: int = 3, penalty: float = 1.0) -> DataFrame:
    """Loads after rerouting with costs that grow with overflow, ``(edge_id, load, stress)``; stops when nothing overflows."""
    now, out = edges, None
    for _ in range(rounds):
        out = settle(edge_loads(now, demands), "loads")
        capacity = edges.select(F.col("edge_id").cast("string").alias("_id"), F.col("capacity").alias("_capacity")).distinct()
        over = out.join(capacity, F.col("edge_id") == F.col("_id")).where(F.col("load") > F.col("_capacity"))
        if over.isEmpty():
            break
        factor = over.select("_id", (1 + penalty * (F.col("load") / F.nullif(F.col("_capacity"), F.lit(0.0)) - 1)).alias("_factor"))
        raised = now.join(factor, F.col("edge_id").cast("string") == F.col("_id"), "left")
        now = settle(raised.withColumn("cost", F.col("cost") * F.coalesce("_factor", F.lit(1.0))).select(*edges.columns), "rerouted")
    return out
