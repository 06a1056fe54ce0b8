"""Screens of utility networks: failures, restorations, zones, dispatch and routing by risk.

Edge tables are those of ``network``; ``state`` may tell that an edge is an open
device. Every screen carries its cases as a column and searches all of them at
once, so the number of jobs depends on the blocks of the network and not on the
number of cases. A case is searched only where it can matter: an edge that lies
on no least path of a circuit can't part that circuit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from . import blocks, network
from .network import ring_redundancy  # noqa: F401

OPEN_STATES = ("open", "normally_open")


def _one_column(spark: SparkSession, values: list, name: str, kind) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(v).cast(kind) for v in values])).alias(name))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_node").alias("node")).union(edges.select("to_node")).distinct()


def live(edges: DataFrame) -> DataFrame:
    """The edges that are no open device."""
    if "state" not in edges.columns:
        return edges
    return edges.where(~F.lower(F.coalesce("state", F.lit(""))).isin(*OPEN_STATES))


def cases_reached(edges: DataFrame, starts: DataFrame, cut: Column) -> DataFrame:
    """``(case, node)`` reached from ``starts(case, node)``; ``cut`` tells which edges a case is without, from its ``case`` and an edge's ``edge_id``."""
    steps = edges.select(F.col("edge_id").cast("string").alias("edge_id"), "from_node", "to_node")
    return blocks.reach(steps, starts.select("case", "node"), lambda lanes: lanes.where(~cut))


def path_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(origin, destination, edge_id, node)``: the edges of one least path of each pair, and the node that each leads to.

    Paths are walked back together, a block of nodes a round.
    """
    steps, node_blocks = blocks.in_blocks(network.costed(edges))
    return _paths(steps, node_blocks, pairs).select("origin", "destination", "edge_id", "node")


def _paths(steps: DataFrame, node_blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    origins = pairs.select(F.col("origin").alias("source"), F.col("origin").alias("node"), F.lit(0.0).alias("cost")).distinct()
    tree = blocks.rooted(blocks.search(steps, node_blocks, origins), steps)
    at = pairs.select(
        F.col("origin").alias("source"), F.col("destination").alias("tag"), F.col("destination").alias("node"), F.lit(1.0).alias("amount")
    ).distinct()
    walked = blocks.walk_back(tree, at)
    return walked.select(F.col("source").alias("origin"), F.col("tag").alias("destination"), "edge_id", "node", F.col("hops").alias("place"))


def scenarios(edges: DataFrame, sources: DataFrame, failed: list[str], restored: list[str]) -> DataFrame:
    """``(scenario, node, energised)`` of the whole network: baseline, outage, and after restoration."""
    still = sorted(set(failed) - set(restored))
    spark, cases = edges.sparkSession, {"baseline": [], "outage": sorted(failed), "restoration": still}
    cut = F.lit(False)
    for name, lost in cases.items():
        cut = cut | ((F.col("case") == name) & F.col("edge_id").isin(lost or [""]))
    names = _one_column(spark, list(cases), "case", "string")
    fed = cases_reached(live(edges), names.join(F.broadcast(sources.select("node").distinct()), how="cross"), cut)  # three cases
    every = names.join(_nodes(edges), how="cross")
    return every.join(fed.withColumn("on", F.lit(True)), ["case", "node"], "left").select(
        F.col("case").alias("scenario"), "node", F.coalesce("on", F.lit(False)).alias("energised")
    )


def load_transfer(edges: DataFrame, source_a, source_b, capacity: float = float("inf"), load: float = 0.0) -> DataFrame:
    """One row: whether a tie between two feeders can take load, what is spare on it, and the cost of the path between them."""
    spare = float("inf") if capacity == float("inf") else max(0.0, capacity - load)
    kind = edges.schema["from_node"].dataType
    one = lambda v: _one_column(edges.sparkSession, [v], "node", kind)
    cost = network.od_costs(edges, one(source_a), one(source_b))
    return cost.select(
        ((F.col("cost") < float("inf")) & F.lit(spare > 0)).alias("feasible"), F.lit(spare).alias("available"),
        F.col("cost").alias("path_cost")
    )


def combination_screen(edges: DataFrame, sources: DataFrame, candidates: list[str], k: int) -> DataFrame:
    """``(edge_ids, lost_nodes)`` of every combination of k candidate edges failing together."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = edges.sparkSession
    one = _one_column(spark, sorted({str(c) for c in candidates}), "edge", "string")
    combos = one.select(F.array("edge").alias("edge_ids"))
    for _ in range(k - 1):  # a join of the short list of candidates with itself
        combos = combos.join(one, F.col("edge") > F.element_at("edge_ids", -1)).select(
            F.concat("edge_ids", F.array("edge")).alias("edge_ids")
        )
    combos = combos.withColumn("case", F.array_join("edge_ids", "\x1f"))
    cut = F.array_contains(F.split("case", "\x1f"), F.col("edge_id"))
    starts = combos.select("case").join(F.broadcast(sources.select("node").distinct()), how="cross")  # a few sources for each case
    kept = cases_reached(edges, starts, cut).groupBy("case").agg(F.count("*").alias("kept"))
    total = network.reachable(edges, sources, open_devices=False).agg(F.count("*").alias("total"))
    return combos.join(kept, "case").join(F.broadcast(total)).select("edge_ids", (F.col("total") - F.col("kept")).alias("lost_nodes"))


def coverage_audit(edges: DataFrame, customers: DataFrame, supplies: DataFrame) -> DataFrame:
    """``(node, edge_id)``: each edge whose failure alone cuts a customer ``node`` off from all supplies.

    Only edges of a customer's least path can do that. A customer that no supply
    reaches at all has one row with a null edge.
    """
    alive = live(edges)
    steps, node_blocks = blocks.in_blocks(network.costed(alive))
    roots = supplies.select("node").distinct()
    found = settle(blocks.search(steps, node_blocks, roots.select(F.lit(0).alias("source"), "node", F.lit(0.0).alias("cost"))), "costs")
    at = customers.select(F.lit(0).alias("source"), F.col("node").alias("tag"), "node", F.lit(1.0).alias("amount")).distinct()
    path = blocks.walk_back(blocks.rooted(found, steps), at).select(F.col("tag").alias("case"), F.col("hops").alias("place"), "node", "edge_id")
    path = settle(path, "paths")
    starts = path.select("case").distinct().join(F.broadcast(roots), how="cross")  # a few supplies for each customer
    single = blocks.parting(steps, node_blocks, path, starts)
    unserved = customers.select("node").distinct().join(found.select("node"), "node", "left_anti")
    return single.select(F.col("case").alias("node"), "edge_id").union(unserved.select("node", F.lit(None).cast("string")))


def circuit_cuts(edges: DataFrame, circuits: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(edge_id, circuits_impacted)``: circuits ``(origin, destination)`` whose ends a cut of each candidate edge parts."""
    wanted = candidates.select(F.col("edge_id").cast("string").alias("edge_id")).distinct()
    steps, node_blocks = blocks.in_blocks(network.costed(edges))
    path = _paths(steps, node_blocks, circuits).withColumn("case", F.struct("origin", "destination"))
    path = settle(path.select("case", "place", "node", "edge_id"), "paths")
    # A circuit without candidate edges on its path is not searched.
    asked_for = settle(path.join(wanted, "edge_id", "left_semi").select("case").distinct(), "cases")
    path = path.join(asked_for, "case", "left_semi")
    parted = blocks.parting(steps, node_blocks, path, asked_for.select("case", F.col("case.origin").alias("node")))
    lost = parted.join(wanted, "edge_id", "left_semi").select("edge_id", "case.*")
    counted = lost.join(
        circuits.groupBy("origin", "destination").agg(F.count("*").alias("n")), ["origin", "destination"]
    ).groupBy("edge_id").agg(F.sum("n").alias("n"))
    return wanted.join(counted, "edge_id", "left").select("edge_id", F.coalesce("n", F.lit(0)).cast("long").alias("circuits_impacted"))


def splice_trace(edges: DataFrame, splices: DataFrame, circuits: DataFrame) -> DataFrame:
    """``(node, circuits)``: how many circuits ``(origin, destination)`` run over each splice node on their least path."""
    over = path_edges(edges, circuits).select("origin", "destination", "node")
    ends = circuits.select("origin", "destination", F.explode(F.array("origin", "destination")).alias("node"))
    per = over.union(ends).distinct().groupBy("node").agg(F.count("*").alias("n"))
    return splices.select("node").distinct().join(per, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("circuits"))


def pressure_zones(edges: DataFrame, sources: DataFrame, max_headloss: float) -> DataFrame:
    """``(node, headloss, within)``: the least headloss from any source, and whether it is within the limit."""
    if max_headloss < 0:
        raise ValueError("the greatest headloss must not be negative")
    found = network.least_costs(edges, sources.select(F.lit(0).alias("source"), "node"))
    return found.select("node", F.col("cost").alias("headloss"), (F.col("cost") <= max_headloss).alias("within"))


def zone_reconfiguration(edges: DataFrame, sources: DataFrame, devices: DataFrame, max_headloss: float = 10.0) -> DataFrame:
    """``(edge_id, action, delta)``: how the nodes that are reached change against the pressure zone's when a device ``(edge_id, state)`` is turned.

    An open device is proposed to be closed, which leaves all edges; a closed one
    to be opened, which takes its edge away.
    """
    inside = pressure_zones(edges, sources, max_headloss).agg(F.count_if("within").alias("base"))
    turned = devices.select(
        F.col("edge_id").cast("string").alias("case"),
        F.lower(F.coalesce("state", F.lit("open"))).isin(*OPEN_STATES, "closed_for_maintenance").alias("open")
    ).distinct()
    starts = turned.select("case", "open").join(F.broadcast(sources.select("node").distinct()), how="cross")
    starts = starts.select(
        F.when(F.col("open"), F.concat(F.lit("+"), "case")).otherwise(F.concat(F.lit("-"), "case")).alias("case"), "node"
    )
    kept = cases_reached(edges, starts, F.col("case") == F.concat(F.lit("-"), "edge_id")).groupBy("case").agg(F.count("*").alias("n"))
    return kept.join(F.broadcast(inside)).select(
        F.expr("substring(case, 2)").alias("edge_id"), F.when(F.startswith("case", F.lit("+")), "close").otherwise("open").alias("action"),
        (F.col("n") - F.col("base")).alias("delta")
    )


def pump_cascade(dependencies: DataFrame, pumps: DataFrame, failed: DataFrame) -> DataFrame:
    """``(node)`` of all pumps that fail, over ``dependencies(node, depends_on)``; only pumps pass a failure on."""
    step = dependencies.join(pumps.select("node").distinct(), "node", "left_semi").select("node", "depends_on")
    walk = lambda df: df.withColumnRenamed("node", "at").join(step, F.col("at") == F.col("depends_on")).select("node")
    return network._closure(failed.select("node"), walk, ["node"])


def feeder_reconfiguration(edges: DataFrame, ties: list[str], sources: DataFrame, demands: DataFrame, max_actions: int = 1) -> DataFrame:
    """``(tie_id, restored_nodes, restored_demand)`` of the switches worth closing: those that leave most nodes fed, in order of the demand.

    All open devices but the tie stay open.
    """
    spark = edges.sparkSession
    cases = _one_column(spark, [str(t) for t in ties], "case", "string")
    shut = edges.where(
        F.lower(F.coalesce("state", F.lit(""))).isin(*OPEN_STATES)
    ).select(F.col("edge_id").cast("string").alias("edge_id")).withColumn("_open", F.lit(True))
    marked = edges.withColumn("edge_id", F.col("edge_id").cast("string")).join(shut, "edge_id", "left").select(
        "edge_id", "from_node", "to_node", F.coalesce("_open", F.lit(False)).alias("_open")
    )
    starts = cases.join(F.broadcast(sources.select("node").distinct()), how="cross")
    fed = blocks.reach(marked, starts, lambda lanes: lanes.where(~F.col("_open") | (F.col("case") == F.col("edge_id"))))
    per = fed.join(demands.groupBy("node").agg(F.sum("demand").alias("demand")), "node", "left").groupBy("case").agg(
        F.count("*").alias("restored_nodes"), F.coalesce(F.sum("demand"), F.lit(0.0)).alias("restored_demand")
    )
    best = per.orderBy(F.desc("restored_nodes"), "case").limit(max_actions)
    return best.orderBy(F.desc("restored_demand"), "case").withColumnRenamed("case", "tie_id")


def odorization_zones(edges: DataFrame, odorizers: DataFrame) -> DataFrame:
    """``(node, zone_nodes, overlap_nodes)``: what each odorizer reaches, and how much of it others reach too."""
    starts = odorizers.select(F.col("node").cast("string").alias("case"), "node").distinct()
    zone = settle(cases_reached(edges, starts, F.lit(False)), "zones")
    shared = zone.groupBy("node").agg(F.count("*").alias("n"))
    per = zone.join(shared, "node").groupBy("case").agg(F.count("*").alias("zone_nodes"), F.count_if(F.col("n") > 1).alias("overlap_nodes"))
    return starts.select("node", "case").join(per, "case").select("node", "zone_nodes", "overlap_nodes")


def regulator_isolation(edges: DataFrame, regulator) -> DataFrame:
    """One row ``(neighbours, alternate_path)``: whether two neighbours of a node are still joined without it."""
    kind = edges.schema["from_node"].dataType
    node = F.lit(regulator).cast(kind)
    two_way = network.both_ways(edges)
    near = two_way.where((F.col("from_node") == node) & (F.col("to_node") != node)).select(F.col("to_node").alias("node")).distinct()
    rest = two_way.where((F.col("from_node") != node) & (F.col("to_node") != node))
    comps = network.components(rest)
    per = near.join(comps, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    ).groupBy("component").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("neighbours"), F.coalesce(F.max("n") > 1, F.lit(False)).alias("alternate_path"))


def crew_dispatch(
    edges: DataFrame, sources: DataFrame, failed: list[str], demands: DataFrame, repair_hours: dict[str, float] | None = None,
    critical: list | None = None
) -> DataFrame:
    """``(step, edge_id, score)``: repairs in the order of what each leaves served, an hour of repair; recomputed after every repair.

    A critical node counts as a demand of 1000. One search for all that is still
    broken is made for each repair.
    """
    spark, hours = edges.sparkSession, repair_hours or {}
    weight = demands.groupBy("node").agg(F.sum("demand").alias("demand"))
    if critical:
        weight = weight.union(
            _one_column(spark, critical, "node", edges.schema["from_node"].dataType).select("node", F.lit(1000.0))
        ).groupBy("node").agg(F.sum("demand").alias("demand"))
    alive, todo, plan = live(edges), sorted({str(f) for f in failed}), []
    while todo:
        cases = _one_column(spark, todo, "case", "string")
        cut = F.col("edge_id").isin(todo) & (F.col("edge_id") != F.col("case"))
        fed = cases_reached(alive, cases.join(F.broadcast(sources.select("node").distinct()), how="cross"), cut)
        served = dict(fed.join(weight, "node").groupBy("case").agg(F.sum("demand")).collect())  # a number for each broken edge
        score = {e: (served.get(e) or 0.0) / max(0.1, float(hours.get(e, 1.0))) for e in todo}
        best = min(todo, key=lambda e: (-score[e], e))
        plan.append((len(plan) + 1, best, float(score[best])))
        todo.remove(best)
    return spark.createDataFrame(plan, "step long, edge_id string, score double")


def capital_priorities(edges: DataFrame, sources: DataFrame, demands: DataFrame, projects: DataFrame) -> DataFrame:
    """``(project_id, cost, risk_avoided, ratio)`` of projects ``(project_id, cost, edge_id, from_node, to_node)`` that add edges.

    The risk is the demand lost over the single failures of all edges. Only edges of a
    tree of least paths can lose any, and each of them loses what lies behind it,
    if no other edge leads out from there. To tell, every other edge has a random number,
    added at one end and subtracted at the other: sums over what lies behind are
    zero where none leads out, and otherwise by a chance of about 2^-80. Ids of edges are unique.
    """
    base = edges.select(F.col("edge_id").cast("string").alias("edge_id"), "from_node", "to_node")
    added = projects.select(
        F.col("project_id").cast("string").alias("project"), F.col("edge_id").cast("string").alias("edge_id"), "from_node", "to_node"
    ).where("edge_id is not null")
    names = projects.select(F.col("project_id").cast("string").alias("project")).distinct().union(
        edges.sparkSession.range(1).select(F.lit("").alias("project"))
    )
    every = base.select(F.lit(None).cast("string").alias("project"), "*").union(added).distinct()
    steps, node_blocks = blocks.in_blocks(network.both_ways(every).select(
        "project", "from_node", "to_node", F.lit(1.0).alias("step"), F.lit(1).cast("long").alias("hop"), F.col("edge_id").alias("by")
    ))
    roots = sources.select("node").distinct()
    starts = names.select(F.col("project").alias("source")).join(F.broadcast(roots), how="cross")  # a few sources for each project
    own = lambda lanes: lanes.where(F.col("project").isNull() | (F.col("project") == F.col("source")))
    found = settle(blocks.search(steps, node_blocks, starts.withColumn("cost", F.lit(0.0)), cut=own), "projects")
    tree = blocks.rooted(found, steps)
    demand = demands.groupBy("node").agg(F.sum("demand").cast("double").alias("demand"))
    # The edges between reached nodes that are in no tree, from one end each; a step in the other direction is the same edge.
    at = found.select("source", "node")
    others = names.select(F.col("project").alias("source")).join(
        every, F.col("project").isNull() | (F.col("project") == F.col("source"))
    ).select("source", F.col("edge_id").alias("by"), "from_node", "to_node")
    others = others.join(tree.select("source", F.col("edge_id").alias("by")), ["source", "by"], "left_anti")
    parts = range(2)  # two numbers of 40 bits, whose sums doubles hold exactly
    rolled = [F.shiftrightunsigned(F.xxhash64("by", F.lit(k)), 24).cast("double") for k in parts]
    marks = others.select("source", F.col("from_node").alias("node"), *[r.alias(f"m{k}") for k, r in enumerate(rolled)]).union(
        others.select("source", "to_node", *[-r for r in rolled])
    ).groupBy("source", "node").agg(*[F.sum(f"m{k}").alias(f"m{k}") for k in parts])
    held = settle(at.join(demand, "node", "left").join(marks, ["source", "node"], "left"), "held")
    tags = held.select("source", "node", F.posexplode(F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("demand", "m0", "m1")])).alias("tag", "amount"))
    behind = blocks.walk_back(tree, tags).groupBy("source", "edge_id").agg(
        F.sum(F.when(F.col("tag") == 0, F.col("amount"))).alias("lost"),
        *[F.sum(F.when(F.col("tag") == k + 1, F.col("amount"))).alias(f"m{k}") for k in parts]
    )
    lost = behind.where("m0 = 0 and m1 = 0").groupBy(F.col("source").alias("project")).agg(F.sum("lost").alias("lost"))
    fed = held.groupBy(F.col("source").alias("project")).agg(F.sum("demand").alias("fed"))
    failures = names.join(base.select("edge_id").distinct(), how="cross").union(added.select("project", "edge_id").distinct()).distinct()
    total = network.reachable(network.both_ways(base), sources, open_devices=False).join(demands, "node").agg(F.sum("demand").alias("total"))
    n = failures.groupBy("project").agg(F.count("*").alias("n"))
    zero = F.lit(0.0)
    risk = n.join(fed, "project", "left").join(lost, "project", "left").join(F.broadcast(total)).select(
        "project", (F.col("n") * (F.coalesce("total", zero) - F.coalesce("fed", zero)) + F.coalesce("lost", zero)).alias("risk")
    )
    before = risk.where("project = ''").select(F.col("risk").alias("before"))
    costs = projects.groupBy(F.col("project_id").cast("string").alias("project")).agg(
        F.greatest(F.lit(1.0), F.max("cost").cast("double")).alias("cost")
    )
    out = costs.join(risk, "project").join(F.broadcast(before))
    avoided = F.greatest(F.lit(0.0), F.col("before") - F.col("risk"))
    return out.select(F.col("project").alias("project_id"), "cost", avoided.alias("risk_avoided"), (avoided / F.col("cost")).alias("ratio"))


def age_risk_routes(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(origin, destination, risk_cost, premium)``: least costs where old edges cost up to 2.5 times as much, and what that adds.

    ``edges`` also has ``age`` and ``design_life`` in years.
    """
    ratio = F.least(F.lit(3.0), F.coalesce("age", F.lit(0.0)) / F.greatest(F.lit(1.0), F.coalesce("design_life", F.lit(50.0))))
    risky = edges.withColumn("cost", F.col("cost") * (1 + 0.5 * ratio))
    start = pairs.select(F.col("origin").alias("source"), F.col("origin").alias("node")).distinct()
    found = lambda e, name: network.least_costs(e, start).select(F.col("source").alias("origin"), F.col("node").alias("destination"), F.col("cost").alias(name))
    out = pairs.select("origin", "destination").distinct().join(
        found(risky, "risk"), ["origin", "destination"], "left"
    ).join(found(edges, "base"), ["origin", "destination"], "left")
    inf = F.lit(float("inf"))
    return out.select(
        "origin", "destination", F.coalesce("risk", inf).alias("risk_cost"),
        F.when(F.col("risk").isNull(), inf).otherwise(
            F.greatest(F.lit(0.0), F.col("risk") - F.coalesce("base", F.lit(0.0)))
        ).alias("premium")
    )


def basin_overflow(basins: DataFrame, capacity: str = "capacity", inflow: str = "inflow") -> DataFrame:
    """The basins with ``overflow``, what flows in beyond the capacity."""
    return basins.withColumn("overflow", F.greatest(F.lit(0.0), F.col(inflow) - F.col(capacity)))


def infiltration_scan(
    edges: DataFrame, observed: str = "observed_flow", dry: str = "dry_weather_flow", threshold: float = 1.25
) -> DataFrame:
    """``(edge_id, ratio, flagged)``: observed over dry-weather flow; without the latter an edge is its own measure."""
    seen = F.coalesce(F.col(observed).cast("double"), F.lit(0.0))
    base = F.greatest(F.lit(1e-9), F.coalesce(F.col(dry).cast("double"), F.when(seen > 0, seen).otherwise(F.lit(1.0))))
    return edges.select("edge_id", (seen / base).alias("ratio"), (seen / base >= threshold).alias("flagged"))


def constrained_flow(
    edges: DataFrame, demands: DataFrame, max_iterations: int = 8, penalty: float = 3.0, tolerance: float = 1e-6
) -> DataFrame:
    """``(edge_id, load, stress, cost, iteration)``: demands on least paths, with costs that grow with overflow until nothing overflows.

    Costs are the own ones times one plus the penalised overflow of the last
    assignment.
    """
    if max_iterations < 1 or penalty < 0:
        raise ValueError("at least one iteration and no negative penalty")
    own = edges.select(
        F.col("edge_id").cast("string").alias("edge_id"), F.col("cost").alias("base"), "capacity"
    ).groupBy("edge_id").agg(F.min("base").alias("base"), F.max("capacity").alias("capacity"))
    now, out = edges, None
    for k in range(1, max_iterations + 1):
        loads = network.edge_loads(now, demands).select("edge_id", "load")
        ratio = F.when(
            F.col("capacity").isNull() | (F.col("capacity") <= 0) | (F.col("capacity") == float("inf")), F.lit(0.0)
        ).otherwise(F.col("load") / F.nullif(F.col("capacity"), F.lit(0.0)))
        over = F.greatest(F.lit(0.0), ratio - 1)
        out = settle(
            own.join(loads, "edge_id").select(
                "edge_id", "load", ratio.alias("stress"), (F.col("base") * (1 + penalty * over)).alias("cost"),
                F.lit(k).cast("long").alias("iteration")
            ),
            "assigned"
        )
        if out.where(F.col("stress") - 1 > tolerance).isEmpty():
            break
        raised = out.select(F.col("edge_id").alias("_id"), F.col("cost").alias("_cost"))
        now = settle(
            edges.join(raised, F.col("edge_id").cast("string") == F.col("_id")).withColumn("cost", F.col("_cost")).select(*edges.columns),
            "costs"
        )
    return out
