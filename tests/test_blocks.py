"""Searches in blocks: rounds don't grow with the edges of a path, and blocks of any size give the plain results."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from ravelin.operators import blocks, network, utility


def jobs(spark, name, run):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    out = run()
    n = len(sc.statusTracker().getJobIdsForGroup(name))
    sc.setJobGroup("tests", "tests")
    return out, n


def chain(spark, n):
    return network.both_ways(
        spark.range(n).select(F.col("id").alias("edge_id"), F.col("id").alias("from_node"), (F.col("id") + 1).alias("to_node"), F.lit(1.0).alias("cost"))
    )


def test_few_jobs_for_a_long_path(spark):
    edges = chain(spark, 300)
    found, n = jobs(spark, "chain", lambda: network.service_area(edges, 0, 1e9).collect())
    assert sorted(tuple(r) for r in found) == [(k, float(k)) for k in range(301)] and n < 40
    one = spark.createDataFrame([(0, 300)], "origin long, destination long")
    cuts, n = jobs(spark, "cuts", lambda: utility.circuit_cuts(edges, one, edges.select("edge_id")).collect())
    assert len(cuts) == 300 and all(r["circuits_impacted"] == 1 for r in cuts) and n < 120


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(13)] + [(rng.randrange(14), rng.randrange(14)) for _ in range(4)] + [(30, 31)]
    edges = [(f"e{k}", a, b, round(rng.uniform(1, 9), 3)) for k, (a, b) in enumerate(pairs)]
    return edges, spark.createDataFrame(edges, "edge_id string, from_node int, to_node int, cost double")


def plain_costs(edges, start):
    best, todo = {}, [(0.0, start)]
    while todo:
        cost, at = heapq.heappop(todo)
        if at not in best:
            best[at] = cost
            todo += [(cost + c, y) for _, a, b, c in edges for x, y in ((a, b), (b, a)) if x == at]
            heapq.heapify(todo)
    return best


def test_small_blocks(net, spark, monkeypatch):
    edges, df = net
    monkeypatch.setattr(blocks, "BLOCK_NODES", 4)
    two_way = network.both_ways(df)
    got = {r["node"]: r["cost"] for r in network.service_area(two_way, 0, 1e9).collect()}
    want = plain_costs(edges, 0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    customers = spark.createDataFrame([(k,) for k in range(14)], "node int")
    got = {(r["node"], r["edge_id"]) for r in utility.coverage_audit(two_way, customers, customers.where("node in (0, 5)")).collect()}
    reach = lambda cut, roots=(0, 5): set().union(*(plain_costs([e for e in edges if e[0] != cut], r) for r in roots))
    assert got == {(k, e[0]) for e in edges for k in range(14) if k not in reach(e[0])}


def test_capital_priorities_in_small_blocks(net, spark, monkeypatch):
    edges, df = net
    monkeypatch.setattr(blocks, "BLOCK_NODES", 4)
    demands = spark.createDataFrame([(k, float(k % 3 + 1)) for k in range(32)], "node int, demand double")
    plans = {"a": ("p1", 0, 13), "b": ("p2", 4, 31), "c": ("p3", 2, 2)}
    projects = spark.createDataFrame([(p, 10.0, *x) for p, x in plans.items()], "project_id string, cost double, edge_id string, from_node int, to_node int")
    nodes = spark.createDataFrame([(0,)], "node int")
    got = {r["project_id"]: r["risk_avoided"] for r in utility.capital_priorities(df, nodes, demands, projects).collect()}
    total = sum(k % 3 + 1 for k in plain_costs(edges, 0))
    risk = lambda es: sum(total - sum(k % 3 + 1 for k in plain_costs([e for e in es if e[0] != cut[0]], 0)) for cut in es)
    assert got == {p: max(0.0, float(risk(edges) - risk([*edges, (*x, 1.0)]))) for p, x in plans.items()}


def test_walks_share_the_rest_of_their_way(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_NODES", 3)
    edges = chain(spark, 8).withColumn("capacity", F.lit(10.0))
    demands = spark.createDataFrame([(0, 8, 2.0), (0, 5, 1.0), (8, 6, 4.0)], "origin long, destination long, demand double")
    got = {int(r["edge_id"]): r["load"] for r in network.edge_loads(edges, demands).collect()}
    assert got == {**{k: 3.0 for k in range(5)}, 5: 2.0, 6: 6.0, 7: 6.0}
