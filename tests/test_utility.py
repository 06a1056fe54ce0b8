"""Screens of a random network with open devices, islands and double edges against plain searches."""

import itertools
import random
from collections import Counter

import pytest

from ravelin.operators import network, utility


def reach(edges, starts, without=()):
    seen, todo = set(starts), list(starts)
    while todo:
        at = todo.pop()
        for e, a, b, *_ in edges:
            if e not in without:
                for x, y in ((a, b), (b, a)):
                    if x == at and y not in seen:
                        seen.add(y)
                        todo.append(y)
    return seen


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(8)
    edges = [
        (f"e{k}", a, b, round(rng.uniform(1, 9), 4), "open" if k % 9 == 4 else None) for k,
        (a, b) in enumerate([*[(i, i + 1) for i in range(9)], (2, 6), (7, 7), (3, 5), (3, 5), (20, 21), (8, 12), (12, 13)])
    ]
    df = spark.createDataFrame(edges, "edge_id string, from_node int, to_node int, cost double, state string")
    return edges, network.both_ways(df), lambda *n: spark.createDataFrame([(x,) for x in n], "node int")


def test_coverage(net):
    edges, two_way, nodes = net
    alive = [e for e in edges if e[4] != "open"]
    want = set()
    for c in (9, 13, 21, 4):
        if c not in reach(alive, [0]):
            want.add((c, None))
        else:
            want |= {(c, e[0]) for e in alive if c not in reach(alive, [0], {e[0]})}
    assert {(r["node"], r["edge_id"]) for r in utility.coverage_audit(two_way, nodes(9, 13, 21, 4), nodes(0)).collect()} == want


def test_combinations_and_cuts(net, spark):
    edges, two_way, nodes = net
    chosen = ["e1", "e9", "e3", "e11"]
    got = {tuple(r["edge_ids"]): r["lost_nodes"] for r in utility.combination_screen(two_way, nodes(0), chosen, 2).collect()}
    base = len(reach(edges, [0]))
    assert got == {c: base - len(reach(edges, [0], set(c))) for c in itertools.combinations(sorted(chosen), 2)}
    circuits = [(0, 9), (4, 13), (0, 21), (5, 3)]
    got = {
        r["edge_id"]: r["circuits_impacted"]
        for r in utility.circuit_cuts(
            two_way, spark.createDataFrame(circuits, "origin int, destination int"), two_way.select("edge_id")
        ).collect()
    }
    assert got == {e[0]: sum(b in reach(edges, [a]) and b not in reach(edges, [a], {e[0]}) for a, b in circuits) for e in edges}


def test_rings_and_regulators(net):
    edges, two_way, nodes = net
    own = Counter(x for e in edges for x in {e[1], e[2]})
    got = {r["node"]: r["redundant"] for r in utility.ring_redundancy(two_way, 0, nodes(*range(14), 20, 99)).collect()}
    assert got == {n: n in reach(edges, [0]) and own[n] >= 2 for n in [*range(14), 20, 99]}
    for node, want in ((3, True), (8, False), (21, False)):
        assert utility.regulator_isolation(two_way, node).first()["alternate_path"] == want


def test_crews_repair_what_serves_most_first(net, spark):
    edges, two_way, nodes = net
    demands = spark.createDataFrame([(n, float(n)) for n in range(14)], "node int, demand double")
    alive, broken, want = [e for e in edges if e[4] != "open"], {"e0", "e2", "e14"}, []
    while broken:
        best = max(sorted(broken), key=lambda e: sum(n for n in reach(alive, [0], broken - {e}) if n < 14))
        want.append(best)
        broken -= {best}
    assert [r["edge_id"] for r in utility.crew_dispatch(two_way, nodes(0), ["e0", "e2", "e14"], demands).orderBy("step").collect()] == want
