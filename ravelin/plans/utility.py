"""Screens of a utility network over a lattice that grows with ``supplier``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import network, utility
from ..session import table


def _side(spark: SparkSession, d: str) -> DataFrame:
    """One row: the lattice has m by m nodes, as many as the suppliers fill."""
    return table(spark, d, "supplier").agg(F.floor(F.sqrt(F.count("*"))).alias("m"))


def lattice_nodes(spark: SparkSession, d: str) -> DataFrame:
    m = _side(spark, d)
    return m.select(
        "m", F.explode(F.sequence(F.lit(0), F.col("m") * F.col("m") - 1)).alias("k")
    ).select("m", F.col("k").cast("long").alias("k"))


def lattice(spark: SparkSession, d: str) -> DataFrame:
    """Edges to the right (even ids) and upwards (odd ids), with costs, capacities, states and ages from their ids."""
    n = lattice_nodes(spark, d)
    right = n.where("k % m < m - 1").select(
        (F.col("k") * 2).alias("edge_id"), F.col("k").alias("from_node"), (F.col("k") + 1).alias("to_node")
    )
    up = n.where("k < m * (m - 1)").select(
        (F.col("k") * 2 + 1).alias("edge_id"), F.col("k").alias("from_node"), (F.col("k") + F.col("m")).alias("to_node")
    )
    e = F.col("edge_id")
    return right.union(up).select(
        e, "from_node", "to_node", (
            e * 7 % 11 + 1 + e / 1000 + e * e % 97 / 9700
        ).alias("cost"), (e * 5 % 13 + 4).cast("double").alias("capacity"),
        F.when(e % 7 == 3, "open").otherwise("closed").alias("state"), (e * 3 % 80).cast("double").alias("age"), F.when(
            e % 5 > 0, (e % 4 * 10 + 20).cast("double")
        ).alias("design_life"),
        (e % 9).cast("double").alias("observed_flow"), F.when(e % 4 > 0, (e % 6).cast("double")).alias("dry_weather_flow"),
    )


def _two_way(spark: SparkSession, d: str) -> DataFrame:
    return network.both_ways(lattice(spark, d))


def _corners(spark: SparkSession, d: str, *which: str) -> DataFrame:
    """Nodes by an expression of m, such as ``0`` or ``m * m - 1``."""
    return _side(spark, d).select(F.explode(F.array(*[F.expr(x).cast("long") for x in which])).alias("node"))


def _demands(spark: SparkSession, d: str) -> DataFrame:
    return lattice_nodes(spark, d).select(F.col("k").alias("node"), (F.col("k") % 4 + 1).cast("double").alias("demand"))


def _circuits(spark: SparkSession, d: str) -> DataFrame:
    """From the first node to the end of every third row, and from the last row's start."""
    n = lattice_nodes(spark, d)
    a = n.where("k % m = m - 1 and floor(k / m) % 3 = 0").select(F.lit(0).cast("long").alias("origin"), F.col("k").alias("destination"))
    return a.union(n.where("k = m * (m - 1)").select(F.col("k").alias("origin"), (F.col("m") - 1).cast("long").alias("destination")))


def lattice_costs(spark: SparkSession, d: str) -> DataFrame:
    return network.service_area(_two_way(spark, d), 0, float("inf")).select("node", F.round("cost", 6).alias("cost"))


def lattice_od_matrix(spark: SparkSession, d: str) -> DataFrame:
    out = network.od_costs(_two_way(spark, d), _corners(spark, d, "0", "m - 1"), _corners(spark, d, "m * m - 1", "m * (m - 1)", "m + 1"))
    return out.select("origin", "destination", F.round("cost", 6).alias("cost"))


def lattice_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return utility.scenarios(_two_way(spark, d), _corners(spark, d, "0"), ["0", "1", "4"], ["0"])


def lattice_combinations(spark: SparkSession, d: str) -> DataFrame:
    out = utility.combination_screen(_two_way(spark, d), _corners(spark, d, "0"), ["0", "1", "2", "5"], 2)
    return out.select(F.array_join("edge_ids", "+").alias("edges"), "lost_nodes")


def lattice_coverage(spark: SparkSession, d: str) -> DataFrame:
    return utility.coverage_audit(_two_way(spark, d), _corners(spark, d, "m - 1", "m * m - 1", "m * (m - 1)"), _corners(spark, d, "0"))


def lattice_circuit_cuts(spark: SparkSession, d: str) -> DataFrame:
    """On a lattice without the edges upwards of all but its first column, where every edge matters."""
    comb = lattice(spark, d).where("edge_id % 2 = 0").unionByName(_first_column(spark, d))
    return utility.circuit_cuts(network.both_ways(comb), _circuits(spark, d), comb.where("edge_id % 3 = 0"))


def _first_column(spark: SparkSession, d: str) -> DataFrame:
    starts = lattice_nodes(spark, d).where("k % m = 0").select(F.col("k").alias("from_node"))
    return lattice(spark, d).where("edge_id % 2 = 1").join(starts, "from_node").select(*lattice(spark, d).columns)


def lattice_splices(spark: SparkSession, d: str) -> DataFrame:
    return utility.splice_trace(_two_way(spark, d), lattice_nodes(spark, d).select(F.col("k").alias("node")), _circuits(spark, d))


def lattice_rings(spark: SparkSession, d: str) -> DataFrame:
    open_too = utility.live(lattice(spark, d))
    return utility.ring_redundancy(open_too, 0, lattice_nodes(spark, d).select(F.col("k").alias("node")))


def lattice_pressure(spark: SparkSession, d: str) -> DataFrame:
    out = utility.pressure_zones(_two_way(spark, d), _corners(spark, d, "0", "m * m - 1"), 15.0)
    return out.select("node", F.round("headloss", 6).alias("headloss"), "within")


def lattice_reconfiguration(spark: SparkSession, d: str) -> DataFrame:
    edges = lattice(spark, d)
    return utility.zone_reconfiguration(network.both_ways(edges), _corners(spark, d, "0"), edges.where("edge_id in (0, 1, 3)"), 15.0)


def part_pumps(spark: SparkSession, d: str) -> DataFrame:
    """Parts that depend on the part of half their key; only those of odd size pass a failure on."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 2).alias("depends_on"), "p_size")
    return utility.pump_cascade(parts, parts.where("p_size % 3 > 0"), parts.where("node in (2, 3, 5)"))


def lattice_ties(spark: SparkSession, d: str) -> DataFrame:
    return utility.feeder_reconfiguration(_two_way(spark, d), ["3", "17"], _corners(spark, d, "0"), _demands(spark, d), 2)


def lattice_zones(spark: SparkSession, d: str) -> DataFrame:
    """Zones of the one-way lattice, so that they differ."""
    return utility.odorization_zones(utility.live(lattice(spark, d)), _corners(spark, d, "0", "m + 1", "m * (m - 1)"))


def lattice_regulator(spark: SparkSession, d: str) -> DataFrame:
    return utility.regulator_isolation(utility.live(lattice(spark, d)), 1)


def lattice_crews(spark: SparkSession, d: str) -> DataFrame:
    return utility.crew_dispatch(
        _two_way(spark, d), _corners(spark, d, "0"), ["0", "1", "2"], _demands(spark, d), {"0": 4.0, "1": 2.0}, [1]
    )


def lattice_capital(spark: SparkSession, d: str) -> DataFrame:
    """Shortcuts from the first node into a one-way lattice, where they avoid losses."""
    far = _side(spark, d).select(
        F.lit("far").alias("project_id"), F.lit(900.0).alias("cost"), F.lit("p0").alias("edge_id"),
        F.lit(0).cast("long").alias("from_node"), (F.col("m") - 1).cast("long").alias("to_node")
    )
    near = far.select(
        F.lit("near").alias("project_id"), F.lit(50.0).alias("cost"), F.lit("p1").alias("edge_id"), "from_node",
        F.lit(1).cast("long").alias("to_node")
    )
    out = utility.capital_priorities(
        lattice(spark, d).where("edge_id % 2 = 0 or from_node = 0"), _corners(spark, d, "0"), _demands(spark, d), far.union(near)
    )
    return out.select("project_id", "cost", "risk_avoided", F.round("ratio", 6).alias("ratio"))


def lattice_age_risk(spark: SparkSession, d: str) -> DataFrame:
    out = utility.age_risk_routes(_two_way(spark, d), _circuits(spark, d))
    return out.select("origin", "destination", F.round("risk_cost", 5).alias("risk_cost"), F.round("premium", 5).alias("premium"))


def lattice_infiltration(spark: SparkSession, d: str) -> DataFrame:
    return utility.infiltration_scan(lattice(spark, d)).select("edge_id", F.round("ratio", 6).alias("ratio"), "flagged")


def order_basins(spark: SparkSession, d: str) -> DataFrame:
    """Orders as inflow, with a capacity by their priority."""
    o = table(spark, d, "orders").select(
        "o_orderkey", F.round("o_totalprice").cast("long").alias("inflow"),
        (F.length("o_orderpriority") * 15000).cast("long").alias("capacity")
    )
    return utility.basin_overflow(o).select("o_orderkey", F.col("overflow").cast("double").alias("overflow"))


def lattice_flows(spark: SparkSession, d: str) -> DataFrame:
    demands = _circuits(spark, d).withColumn("demand", F.lit(5.0))
    out = utility.constrained_flow(_two_way(spark, d), demands, 3)
    return out.select(
        "edge_id", F.round("load", 6).alias("load"), F.round("stress", 6).alias("stress"), F.round("cost", 6).alias("cost"), "iteration"
    )


_L = """s AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS m FROM supplier), n AS (SELECT m, unnest(range(m * m)) AS k FROM s),
e AS (SELECT k * 2 AS id, k AS f, k + 1 AS t FROM n WHERE k % m < m - 1 UNION ALL SELECT k * 2 + 1, k, k + m FROM n WHERE k < m * (m - 1)),
g AS (SELECT id, f, t, id * 7 % 11 + 1 + id / 1000 + id * id % 97 / 9700 AS cost, id % 7 = 3 AS open, CAST(id * 3 % 80 AS DOUBLE) AS age, CASE WHEN id % 5 > 0 THEN id % 4 * 10 + 20 ELSE 50 END AS life FROM e),
b AS (SELECT * FROM g UNION ALL SELECT id, t, f, cost, open, age, life FROM g)"""
#: Every node as a source; a path has fewer edges than there are nodes, and here fewer than six times the side.
_COSTS = """r AS (SELECT o, o AS node, 0.0::DOUBLE AS cost, 0 AS i FROM ({start}) UNION ALL SELECT o, node, min(cost), i + 1 FROM (SELECT r.o, b.t AS node, r.cost + {step} AS cost, r.i FROM r JOIN b ON b.f = r.node UNION ALL SELECT o, node, cost, i FROM r) WHERE i < (SELECT 6 * m FROM s) GROUP BY o, node, i),
c AS (SELECT o, node, min(cost) AS cost FROM r GROUP BY o, node)"""
_START = _COSTS.format(start="SELECT 0::BIGINT AS o", step="b.cost")
_PAIRS = "q AS (SELECT 0::BIGINT AS o, k AS d FROM n WHERE k % m = m - 1 AND k // m % 3 = 0 UNION ALL SELECT k, m - 1 FROM n WHERE k = m * (m - 1))"
_EVERY = _COSTS.format(start="SELECT k AS o FROM n", step="b.cost")
_RISK = "b.cost * (1 + 0.5 * least(3.0, age / greatest(1.0, life)))"

QUERIES = {
    f.__name__: f
    for f in (
        lattice_costs, lattice_od_matrix, lattice_scenarios, lattice_combinations, lattice_coverage, lattice_circuit_cuts, lattice_splices, lattice_rings, lattice_pressure, lattice_reconfiguration,
        part_pumps, lattice_ties, lattice_zones, lattice_regulator, lattice_crews, lattice_capital, lattice_age_risk, lattice_infiltration, order_basins, lattice_flows,
    )
}

SQL = {
    "lattice_costs": f"WITH RECURSIVE {_L}, {_START} SELECT node, round(cost, 6) AS cost FROM c",
    "lattice_od_matrix": f"WITH RECURSIVE {_L}, {_COSTS.format(start='SELECT unnest([0, m - 1]) AS o FROM s', step='b.cost')} SELECT o AS origin, node AS destination, round(cost, 6) AS cost FROM c, s WHERE node IN (m * m - 1, m * (m - 1), m + 1)",
    "lattice_scenarios": f"""
WITH RECURSIVE {_L}, x AS (SELECT unnest(['baseline', 'outage', 'restoration']) AS c), w AS (SELECT 'outage' AS c, unnest([0, 1, 4]) AS id UNION ALL SELECT 'restoration', unnest([1, 4])),
r AS (SELECT c, 0::BIGINT AS node FROM x UNION SELECT r.c, b.t FROM r JOIN b ON b.f = r.node AND NOT b.open AND NOT EXISTS (SELECT 1 FROM w WHERE w.c = r.c AND w.id = b.id))
SELECT c AS scenario, k AS node, (c, k) IN (SELECT (c, node) FROM r) AS energised FROM x, n""",
    "lattice_combinations": f"""
WITH RECURSIVE {_L}, x AS (SELECT unnest([0, 0, 0, 1, 1, 2]) AS p, unnest([1, 2, 5, 2, 5, 5]) AS q), r AS (SELECT p, q, 0::BIGINT AS node FROM x UNION SELECT p, q, b.t FROM r JOIN b ON b.f = r.node AND b.id <> p AND b.id <> q)
SELECT p || '+' || q AS edges, (SELECT count(*) FROM n) - count(*) AS lost_nodes FROM r GROUP BY p, q""",
    "lattice_coverage": f"""
WITH RECURSIVE {_L}, x AS (SELECT unnest([m - 1, m * m - 1, m * (m - 1)]) AS node FROM s), r AS (SELECT id AS c, 0::BIGINT AS node FROM g UNION ALL SELECT -1, 0),
z AS (SELECT c, node FROM r UNION SELECT z.c, b.t FROM z JOIN b ON b.f = z.node AND NOT b.open AND b.id <> z.c)
SELECT DISTINCT node, CASE WHEN c >= 0 THEN CAST(c AS VARCHAR) END AS edge_id FROM x, (SELECT DISTINCT c FROM r)
WHERE (c, node) NOT IN (SELECT (c, node) FROM z) AND ((c = -1) = (node NOT IN (SELECT node FROM z WHERE c = -1)))""",
    "lattice_circuit_cuts": f"""
WITH RECURSIVE {_L}, {_PAIRS}, y AS (SELECT b.* FROM b, s WHERE id % 2 = 0 OR least(f, t) % m = 0), k3 AS (SELECT DISTINCT id FROM y WHERE id % 3 = 0),
r AS (SELECT DISTINCT k3.id AS c, o, o AS node FROM k3, q UNION SELECT r.c, r.o, y.t FROM r JOIN y ON y.f = r.node AND y.id <> r.c)
SELECT CAST(k3.id AS VARCHAR) AS edge_id, count(*) FILTER ((k3.id, o, d) NOT IN (SELECT (c, o, node) FROM r)) AS circuits_impacted FROM k3, q GROUP BY k3.id""",
    "lattice_splices": f"""
WITH RECURSIVE {_L}, {_EVERY}, {_PAIRS}
SELECT k AS node, count(q.o) AS circuits FROM n LEFT JOIN (SELECT q.o, q.d, a.node FROM q JOIN c a ON a.o = q.o JOIN c z ON z.o = q.d AND z.node = a.node JOIN c w ON w.o = q.o AND w.node = q.d WHERE abs(a.cost + z.cost - w.cost) < 1e-7) q ON q.node = k GROUP BY k""",
    "lattice_rings": f"""
WITH RECURSIVE {_L}, r AS (SELECT 0::BIGINT AS node UNION SELECT b.t FROM r JOIN b ON b.f = r.node AND NOT b.open)
SELECT k AS node, k IN (SELECT node FROM r) AND (SELECT count(*) FROM b WHERE NOT open AND f = k) >= 2 AS redundant FROM n""",
    "lattice_pressure": f"WITH RECURSIVE {_L}, {_COSTS.format(start='SELECT unnest([0, m * m - 1]) AS o FROM s', step='b.cost')}, p AS (SELECT node, min(cost) AS h FROM c GROUP BY node) SELECT node, round(h, 6) AS headloss, h <= 15 AS within FROM p",
    "lattice_reconfiguration": f"""
WITH RECURSIVE {_L}, {_START}, x AS (SELECT id, open FROM g WHERE id IN (0, 1, 3)), z AS (SELECT id AS c, open, 0::BIGINT AS node FROM x UNION SELECT z.c, z.open, b.t FROM z JOIN b ON b.f = z.node AND (z.open OR b.id <> z.c))
SELECT CAST(z.c AS VARCHAR) AS edge_id, CASE WHEN open THEN 'close' ELSE 'open' END AS action, count(*) - (SELECT count(*) FROM c WHERE cost <= 15) AS delta FROM z GROUP BY z.c, open""",
    "part_pumps": """
WITH RECURSIVE r AS (SELECT p_partkey AS node FROM part WHERE p_partkey IN (2, 3, 5) UNION SELECT p.p_partkey FROM r JOIN part p ON p.p_partkey // 2 = r.node AND p.p_size % 3 > 0) SELECT node FROM r""",
    "lattice_ties": f"""
WITH RECURSIVE {_L}, r AS (SELECT unnest([3, 17]) AS c, 0::BIGINT AS node UNION SELECT r.c, b.t FROM r JOIN b ON b.f = r.node AND (NOT b.open OR b.id = r.c))
SELECT CAST(c AS VARCHAR) AS tie_id, count(*) AS restored_nodes, CAST(sum(node % 4 + 1) AS DOUBLE) AS restored_demand FROM r GROUP BY c""",
    "lattice_zones": f"""
WITH RECURSIVE {_L}, r AS (SELECT unnest([0, m + 1, m * (m - 1)]) AS c, unnest([0, m + 1, m * (m - 1)]) AS node FROM s UNION SELECT r.c, g.t FROM r JOIN g ON g.f = r.node AND NOT g.open), x AS (SELECT *, count(*) OVER (PARTITION BY node) AS k FROM r)
SELECT c AS node, count(*) AS zone_nodes, count(*) FILTER (k > 1) AS overlap_nodes FROM x GROUP BY c""",
    "lattice_regulator": f"""
WITH RECURSIVE {_L}, x AS (SELECT DISTINCT t AS node FROM b WHERE f = 1 AND NOT open), r AS (SELECT node AS c, node FROM x UNION SELECT r.c, b.t FROM r JOIN b ON b.f = r.node AND NOT b.open AND b.t <> 1)
SELECT (SELECT count(*) FROM x) AS neighbours, EXISTS (SELECT 1 FROM r JOIN x ON x.node = r.node WHERE r.c <> r.node) AS alternate_path""",
    "lattice_capital": f"""
WITH RECURSIVE {_L}, y AS (SELECT CAST(id AS VARCHAR) AS id, f, t FROM g WHERE id % 2 = 0 OR f = 0), a AS (SELECT 'far' AS p, 'p0' AS id, 0::BIGINT AS f, m - 1 AS t, 900.0::DOUBLE AS cost FROM s UNION ALL SELECT 'near', 'p1', 0, 1, 50.0),
p AS (SELECT unnest(['', 'far', 'near']) AS p), w AS (SELECT p.p, y.* FROM p, y UNION ALL SELECT p, id, f, t FROM a), v AS (SELECT * FROM w UNION ALL SELECT p, id, t, f FROM w),
r AS (SELECT p, id AS c, 0::BIGINT AS node FROM w UNION SELECT r.p, r.c, v.t FROM r JOIN v ON v.p = r.p AND v.f = r.node AND v.id <> r.c),
l AS (SELECT w.p, count(*) AS k FROM w GROUP BY w.p), h AS (SELECT DISTINCT node FROM r WHERE p = ''), z AS (SELECT p, sum(node % 4 + 1) AS d FROM r GROUP BY p),
x AS (SELECT l.p, k * (SELECT sum(node % 4 + 1) FROM h) - d AS risk FROM l JOIN z USING (p))
SELECT a.p AS project_id, cost, CAST(greatest(0, o.risk - x.risk) AS DOUBLE) AS risk_avoided, round(greatest(0, o.risk - x.risk) / cost, 6) AS ratio FROM a JOIN x USING (p), x o WHERE o.p = ''""",
    "lattice_age_risk": f"""
WITH RECURSIVE {_L}, {_PAIRS}, k2 AS (SELECT DISTINCT o FROM q), {_COSTS.format(start='SELECT o FROM k2', step='b.cost')},
{_COSTS.format(start='SELECT o FROM k2', step=_RISK).replace('r AS', 'r2 AS', 1).replace('FROM r ', 'FROM r2 ').replace('FROM r)', 'FROM r2)').replace('r.', 'r2.').replace('c AS (', 'c2 AS (', 1)}
SELECT q.o AS origin, q.d AS destination, round(y.cost, 5) AS risk_cost, round(greatest(0, y.cost - x.cost), 5) AS premium FROM q JOIN c x ON x.o = q.o AND x.node = q.d JOIN c2 y ON y.o = q.o AND y.node = q.d""",
    "lattice_infiltration": f"WITH {_L}, x AS (SELECT id, CAST(id % 9 AS DOUBLE) AS o, CASE WHEN id % 4 > 0 THEN id % 6 END AS d FROM e), y AS (SELECT id, o / greatest(1e-9, coalesce(d, CASE WHEN o > 0 THEN o ELSE 1 END)) AS r FROM x) SELECT id AS edge_id, round(r, 6) AS ratio, r >= 1.25 AS flagged FROM y",
    "order_basins": "SELECT o_orderkey, CAST(greatest(0, CAST(round(o_totalprice) AS BIGINT) - length(o_orderpriority) * 15000) AS DOUBLE) AS overflow FROM orders",
}
