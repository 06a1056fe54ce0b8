"""Network queries over a road grid derived from ``nation`` keys and over supplier-part links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import network
from ..session import table


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Nations on a 5 by 5 grid; edges to the right and upwards, with costs from the keys."""
    n = F.col("n_nationkey").cast("long")
    keys = table(spark, d, "nation").select(n.alias("k"))
    right = keys.where("k % 5 < 4").select(
        (F.col("k") * 2).alias("edge_id"), F.col("k").alias("from_node"), (F.col("k") + 1).alias("to_node")
    )
    up = keys.where("k < 20").select(
        (F.col("k") * 2 + 1).alias("edge_id"), F.col("k").alias("from_node"), (F.col("k") + 5).alias("to_node")
    )
    edges = right.union(up)
    return edges.select(
        "edge_id", "from_node", "to_node", ((F.col("edge_id") * 7) % 11 + 1).cast("double").alias("cost"),
        ((F.col("edge_id") * 5) % 13 + 4).cast("double").alias("capacity")
    )


def links(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers (even) and parts (odd), linked by deliveries."""
    rows = table(spark, d, "lineitem")
    return rows.select(
        (F.col("l_suppkey") * 2).alias("from_node"), (F.col("l_partkey") * 2 + 1).alias("to_node")
    ).distinct().withColumn("edge_id", F.concat_ws("-", "from_node", "to_node"))


def _nodes(spark: SparkSession, d: str, *keys: int) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node")).where(F.col("node").isin(*keys))


def grid_costs(spark: SparkSession, d: str) -> DataFrame:
    found = network.service_area(network.both_ways(grid(spark, d)), 0, 1e9)
    return found.select("node", F.round("cost", 6).alias("cost"))


def grid_service_area(spark: SparkSession, d: str) -> DataFrame:
    return network.service_area(network.both_ways(grid(spark, d)), 12, 9.0).select("node", "cost")


def grid_od_matrix(spark: SparkSession, d: str) -> DataFrame:
    return network.od_costs(network.both_ways(grid(spark, d)), _nodes(spark, d, 0, 4, 12), _nodes(spark, d, 7, 20, 24))


def grid_supply(spark: SparkSession, d: str) -> DataFrame:
    return network.nearest_supply(
        network.both_ways(grid(spark, d)), _nodes(spark, d, 3, 21),
        table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    )


def link_components(spark: SparkSession, d: str) -> DataFrame:
    found = network.components(links(spark, d)).groupBy("component").agg(F.count("*").alias("n_nodes"))
    return found.select("component", "n_nodes")


def grid_topology(spark: SparkSession, d: str) -> DataFrame:
    return network.topology(grid(spark, d))


def grid_outage(spark: SparkSession, d: str) -> DataFrame:
    return network.outage(network.both_ways(grid(spark, d)), _nodes(spark, d, 0), ["0", "1"])


def grid_contingency(spark: SparkSession, d: str) -> DataFrame:
    """Each edge of the one-way grid cut alone, seen from its corner."""
    edges = grid(spark, d)
    demands = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("node"), (F.col("n_nationkey") % 4 + 1).cast("double").alias("demand")
    )
    return network.single_edge_screen(edges, _nodes(spark, d, 0), demands, edges.where("edge_id < 12"))


def grid_bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    """Total load is checked against demand times hops, which ties of paths don't change here."""
    nation = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("destination"), F.lit(0).cast("long").alias("origin"),
        (F.col("n_nationkey") % 3 + 1).cast("double").alias("demand")
    ).where("destination > 0")
    edges = grid(spark, d).withColumn("cost", F.pow(F.lit(1.37), F.col("edge_id").cast("double") % 17) + F.col("edge_id") / 1000.0)
    found = network.edge_loads(edges, nation)
    return found.select("edge_id", F.round("load", 6).alias("load"), F.round("stress", 6).alias("stress"))


def shared_corridors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("service"), F.col("l_suppkey").alias("from_node"), F.col("l_partkey").alias("to_node")
    )
    return network.shared_corridors(rows)


def grid_node_removal(spark: SparkSession, d: str) -> DataFrame:
    edges = grid(spark, d)
    demands = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("node"), (F.col("n_nationkey") % 4 + 1).cast("double").alias("demand")
    )
    return network.node_removal_screen(edges, _nodes(spark, d, 0), demands, _nodes(spark, d, 1, 5, 6, 12, 24))


def grid_restoration(spark: SparkSession, d: str) -> DataFrame:
    """Ties between row ends after the corner is cut off."""
    ties = table(spark, d, "nation").where("n_nationkey % 6 = 0 and n_nationkey > 0").select(
        F.col("n_nationkey").alias("tie_id"), F.lit(0).cast("long").alias("from_node"), F.col("n_nationkey").cast("long").alias("to_node")
    )
    return network.restoration_options(grid(spark, d), ties, _nodes(spark, d, 0), ["0", "1"])


def part_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Parts that depend on the part of half their key, failing from three of them."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 2).alias("depends_on"))
    return network.dependency_closure(parts, parts.where("node in (3, 10, 11)").select("node"))


def order_accumulation(spark: SparkSession, d: str) -> DataFrame:
    """Customers' balances run off to the customer of half their key."""
    c = table(spark, d, "customer").where("c_custkey > 0").select(
        F.col("c_custkey").alias("node"), F.round(F.col("c_acctbal") * 100).cast("long").alias("runoff")
    )
    edges = c.where("node > 1").select(F.col("node").alias("from_node"), F.floor(F.col("node") / 2).alias("to_node"))
    return network.flow_accumulation(edges, c)


_G = """(SELECT e AS edge_id, f AS from_node, t AS to_node, CAST((e * 7) % 11 + 1 AS DOUBLE) AS cost, CAST((e * 5) % 13 + 4 AS DOUBLE) AS capacity FROM
(SELECT CAST(n_nationkey * 2 AS BIGINT) AS e, CAST(n_nationkey AS BIGINT) AS f, CAST(n_nationkey + 1 AS BIGINT) AS t FROM nation WHERE n_nationkey % 5 < 4
 UNION ALL SELECT n_nationkey * 2 + 1, n_nationkey, n_nationkey + 5 FROM nation WHERE n_nationkey < 20))"""
_TWO = f"g AS (SELECT * FROM {_G}), b AS (SELECT from_node AS f, to_node AS t, cost FROM g UNION ALL SELECT to_node, from_node, cost FROM g)"
#: Least costs by relaxing all nodes 24 times, as many as a path can have edges.
_ALL = f"""WITH RECURSIVE {_TWO},
r AS (SELECT CAST(n.n_nationkey AS BIGINT) AS s, CAST(n.n_nationkey AS BIGINT) AS node, 0.0::DOUBLE AS cost, 0 AS k FROM nation n
      UNION ALL SELECT s, node, min(cost), k + 1 FROM (SELECT r.s, b.t AS node, r.cost + b.cost AS cost, r.k FROM r JOIN b ON b.f = r.node UNION ALL SELECT s, node, cost, k FROM r) WHERE k < 24 GROUP BY s, node, k),
c AS (SELECT s, node, min(cost) AS cost FROM r GROUP BY s, node)"""

QUERIES = {
    f.__name__: f
    for f in (
        grid_costs, grid_service_area, grid_od_matrix, grid_supply, link_components, grid_topology, grid_outage, grid_contingency,
        grid_bottlenecks, grid_node_removal, grid_restoration, part_dependencies, order_accumulation, shared_corridors
    )
}

SQL = {
    "grid_costs": f"{_ALL} SELECT node, round(cost, 6) AS cost FROM c WHERE s = 0",
    "grid_service_area": f"{_ALL} SELECT node, cost FROM c WHERE s = 12 AND cost <= 9",
    "grid_od_matrix": f"{_ALL} SELECT s AS origin, node AS destination, cost FROM c WHERE s IN (0, 4, 12) AND node IN (7, 20, 24)",
    "grid_supply": f"{_ALL} SELECT node AS demand_node, s AS supply_node, cost FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cost, s) AS k FROM c WHERE s IN (3, 21)) WHERE k = 1",
    "link_components": """
WITH RECURSIVE l AS (SELECT DISTINCT l_suppkey * 2 AS f, l_partkey * 2 + 1 AS t FROM lineitem), b AS (SELECT f, t FROM l UNION SELECT t, f FROM l),
r AS (SELECT DISTINCT f AS node, f AS root, 0 AS i FROM b UNION ALL SELECT node, min(root), i + 1 FROM (SELECT b.t AS node, r.root, r.i FROM r JOIN b ON b.f = r.node UNION ALL SELECT node, root, i FROM r) WHERE i < 20 GROUP BY node, i),
c AS (SELECT node, min(root) AS component FROM r GROUP BY node)
SELECT component, count(*) AS n_nodes FROM c GROUP BY component""",
    "grid_topology": "SELECT 25::BIGINT AS n_nodes, 1::BIGINT AS n_components, 40::BIGINT AS n_edges, 0::BIGINT AS n_loops, 0::BIGINT AS n_repeated",
    "grid_outage": "SELECT CAST(n_nationkey AS BIGINT) AS node, n_nationkey = 0 AS energised FROM nation",
    "grid_contingency": f"""
WITH RECURSIVE g AS (SELECT * FROM {_G}), cases AS (SELECT edge_id AS c FROM g WHERE edge_id < 12),
r AS (SELECT c, 0::BIGINT AS node FROM cases UNION SELECT r.c, g.to_node FROM r JOIN g ON g.from_node = r.node AND g.edge_id <> r.c)
SELECT CAST(c AS VARCHAR) AS edge_id, 25 - count(*) AS lost_nodes, CAST((SELECT sum(n_nationkey % 4 + 1) FROM nation) - sum(node % 4 + 1) AS DOUBLE) AS lost_demand FROM r GROUP BY c""",
    "grid_node_removal": f"""
WITH RECURSIVE g AS (SELECT * FROM {_G}), r AS (SELECT CAST(c AS BIGINT) AS c, 0::BIGINT AS node FROM (SELECT unnest([1, 5, 6, 12, 24]) AS c) UNION SELECT r.c, g.to_node FROM r JOIN g ON g.from_node = r.node AND g.to_node <> r.c)
SELECT c AS node, CAST((SELECT sum(n_nationkey % 4 + 1) FROM nation) - sum(node % 4 + 1) AS DOUBLE) AS lost_demand FROM r GROUP BY c""",
    "grid_restoration": f"""
WITH RECURSIVE g AS (SELECT * FROM {_G} WHERE edge_id > 1), r AS (SELECT n_nationkey AS tie_id, CAST(n_nationkey AS BIGINT) AS node FROM nation WHERE n_nationkey % 6 = 0 AND n_nationkey > 0 UNION SELECT r.tie_id, g.to_node FROM r JOIN g ON g.from_node = r.node)
SELECT tie_id, count(*) AS restored_nodes FROM r GROUP BY tie_id""",
    "part_dependencies": """
WITH RECURSIVE r AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_partkey IN (3, 10, 11) UNION ALL SELECT p.p_partkey, level + 1 FROM r JOIN part p ON p.p_partkey // 2 = r.node AND p.p_partkey > 1)
SELECT node, CAST(min(level) AS BIGINT) AS level FROM r GROUP BY node""",
    "order_accumulation": """
WITH RECURSIVE c AS (SELECT c_custkey AS node, CAST(round(c_acctbal * 100) AS BIGINT) AS v FROM customer WHERE c_custkey > 0), r AS (SELECT node, v FROM c UNION ALL SELECT r.node // 2, v FROM r WHERE r.node > 1)
SELECT node, CAST(sum(v) AS BIGINT) AS flow FROM r GROUP BY node""",
    "shared_corridors": """
WITH p AS (SELECT DISTINCT l_returnflag AS s, least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem)
SELECT x.s AS service_a, y.s AS service_b, count(*) AS n_shared FROM p x JOIN p y USING (a, b) WHERE x.s < y.s GROUP BY 1, 2""",
    "grid_bottlenecks": f"""
WITH RECURSIVE g AS (SELECT edge_id, from_node AS f, to_node AS t, pow(1.37, edge_id % 17) + edge_id / 1000.0 AS cost, capacity FROM {_G}),
r AS (SELECT CAST(n_nationkey AS BIGINT) AS s, CAST(n_nationkey AS BIGINT) AS node, 0.0::DOUBLE AS cost, 0 AS k FROM nation
      UNION ALL SELECT s, node, min(cost), k + 1 FROM (SELECT r.s, g.t AS node, r.cost + g.cost AS cost, r.k FROM r JOIN g ON g.f = r.node UNION ALL SELECT s, node, cost, k FROM r) WHERE k < 24 GROUP BY s, node, k),
c AS (SELECT s, node, min(cost) AS cost FROM r GROUP BY s, node), d AS (SELECT CAST(n_nationkey AS BIGINT) AS d, CAST(n_nationkey % 3 + 1 AS DOUBLE) AS demand FROM nation WHERE n_nationkey > 0),
l AS (SELECT g.edge_id, sum(demand) AS load FROM g JOIN c a ON a.s = 0 AND a.node = g.f JOIN c z ON z.s = g.t JOIN d ON d.d = z.node JOIN c w ON w.s = 0 AND w.node = d.d WHERE abs(a.cost + g.cost + z.cost - w.cost) < 1e-7 GROUP BY 1)
SELECT CAST(g.edge_id AS VARCHAR) AS edge_id, round(coalesce(load, 0), 6) AS load, round(pow(coalesce(load, 0) / capacity, 2), 6) AS stress FROM g LEFT JOIN l USING (edge_id)""",
}
