"""Searches over networks in blocks of nodes.

Nodes are dealt into blocks of bounded size by the order of their ids. A round
searches every block that something came into, as far as it goes inside, and
passes on what leaves it. So the number of rounds is how often a path changes its
block, not how many edges it has; ids that lie near each other in the network
make it small. A task holds one case of one block.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: Nodes of a block, about.
BLOCK_NODES = 16_384
#: Rounds whose rows are read one by one before they are written together.
_ROUNDS = 16


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compact(parts: list[DataFrame], merge=lambda df: df) -> list[DataFrame]:
    return parts if len(parts) < _ROUNDS else [settle(merge(union(parts)), "rounds")]


def node_blocks(nodes: DataFrame, size: int | None = None) -> DataFrame:
    """``(node, block)`` of distinct nodes."""
    nodes = settle(nodes.select("node").where("node is not null").distinct(), "nodes")
    n = max(1, -(-nodes.count() // (size or BLOCK_NODES)))
    return settle(nodes.repartitionByRange(n, "node").withColumn("block", F.spark_partition_id()), "blocks")


def in_blocks(steps: DataFrame, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``steps(from_node, to_node, ...)`` with ``from_block`` and ``to_block``, and the blocks of the nodes."""
    blocks = node_blocks(steps.select(F.col("from_node").alias("node")).union(steps.select("to_node")), size)
    one = blocks.withColumnsRenamed({"node": "from_node", "block": "from_block"})
    two = blocks.withColumnsRenamed({"node": "to_node", "block": "to_block"})
    return settle(steps.join(one, "from_node").join(two, "to_node"), "steps"), blocks


def _search_block(limit: float | None):
    def run(inbox: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        known, heap = {}, []
        for node, cost, hops, edge, new in zip(inbox.node, inbox.cost, inbox.hops, inbox.edge_id, inbox.new, strict=True):
            label = (cost, hops, edge)
            if new:
                heap.append((label, node))
            elif node not in known or label < known[node]:
                known[node] = label
        out = {}
        for a, b, block, inside, cost, hop, edge in zip(
            steps.from_node, steps.to_node, steps.to_block, steps.to_block == steps.from_block, steps.step, steps.hop, steps.by, strict=True
        ):
            out.setdefault(a, []).append((b, block, inside, cost, hop, edge))
        heap = [(label, k, node) for k, (label, node) in enumerate(sorted(heap, key=lambda x: x[0]))]
        found, sent, k = {}, {}, len(heap)
        while heap:
            label, _, node = heapq.heappop(heap)
            if node in known and known[node] <= label:
                continue
            found[node] = known[node] = label
            for b, block, inside, cost, hop, edge in out.get(node, ()):
                on = (label[0] + cost, label[1] + hop, edge)
                if limit is not None and on[0] > limit:
                    continue
                if not inside:
                    if b not in sent or on < sent[b][0]:
                        sent[b] = (on, block)
                elif b not in known or on < known[b]:
                    heapq.heappush(heap, (on, k, b))
                    k += 1
        source, block = (inbox.source.iloc[0], inbox.block.iloc[0]) if len(inbox) else (None, None)
        rows = [(source, block, node, *label, False) for node, label in found.items()]
        rows += [(source, to, node, *label, True) for node, (label, to) in sent.items()]
        return pd.DataFrame(rows, columns=["source", "block", "node", "cost", "hops", "edge_id", "new"])

    return run


def search(
    steps: DataFrame, blocks: DataFrame, starts: DataFrame, limit: float | None = None, cut=None, max_rounds: int = 10_000
) -> DataFrame:
    """``(source, block, node, cost, hops, edge_id)``: the least labels that ``starts(source, node, cost)`` lead to.

    ``steps`` of ``in_blocks`` have ``step`` and ``hop``, which are added to cost and
    hops, and ``by``, the edge that a label keeps; labels are compared in that order.
    ``cut`` takes the steps that are to be searched, with ``source``, and returns those
    that are left.
    """
    start = starts.select("source", "node", F.col("cost").cast("double").alias("cost")).distinct()
    # Starts that no edge touches are reached, and lead nowhere.
    start = start.join(blocks, "node", "left").select(
        "source", F.coalesce("block", F.lit(-1)).alias("block"), "node", "cost", F.lit(0).cast("long").alias("hops"),
        F.lit("").alias("edge_id"), F.lit(True).alias("new")
    )
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in start.schema)
    inbox, found = settle(start, "starts"), []
    for _ in range(max_rounds):
        active = inbox.select("source", "block").distinct()
        lanes = active.join(steps, F.col("block") == F.col("from_block"))
        lanes = (lanes if cut is None else cut(lanes)).select(
            F.col("source").alias("_source"), F.col("block").alias("_block"), "from_block", "from_node", "to_node", "to_block", "step", "hop", "by"
        )
        rows = inbox
        if found:
            rows = inbox.unionByName(union(found).join(active, ["source", "block"], "left_semi"))
        out = settle(
            rows.groupBy("source", "block").cogroup(lanes.groupBy("_source", "_block")).applyInPandas(_search_block(limit), kind), "searched"
        )
        inbox = out.where("new")
        found = compact([*found, out.where("not new")])
        if inbox.isEmpty():
            best = union(found).groupBy("source", "block", "node").agg(F.min(F.struct("cost", "hops", "edge_id")).alias("best"))
            return best.select("source", "block", "node", "best.*")
    raise RuntimeError("the search did not end within the allowed rounds")


def reach(edges: DataFrame, starts: DataFrame, cut=None) -> DataFrame:
    """``(case, node)`` reached from ``starts(case, node)``; ``cut`` takes and returns rows ``(case, from_node, to_node, by, ...)``.

    Further columns of ``edges`` can be asked for by ``cut``; ``by`` is the text of ``edge_id``.
    """
    steps = edges.drop("step", "hop").withColumns({"step": F.lit(0.0), "hop": F.lit(0).cast("long"), "by": F.lit("")})
    if "edge_id" in edges.columns:
        steps = steps.withColumn("by", F.coalesce(F.col("edge_id").cast("string"), F.lit("")))
    steps, blocks = in_blocks(steps)
    own = lambda lanes: cut(lanes.withColumnRenamed("source", "case")).withColumnRenamed("case", "source").withColumn("by", F.lit(""))
    plain = lambda lanes: lanes.withColumn("by", F.lit(""))
    found = search(
        steps, blocks, starts.select(F.col("case").alias("source"), "node", F.lit(0.0).alias("cost")), cut=plain if cut is None else own
    )
    return found.select(F.col("source").alias("case"), "node")


def _walk_block(tree: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
    columns = ["source", "block", "tag", "node", "amount", "edge_id", "from_node", "hops", "new"]
    if not len(at) or not len(tree):
        return pd.DataFrame([], columns=columns)
    source, block = at["_source"].iloc[0], at["_block"].iloc[0]
    back = {
        node: (edge, before, to, hops)
        for node, edge, before, to, hops in zip(tree.node, tree.edge_id, tree.from_node, tree.from_block, tree.hops, strict=True)
    }
    heap, held, rows = [], {}, []
    for node, tag, amount in zip(at.node, at.tag, at.amount, strict=True):
        if (node, tag) not in held:
            held[node, tag] = 0.0
            if node in back:
                heap.append((-back[node][3], len(heap), node, tag))
        held[node, tag] += amount
    heapq.heapify(heap)
    k = len(heap)
    while heap:  # the farthest first, so that what meets goes on together
        _, _, node, tag = heapq.heappop(heap)
        edge, before, to, hops = back[node]
        amount = held.pop((node, tag))
        rows.append((source, block, tag, node, amount, edge, before, hops, False))
        if to != block:
            rows.append((source, to, tag, before, amount, "", before, 0, True))
        elif (before, tag) in held:
            held[before, tag] += amount
        else:
            held[before, tag] = amount
            if before in back:
                heapq.heappush(heap, (-back[before][3], k, before, tag))
                k += 1
    return pd.DataFrame(rows, columns=columns)


def walk_back(tree: DataFrame, at: DataFrame) -> DataFrame:
    """``(source, tag, node, edge_id, from_node, hops, amount)``: the edges of the paths from ``at(source, tag, node, amount)`` back to the roots.

    ``tree(source, block, node, hops, edge_id, from_node, from_block)`` has each node's last
    edge. Amounts that meet with one tag go on together, within a round; those of several rounds are several rows.
    """
    blocks = tree.select("source", "node", "block")
    start = at.groupBy("source", "tag", "node").agg(F.sum("amount").cast("double").alias("amount")).join(blocks, ["source", "node"])
    inbox = settle(start.select("source", "block", "tag", "node", "amount"), "walkers")
    types = dict([*tree.dtypes, *inbox.dtypes])
    kind = ", ".join(
        f"`{c}` {types.get(c, 'boolean')}" for c in ("source", "block", "tag", "node", "amount", "edge_id", "from_node", "hops", "new")
    )
    found = []
    while True:
        near = tree.join(inbox.select("source", "block").distinct(), ["source", "block"], "left_semi")
        came = inbox.withColumnsRenamed({"source": "_source", "block": "_block"})
        out = settle(
            near.groupBy("source", "block").cogroup(came.groupBy("_source", "_block")).applyInPandas(_walk_block, kind), "walked"
        )
        found = compact([*found, out.where("not new").drop("new", "block")])
        inbox = out.where("new").select("source", "block", "tag", "node", "amount")
        if inbox.isEmpty():
            return union(found)


def rooted(found: DataFrame, steps: DataFrame) -> DataFrame:
    """The tree that ``walk_back`` takes, of the labels that ``search`` found over these steps."""
    last = found.where("edge_id <> ''").select("source", "block", "node", "hops", "edge_id")
    into = steps.select(F.col("by").alias("_by"), F.col("to_node").alias("_to"), "from_node", "from_block").dropDuplicates(["_by", "_to"])
    met = last.join(into, (F.col("edge_id") == F.col("_by")) & (F.col("node") == F.col("_to"))).drop("_by", "_to")
    return settle(met, "tree")


def parting(steps: DataFrame, blocks: DataFrame, path: DataFrame, starts: DataFrame) -> DataFrame:
    """``(case, edge_id)``: the edges of each case's path without which its end is not reached.

    ``path(case, place, node, edge_id)`` has the nodes of a path, at places from 1, and the
    edges that lead to them; ``starts(case, node)`` are at place 0. Off the path, each node learns the
    first place that it is reached from. An edge parts the ends where no node
    behind it is reached from before it. Ids of edges are unique, but for directions.
    """
    path = settle(path.select("case", "place", "node", "edge_id").distinct(), "path")
    used = path.select(F.col("case").alias("source"), F.col("edge_id").alias("by"))
    plain = steps.withColumns({"step": F.lit(0.0), "hop": F.lit(0).cast("long")})
    off = lambda lanes: lanes.join(used, ["source", "by"], "left_anti").withColumn("by", F.lit(""))
    begin = starts.select(F.col("case").alias("source"), "node", F.lit(0.0).alias("cost")).union(
        path.select("case", "node", F.col("place").cast("double"))
    )
    least = search(plain, blocks, begin, cut=off).select(F.col("source").alias("case"), "node", "cost")
    ordered = path.join(least, ["case", "node"])
    behind = Window.partitionBy("case").orderBy(F.desc("place"))
    return ordered.withColumn("least", F.min("cost").over(behind)).where(F.col("least") >= F.col("place")).select("case", "edge_id")
