"""A prefix trie over conversations: what they share, and what a cache of shared prefixes would save.

A turn is known by 128 bits of the SHA-256 of its role and text, so texts are
read once and never shuffled; a conversation is the string of its turns' keys,
16 bytes each, and sorts as such. Equal conversations become one row first, with
the number of its members; their ids are sorted in ranges and joined into pieces
before the one hash that needs them in order.

Tasks sort what they read into runs, with the number of turns that each row
shares with the one before it. Rows are dealt in ranges of their strings; what
comes of a run into a range is still sorted, and a loser tree merges those pieces
by the carried numbers: of two rows the one that shares more with the last winner
comes first, and only equal numbers make it look at turns, from there on. The
merged stream closes the nodes of a stack of open ones. Ranges are cut by bytes,
so that a task holds some ``RANGE_BYTES`` of strings.

A node whose members lie in several ranges is on the first or last path of each.
From its neighbours' border strings a range knows which of these nodes began
before it; such rows are parts whose columns add up, and are joined afterwards.

Defined cases: null roles and texts are empty; a null turn number comes first;
turns with one number are ordered by their keys, and repeated rows are turns of
their own; rows without a conversation id are left out; a conversation may have
no turns left, and then ends at the root; an empty table gives an empty result.
A conversation's keys are one value of a row: 2 GB, or 134 million turns, at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .base import materialise, range_count, shuffle_partitions, table
from .runs import starts

KEY = 16
RANGE_BYTES = 16 << 20
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
_SORTED = "run long, pos long, lcp int, key binary, chars array<int>, n long, conv_id long, ends string"
_NODE = (
    "part int, path binary, parent_path binary, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends string, turn_key binary"
)


def _digest(value: Column) -> Column:
    """The first 128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(value, 256)), 1, KEY)


def turn_arrays(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(conv_id, turns)``, a row for each conversation: keys of turns and code points of their texts, in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col("turn"), key.alias("key"), F.char_length(text).alias("chars")).alias("t"))
    ordered = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))).alias("turns"))


def _member_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one sequence, sorted, as pieces of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, ids = starts(batch, ("sid",)).tolist(), batch.column("conv_id").to_pylist()
        pieces = [",".join(map(str, ids[a:b])) for a, b in zip(at, [*at[1:], len(ids)], strict=True)]
        columns = [batch.column("sid").take(pa.array(at)), pa.array([ids[a] for a in at], pa.int64()), pa.array(pieces, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["sid", "first", "piece"])


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each sequence, over its pieces in order."""
    sid, state = None, None

    def closed(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.binary()), pa.array([h for _, h in found], pa.string())], ["sid", "ends"])

    for batch in batches:
        found = []
        for s, piece in zip(batch.column("sid").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if s != sid:
                if state is not None:
                    found.append((sid, state.hexdigest()))
                sid, state = s, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield closed(found)
    if state is not None:
        yield closed([(sid, state.hexdigest())])


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """How many first turns two strings of keys share, of which ``known`` are known."""
    n, k = min(len(a), len(b)) // KEY, known
    while k < n and a[k * KEY : (k + 1) * KEY] == b[k * KEY : (k + 1) * KEY]:
        k += 1
    return k


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as a sorted run; every row carries the turns that it shares with the row before it."""
    run = TaskContext.get().partitionId() << 32
    for batch in batches:
        keys = batch.column("key").to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        lcps = [0] * len(order)
        for k in range(1, len(order)):
            lcps[k] = shared_turns(keys[order[k - 1]], keys[order[k]])
        own = [pa.array([run] * len(order), pa.int64()), pa.array(range(len(order)), pa.int64()), pa.array(lcps, pa.int32())]
        yield pa.RecordBatch.from_arrays([*own, *batch.take(pa.array(order, pa.int64())).columns], ["run", "pos", "lcp", *batch.schema.names])
        run += 1


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """``(run, row, lcp)`` in the order of all rows, where ``lcp`` is what a row shares with the one before it.

    ``runs`` are sorted strings and what each shares with the one before it in its
    run. A loser tree: the losers that a winner met know what they share with it,
    so that its successor meets them with numbers that are right.
    """
    runs = [r for r in runs if r[0]]
    k = len(runs)
    if not k:
        return
    at, lcp = [0] * k, [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's number becomes what it shares with the winner."""
        if at[a] >= len(runs[a][0]):
            return b, a
        if at[b] >= len(runs[b][0]) or lcp[a] > lcp[b]:
            return a, b
        if lcp[a] < lcp[b]:
            return b, a
        x, y = runs[a][0][at[a]], runs[b][0][at[b]]
        same = shared_turns(x, y, lcp[a])
        a, b = (a, b) if x[same * KEY : (same + 1) * KEY] <= y[same * KEY : (same + 1) * KEY] else (b, a)
        lcp[b] = same
        return a, b

    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while at[top] < len(runs[top][0]):
        yield top, at[top], lcp[top]
        at[top] += 1
        if at[top] < len(runs[top][0]):
            lcp[top] = runs[top][1][at[top]]
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


class _Node:
    __slots__ = ("parent", "depth", "end", "new", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "key", "chars")

    def __init__(self, parent: _Node | None, depth: int, new: bool, key: bytes, chars: int):
        self.parent, self.depth, self.new, self.key, self.chars = parent, depth, new, key, chars
        self.end, self.conv_id, self.n_convs, self.n_children, self.n_leaves, self.saved = None, None, 0, 0, 0, 0

    def close(self, goes_on: bool) -> None:
        """What the node's own members give, and then its share of the parent's; ``goes_on``: it has children in the next range."""
        if not self.n_children and not self.n_leaves and not goes_on:
            self.n_leaves = 1
        self.saved += (self.n_convs - self.new) * self.chars
        p = self.parent
        if p is not None:
            p.conv_id = self.conv_id if p.conv_id is None else min(p.conv_id, self.conv_id)
            p.n_convs += self.n_convs
            p.n_children += self.new
            p.n_leaves += self.n_leaves
            p.saved += self.saved


def range_nodes(rows: dict[str, list], before: int, after: int) -> Iterator[dict]:
    """The nodes of one range, in the order in which they end.

    ``before`` and ``after`` are the turns that the first and last row share with the
    neighbouring ranges' rows, -1 where there is none. Nodes down to there have a
    ``path``; their columns are this range's part.
    """
    runs: list[tuple[list[bytes], list[int]]] = []
    source: list[list[int]] = []
    for k in sorted(range(len(rows["run"])), key=lambda k: (rows["run"][k], rows["pos"][k])):
        goes_on = source and rows["run"][source[-1][-1]] == rows["run"][k]
        if not goes_on:
            runs.append(([], []))
            source.append([])
        runs[-1][0].append(rows["key"][k])
        runs[-1][1].append(rows["lcp"][k] if goes_on else 0)
        source[-1].append(k)
    order = [(source[r][i], lcp) for r, i, lcp in merged(runs)]
    first, last = rows["key"][order[0][0]], rows["key"][order[-1][0]]
    stack: list[_Node] = []
    done: list[_Node] = []
    for n, (k, lcp) in enumerate(order):
        key, chars = rows["key"][k], rows["chars"][k]
        while len(stack) > lcp + 1:
            node = stack.pop()
            node.close(False)
            done.append(node)
        for depth in range(len(stack), len(key) // KEY + 1):
            new = n > 0 or depth > before
            stack.append(_Node(stack[-1] if stack else None, depth, new, key[(depth - 1) * KEY : depth * KEY] if depth else b"", chars[depth - 1] if depth else 0))
        node = stack[-1]
        node.end, node.n_convs = rows["ends"][k], node.n_convs + rows["n"][k]
        node.conv_id = rows["conv_id"][k] if node.conv_id is None else min(node.conv_id, rows["conv_id"][k])
    on_last = {id(x) for x in stack}
    while stack:
        node = stack.pop()
        node.close(node.depth <= after)
        done.append(node)

    def path(node: _Node) -> bytes | None:
        """The name of a node that may lie in several ranges."""
        if id(node) in on_last and node.depth <= after:
            return hashlib.sha256(last[: node.depth * KEY]).digest()[:KEY]
        if not node.new:
            return hashlib.sha256(first[: node.depth * KEY]).digest()[:KEY]
        return None

    for node in done:
        own, above = path(node), path(node.parent) if node.parent else None
        yield {
            "path": own, "parent_path": above, "conv_id": node.conv_id, "parent_conv_id": node.parent.conv_id if node.parent and above is None else None,
            "depth": node.depth, "n_convs": node.n_convs, "n_children": node.n_children, "n_leaves": node.n_leaves, "saved_tokens": node.saved,
            "ends": node.end, "turn_key": node.key,
        }


def _nodes(rows: pa.Table, borders: pa.Table) -> pa.Table:
    border = borders.to_pylist()[0]
    found = [{"part": border["part"], **r} for r in range_nodes(rows.to_pydict(), border["before"], border["after"])]
    kinds = [("part", pa.int32()), ("path", pa.binary()), ("parent_path", pa.binary())]
    kinds += [(c, pa.int64()) for c in ("conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return pa.Table.from_pylist(found, pa.schema([*kinds, ("ends", pa.string()), ("turn_key", pa.binary())]))


@F.udf(returnType=IntegerType(), useArrow=False)
def _shared(a: bytes, b: bytes) -> int:
    """Called once a range."""
    return -1 if a is None or b is None else shared_turns(bytes(a), bytes(b))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie over ``sequences``, rows as ``turn_arrays`` gives them.

    Columns: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256`` and ``turn_key``, the
    key of the node's last turn.
    """
    spark = sequences.sparkSession
    n = shuffle_partitions(spark)
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), ""))
    strings = sequences.select("conv_id", key.alias("key"), F.col("turns.chars").alias("chars"))
    strings = materialise(strings.withColumn("sid", _digest(F.col("key"))), "conversation_strings")
    members = strings.select("sid", "conv_id").repartitionByRange(n, "sid", "conv_id").sortWithinPartitions("sid", "conv_id")
    pieces = members.mapInArrow(_member_ids, "sid binary, first long, piece string")
    ends = pieces.repartition(n, "sid").sortWithinPartitions("sid", "first").mapInArrow(_hash_pieces, "sid binary, ends string")
    distinct = strings.groupBy("sid").agg(
        F.first("key").alias("key"), F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id")
    )
    distinct = materialise(distinct.join(ends, "sid"), "distinct_conversations")
    size = distinct.agg(F.sum(F.length("key") + 32).alias("bytes")).first()["bytes"]

    runs = distinct.select("key", "chars", "n", "conv_id", "ends").mapInArrow(_sorted_runs, _SORTED)
    dealt = materialise(runs.repartitionByRange(range_count(spark, size, RANGE_BYTES), "key").withColumn("part", F.spark_partition_id()), "sorted_runs")
    # One row for each range.
    order = Window.orderBy("part")
    borders = dealt.groupBy("part").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    borders = borders.select("part", _shared(F.lag("most").over(order), "least").alias("before"))
    borders = borders.withColumn("after", F.coalesce(F.lead("before").over(order), F.lit(-1)))
    parts = dealt.groupBy("part").cogroup(borders.groupBy("part")).applyInArrow(_nodes, _NODE)
    parts = materialise(parts, "trie_parts")

    split = parts.where("path IS NOT NULL")
    whole = split.groupBy("path").agg(
        F.first("parent_path").alias("parent_path"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends"), F.first("turn_key").alias("turn_key")
    )
    whole = materialise(whole, "trie_borders")
    above = whole.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_MEMBERS)).alias("ends_sha256"), "turn_key"]
    # A range's nodes look up their parents among that range's own paths, so that no path is one hot key.
    local = split.select("part", F.col("path").alias("parent_path")).join(above, "parent_path")
    hanging = parts.where("path IS NULL AND parent_path IS NOT NULL").drop("parent_conv_id").join(local, ["part", "parent_path"])
    inner = parts.where("path IS NULL AND parent_path IS NULL")
    return inner.select(*out).unionByName(hanging.select(*out)).unionByName(whole.join(above, "parent_path", "left").select(*out))


def with_base_turns(sequences: DataFrame) -> DataFrame:
    """Conversation c becomes the first h turns of conversation c - c % 100, and then its own after its first h; h is crc32(c) % 6."""
    base = sequences.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, 5).alias("base_turns"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    rows = sequences.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % 100).join(base, "base_id", "left")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.select("conv_id", F.when(F.col("base_turns").isNull(), own).otherwise(F.concat(F.slice("base_turns", F.lit(1), h), own)).alias("turns"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_base_turns(turn_arrays(table(spark, sf_dir, "conversations")))).drop("turn_key")


OP13_SQL = r"""
WITH turns AS (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars,
        turn FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT conv_id, k, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i FROM turns),
ids AS (
    SELECT conv_id, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
        lambda crc, b: list_reduce([xor(crc, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
    SELECT c.conv_id, n.i, n.k, n.chars FROM ids c JOIN numbered n ON n.conv_id = c.conv_id - c.conv_id % 100 WHERE n.i <= c.h
    UNION ALL
    SELECT c.conv_id, n.i, n.k, n.chars FROM ids c JOIN numbered n ON n.conv_id = c.conv_id WHERE n.i > c.h),
places AS (
    SELECT conv_id, k, chars, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth FROM rebuilt),
paths AS (
    SELECT conv_id, depth, chars, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM places
    UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
tops AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (
    SELECT p.path, any_value(p.depth) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(p.chars) AS own,
        sha256(coalesce(string_agg(CASE WHEN t.depth = p.depth THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
    FROM paths p JOIN tops t USING (conv_id) GROUP BY p.path),
linked AS (SELECT n.*, CASE WHEN depth > 0 THEN left(path, length(path) - 64) END AS parent_path FROM nodes n),
kids AS (SELECT parent_path AS path, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY parent_path),
trees AS (
    SELECT left(n.path, (64 * a.d)::BIGINT) AS path, sum(n.own) AS saved_tokens, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves
    FROM linked n LEFT JOIN kids k ON k.path = n.path, unnest(range(n.depth + 1)) AS a(d) GROUP BY ALL)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, t.n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM linked n JOIN trees t ON t.path = n.path LEFT JOIN kids k ON k.path = n.path LEFT JOIN linked u ON u.path = n.parent_path
"""
