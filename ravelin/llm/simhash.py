"""Near-duplicate documents by SimHash and a self-join of binary tries.

Fingerprints are the paths of a binary trie. Two of them link if they differ in
few bits, so the join walks pairs of trie nodes together, adds up the bits in
which the two paths differ, and drops a pair as soon as that exceeds the budget.

A walk from the root would meet nearly every pair of upper nodes. With a budget
of two, one of three disjoint bit segments must agree, so three tries are used,
each with another segment first, and each starts from the nodes that share it.
Nodes with many fingerprints are walked further as DataFrame rows (one row for
each fingerprint and node pair) until a pair fits into a task; there the walk
goes on over sorted arrays. Tasks return a spanning forest, so that the number
of links stays below the number of fingerprints.

One fingerprint of three-word shingles within two bits finds copies with very few
changes. Near duplicates at a similarity of 0.8 in five-word shingles differ in
more bits, so for them the sets of shingles themselves are used: minima of their
hashes are banded into keys, the nodes that keys connect are candidates, and a
candidate links where its whole set is alike.

Defined cases: null and empty texts have fingerprint zero and link like others;
repeated rows link to themselves; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialise, shuffle_partitions, slices, table, text_key, texts_of
from .bloom import blocks_for, bloom_filter, possible

SHINGLE_WORDS = 3
MAX_BITS = 2
SEGMENT = 21
STEP = 11
#: Fingerprints in a node pair beyond which it is walked further before a task takes it.
PAIR_ROWS = 1024
LEAF = 64
#: Bits of each byte value at each byte position, most significant first.
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    whole = b" ".join(words)
    if n < 1:
        hashes = [xxhash.xxh64_intdigest(whole, 42)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        cuts = map(slice, starts[:n].tolist(), ends[shingle - 1 :].tolist())
        hashes = [xxhash.xxh64_intdigest(whole[c], 42) for c in cuts]
    as_bytes = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((as_bytes + np.arange(8) * 256).ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


#: Words of a shingle of the sets that near duplicates are compared by.
SIGNATURE_SHINGLE = 5
#: Keys of a set, and the minima that must agree for a key to be shared. Of pairs at a
#: similarity (Jaccard) of 0.8, 1 - (1 - 0.8 ** 7) ** 40 = 0.9999 share one.
BANDS, BAND_ROWS = 40, 7
#: Least similarity of near duplicates, as a fraction.
ALIKE = (4, 5)
_CHUNK = 2048
_MOST_WORDS = 250_000


class _Words(dict):
    """The 64-bit hash of each word seen by a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value


_words = _Words()


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of hashes of 64-bit values."""
    x = x * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, sorted; short texts have one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(1, np.uint64)
    own = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    size = min(SIGNATURE_SHINGLE, n)
    shingles = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        shingles = shingles * np.uint64(0xD6E8FEB86659FD93) + own[k : n - size + 1 + k]
    return np.unique(_mix(shingles, 0))


@cache
def _multipliers() -> np.ndarray:
    return _mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64), 1) | np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set, each of ``BAND_ROWS`` minima of its hashes in other orders."""
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for k in range(0, len(shingles), _CHUNK):
        np.minimum(least, np.multiply.outer(_multipliers(), shingles[k : k + _CHUNK]).min(1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = _mix(keys ^ row, 2)
    return keys


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(id, text_key, fp)`` for each row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t, shingle) for t in texts_of(part)], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text_key"), pa.array(fps.view(np.int64))], [id_col, "text_key", "fp"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(text_col).alias("text_key"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, text_key long, fp long")


def trie_pairs(left: np.ndarray, right: np.ndarray | None, depth: int, used: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of linked fingerprints, one in ``left`` and one in ``right``.

    Both are sorted and below one node each at ``depth``; the nodes' paths
    differ in ``used`` bits. Without ``right``, pairs within ``left``.
    """
    same = right is None
    other = left if same else right
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    todo = [(0, len(left), 0, len(other), depth, used, same)]
    while todo:
        a0, a1, b0, b1, d, err, twin = todo.pop()
        if a0 == a1 or b0 == b1 or (twin and a1 - a0 < 2):
            continue
        if d == 64 or (a1 - a0) * (b1 - b0) <= LEAF * LEAF:
            near = np.bitwise_count(left[a0:a1, None] ^ other[None, b0:b1]) <= budget
            i, j = np.nonzero(np.triu(near, 1) if twin else near)
            out_a.append(i + a0)
            out_b.append(j + b0)
            continue
        bit = np.uint64(1 << (63 - d))
        a = a0 + int(np.searchsorted((left[a0:a1] & bit) != 0, True))
        b = a if twin else b0 + int(np.searchsorted((other[b0:b1] & bit) != 0, True))
        todo += [(a0, a, b0, b, d + 1, err, twin), (a, a1, b, b1, d + 1, err, twin)]
        if err < budget:
            todo.append((a0, a, b, b1, d + 1, err + 1, False))
            if not twin:
                todo.append((a, a1, b0, b, d + 1, err + 1, False))
    return np.concatenate(out_a), np.concatenate(out_b)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not the least of its component, with that least node."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            moved = np.nonzero(label != np.arange(n))[0]
            return moved, label[moved]
        label = least


_GROUP = ["rot", "depth", "a", "b", "i", "j"]


def _join_in_tasks(budget: int):
    """Streams groups of equal node pairs and joins each; rows also have ``node`` and ``value``."""

    def links(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        value, depth = rows["value"].view(np.uint64), int(rows["depth"][0])
        order = np.argsort(value, kind="stable")
        value = value[order]
        a, b = np.uint64(rows["a"][0]), np.uint64(rows["b"][0])
        if a == b or depth == 64:
            i, j = trie_pairs(value, None, 0 if depth == 64 else depth, 0, budget)
        else:
            left = value >> np.uint64(64 - depth) == a
            ia, ib = np.nonzero(left)[0], np.nonzero(~left)[0]
            i, j = trie_pairs(value[ia], value[ib], depth, int(np.bitwise_count(a ^ b)), budget)
            i, j = ia[i], ib[j]
        u, v = _forest(len(value), i, j)
        node = rows["node"][order]
        return node[u], node[v]

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in [*_GROUP, "node", "value"]}

    return _in_groups(columns, links, _GROUP)


def _in_groups(columns, links, group: list[str]):
    """Streams sorted rows as arrays by ``columns`` and gives each whole group of two and more to ``links``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in _then_none(batches):
            if batch is not None and batch.num_rows:
                more = columns(batch)
                held = {k: np.concatenate([held[k], v]) for k, v in more.items()} if held else more
            if not held:
                continue
            new = _changes(held, group)
            other = new | _changes(held, ["node"])  # a node that is there twice in a row counts once
            other[:1] = True
            held = {k: v[other] for k, v in held.items()}
            new, n = new[other], len(held["node"])
            cuts = [0, *np.nonzero(new)[0].tolist(), n]
            whole = cuts if batch is None else cuts[:-1]  # the last group may go on in the next batch
            found = [links({k: v[x:y] for k, v in held.items()}) for x, y in zip(whole, whole[1:], strict=False) if y - x > 1]
            held = {k: v[whole[-1] :] for k, v in held.items()}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    return run


def _changes(rows: dict[str, np.ndarray], columns: list[str]) -> np.ndarray:
    """Whether a row differs from the one before in any of the columns."""
    new = np.zeros(len(rows["node"]), bool)
    for k in columns:
        new[1:] |= rows[k][1:] != rows[k][:-1]
    return new


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(nodes: DataFrame, values: list[str], budget: int = MAX_BITS, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """A spanning set ``(u, v)`` of the links between the rows of ``nodes``.

    ``nodes`` has a long ``node`` and the fingerprints ``values``. Two nodes link
    if one of their fingerprints differs in at most ``budget`` (0 to 2) bits.
    """
    if not 0 <= budget <= 2:
        raise ValueError("three segments find links of at most two bits")
    spark = nodes.sparkSession

    def turned(name: str, r: int):
        k = SEGMENT * r
        return F.col(name) if not r else F.shiftleft(name, k).bitwiseOR(F.shiftrightunsigned(name, 64 - k))

    every = [F.struct(F.lit(3 * t + r).alias("rot"), turned(name, r).alias("value")) for t, name in enumerate(values) for r in range(3)]
    rows = nodes.select("node", F.explode(F.array(*every)).alias("x")).select("node", "x.*")
    rows = rows.withColumn("a", F.shiftrightunsigned("value", 64 - SEGMENT)).withColumn("b", F.col("a"))
    ready, depth = None, SEGMENT
    while True:
        # A pair of nodes of the trie is of use if both sides hold a fingerprint.
        in_a = F.shiftrightunsigned("value", 64 - depth) == F.col("a")
        pairs = rows.groupBy("rot", "a", "b").agg(F.count("*").alias("n"), F.count_if(in_a).alias("n_a"))
        pairs = pairs.where("n > 1 and (a = b or n_a > 0 and n_a < n)")
        rows = materialise(rows.join(pairs.select("rot", "a", "b", "n"), ["rot", "a", "b"]), f"trie-{depth}")
        now = rows.where(F.col("n") <= pair_rows).withColumns({"depth": F.lit(depth), "i": F.lit(0), "j": F.lit(0)})
        ready = now.drop("n") if ready is None else ready.unionByName(now.drop("n"))
        rows = rows.where(F.col("n") > pair_rows)
        if rows.isEmpty():
            break
        if depth == 64:
            # Many nodes with one fingerprint: pairs of blocks, which together hold every pair of nodes.
            blocks = F.ceil(2 * F.col("n") / pair_rows).cast("int")
            own = F.pmod(F.xxhash64("node"), blocks).cast("int")
            rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            rows = rows.withColumns({"depth": F.lit(depth), "i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")})
            ready = ready.unionByName(rows.drop("n", "_own", "_other"))
            break
        rows = rows.drop("n")
        step = min(STEP, 64 - depth)
        masks = sorted((m for m in range(1 << step) if m.bit_count() <= budget), key=int.bit_count)
        own = F.shiftrightunsigned("value", 64 - depth)
        child = F.shiftrightunsigned("value", 64 - depth - step)
        facing = F.shiftleft(own.bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b")), step).bitwiseOR(child.bitwiseAND(F.lit((1 << step) - 1)))
        rows = rows.withColumn("_mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
        rows = rows.withColumns({"_own": child, "_partner": facing.bitwiseXOR(F.col("_mask"))})
        rows = rows.where(F.bit_count(F.col("_own").bitwiseXOR(F.col("_partner"))) <= budget)
        rows = rows.select("node", "rot", "value", F.least("_own", "_partner").alias("a"), F.greatest("_own", "_partner").alias("b"))
        depth += step
    dealt = ready.repartition(shuffle_partitions(spark), *_GROUP).sortWithinPartitions(*_GROUP)
    return dealt.select(*_GROUP, "node", "value").mapInArrow(_join_in_tasks(budget), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of an edge; root is its component's least node.

    Alternates star steps: larger neighbours, then smaller ones, are hung below
    the least neighbour, until nothing changes. Only minima are aggregated.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = materialise(ordered(edges), "star")
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ordered(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v"))
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = materialise(
            ordered(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v"))), "star"
        )
        if (after := mark(edges)) == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, budget: int = MAX_BITS
) -> DataFrame:
    """``(id, text_key, fp, root, component_id)`` for each row.

    ``component_id`` is the least id reachable over links, ``root`` the component's least fingerprint.
    """
    prints = materialise(with_fingerprint(docs, id_col, text_col, shingle), "fingerprints")
    # Copies share a fingerprint, so they are one node with the least id of them.
    nodes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")), "nodes")
    roots = components(links(nodes.select(F.col("fp").alias("node"), "fp"), ["fp"], budget))
    classed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    classed = materialise(classed, "classes")
    first = materialise(classed.groupBy("root").agg(F.min("least_id").alias("component_id")), "roots")
    return prints.join(
        classed.join(first, "root").select("fp", "root", "component_id"), "fp"
    ).select(id_col, "text_key", "fp", "root", "component_id")


_PAIR = ["group", "i", "j"]


def alike_pairs(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of a similarity of ``ALIKE`` and more that span all such pairs."""
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    members, every = np.unique(np.concatenate(sets), return_inverse=True)
    label, out = np.arange(len(sets)), []
    mark = np.zeros(len(members), bool)
    for i in range(len(sets) - 1):
        if (label == label[0]).all():
            break
        own = every[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        both = np.add.reduceat(mark[every[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1], dtype=np.int64)
        mark[own] = False
        near = (ALIKE[0] + ALIKE[1]) * both >= ALIKE[0] * (sizes[i] + sizes[i + 1 :])
        for j in (np.nonzero(near)[0] + i + 1).tolist():
            if label[i] != label[j]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _confirmed(sets: DataFrame, pair_rows: int) -> DataFrame:
    """A spanning set ``(u, v)`` of the links within each ``group`` of ``sets(node, group, n, shingles)``; n is the group's size."""

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in [*_PAIR, "node"]}
        out["shingles"] = np.empty(batch.num_rows, object)
        out["shingles"][:] = batch.column("shingles").to_pylist()
        return out

    def links(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        i, j = alike_pairs([np.frombuffer(x, np.uint64) for x in rows["shingles"]])
        return rows["node"][i], rows["node"][j]

    # A large group is dealt into blocks; pairs of blocks together hold every pair of nodes.
    blocks = F.when(F.col("n") <= pair_rows, 1).otherwise(F.ceil(2 * F.col("n") / pair_rows)).cast("int")
    rows = sets.withColumn(
        "own", F.pmod(F.xxhash64("node"), blocks).cast("int")
    ).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles")
    order = [*_PAIR, "node"]
    dealt = rows.repartition(shuffle_partitions(sets.sparkSession), *_PAIR).sortWithinPartitions(*order)
    return dealt.mapInArrow(_in_groups(columns, links, _PAIR), "u long, v long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pair_rows: int = PAIR_ROWS) -> DataFrame:
    """``(id, text_key, root, component_id)`` for each row: near duplicates at a similarity of 0.8 in five-word shingles."""
    kind = docs.schema[id_col].dataType.simpleString()

    def node_of(shingles: np.ndarray) -> int:
        return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t) for t in texts_of(part)]
                keys = pa.array([band_keys(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text_key"), pa.array([node_of(x) for x in sets], pa.int64()), keys],
                    [id_col, "text_key", "node", "keys"]
                )
        _words.clear()

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t) for t in texts_of(part)]
                # The row was found by a hash of its id and text; the node tells whether it is the right one.
                right = pa.array([node_of(x) == node for x, node in zip(sets, part.column("node").to_pylist(), strict=True)], pa.bool_())
                columns = [*(part.column(k) for k in ("node", "group", "n")), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "group", "n", "shingles"]).filter(right)
        _words.clear()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(text_col).alias("text_key"))
    rows = materialise(rows.mapInArrow(run, f"`{id_col}` {kind}, text_key long, node long, keys array<long>"), "signatures")
    row_key = lambda name: F.xxhash64(F.col(name), F.col("text_key"))
    # Texts with one set of shingles are one node, for which one row's text is read again.
    nodes = rows.groupBy("node").agg(
        F.min(id_col).alias("least_id"), F.min(row_key(id_col)).alias("row_key"), F.first("keys").alias("keys")
    )
    nodes = materialise(nodes, "nodes")
    keys = nodes.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Candidates are the nodes that keys connect; each one's set is read once and compared with all of its group.
    groups = components(
        keys.join(shared, "key").select(F.col("node").alias("u"), F.col("least").alias("v"))
    ).withColumnRenamed("root", "group")
    groups = materialise(groups, "candidates")
    wanted = groups.join(groups.groupBy("group").agg(F.count("*").alias("n")), "group").join(nodes.select("node", "row_key"), "node")
    wanted = materialise(wanted, "wanted")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(text_col).alias("text_key"))
    # A filter of the rows that are wanted leaves few other texts to be shuffled.
    blocks = blocks_for(wanted.count())
    texts = possible(
        texts.select("text", row_key("id").alias("hash")), bloom_filter(wanted.select(F.col("row_key").alias("hash")), blocks), blocks
    ).where("possible")
    texts = texts.join(wanted, texts["hash"] == wanted["row_key"]).select("node", "group", "n", "text")
    sets = texts.mapInArrow(as_sets, "node long, group long, n long, shingles binary")
    roots = components(_confirmed(sets, pair_rows))
    classed = materialise(nodes.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root")), "classes")
    first = materialise(classed.groupBy("root").agg(F.min("least_id").alias("component_id")), "roots")
    return rows.select(id_col, "text_key", "node").join(
        classed.join(first, "root").select("node", "root", "component_id"), "node"
    ).select(id_col, "text_key", "root", "component_id")


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_key, root, component_id)`` for each row: components over the links of fingerprints and of similar sets together.

    Classes of one method that share a row are linked; the rows of each are linked already.
    """
    prints = materialise(near_duplicates(docs, id_col, text_col).select(id_col, "text_key", F.xxhash64(F.lit("fp"), "root").alias("u")), "prints")
    sets = materialise(
        similar_documents(docs, id_col, text_col).select(
            F.col(id_col).alias("_id"), F.col("text_key").alias("_key"), F.xxhash64(F.lit("set"), "root").alias("v")
        ).distinct(), "sets"
    )
    rows = prints.join(sets, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).drop("_id", "_key")
    rows = materialise(rows, "both")
    roots = components(rows.select("u", "v")).withColumnRenamed("node", "u")
    rows = materialise(rows.join(roots, "u").select(id_col, "text_key", "root"), "linked")
    return rows.join(rows.groupBy("root").agg(F.min(id_col).alias("component_id")), "root").select(id_col, "text_key", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each component of ``found``, by default of ``similar_documents``; all columns.

    It is a row of the least id; of several texts with that id the one with the
    least hash, and of rows that repeat both the one that is least as JSON.
    """
    found = similar_documents(docs, id_col, text_col) if found is None else found
    found = materialise(
        found.select(F.col(id_col).alias("id"), "text_key", "root", F.col(id_col).eqNullSafe(F.col("component_id")).alias("least")), "found"
    )
    keep = found.where("least").groupBy("root", F.col("id").alias("keep_id")).agg(
        F.min("text_key").alias("keep_key"), F.count("*").alias("n")
    ).drop("root")
    keep = materialise(keep, "keep")
    # Rows whose id goes nowhere, and is there once, stay as they are and are not shuffled.
    unsure = found.where("not least").select(F.xxhash64("id").alias("hash")).union(keep.where("n > 1").select(F.xxhash64("keep_id")))
    blocks = blocks_for(unsure.count())
    # Own columns are kept as one struct, so that no name of theirs can clash.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.xxhash64(F.col(f"`{id_col}`")).alias("hash"))
    own = possible(own, bloom_filter(unsure, blocks), blocks, "unsure")
    kept = own.where("unsure").join(
        keep, F.col(f"own.`{id_col}`").eqNullSafe(F.col("keep_id")) & (text_key(F.col(f"own.`{text_col}`")) == F.col("keep_key"))
    )
    # Only rows that are repeated go through a grouping, of which the one that is least as JSON is kept.
    more = kept.where("n > 1").groupBy("keep_id", "keep_key").agg(F.min_by("own", F.to_json("own")).alias("own"))
    out = own.where("not unsure").select("own.*").unionByName(kept.where("n = 1").select("own.*"))
    return out.unionByName(more.select("own.*"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
