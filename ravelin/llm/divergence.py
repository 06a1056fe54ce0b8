"""How much sources of a language differ: sorted runs of terms give document frequencies, counts and partial sums.

Terms are maximal runs of letters A-Z, a-z and of characters from U+0080 on,
with A-Z lower-cased. A task counts terms and their documents over a slice of
its rows before anything is shuffled. Those partial runs are dealt and sorted by
language, term and source, and a scan joins each run into one row; a term that a
third of all documents have is by then one row a source. Dealt and sorted by
language and term, a run is a term of a language: the scan gives its document
frequency, and whether it is kept.

Pairs of sources are summed in tiles of some ``TILE`` by ``TILE`` sources. A
scan over the sorted runs of a tile fills a small table of terms by sources, adds
up each pair's values and emits them when the tile ends. Terms that no source of
the tile has, all with one value, are counted and not visited.

Defined cases: null texts, languages and sources are empty strings; a row is a
document, so repeated rows count each; texts without terms give a group that
has no terms of its own; a language with one source has no pairs; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import materialise, shuffle_partitions, table
from .runs import starts, whole_runs

MIN_DOCS = 10
TOP = 10
#: Sources on a side of a tile, about; a tile holds a table of so many columns twice.
TILE = 64
#: Distinct terms of sources that a task counts before it emits them, and bytes of a text that it splits at a time.
MOST_COUNTED = 300_000
PIECE_BYTES = 1 << 20
_RUN = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("docs", pa.int64()), ("count", pa.int64())])
_PAIR = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64()), ("seen", pa.int64())])
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The text's terms, some at a time."""
    data, at = text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _partial_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents of each term, language and source in a slice of rows."""
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def emitted() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            n = len(own)
            columns = [
                pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int32))),
                pa.array(own.keys(), pa.binary(), size=n).cast(pa.string()),
                pa.array([source], pa.string()).take(pa.array(np.zeros(n, np.int32))),
                pa.array([docs[lang, source][t] for t in own], pa.int64()),
                pa.array(own.values(), pa.int64(), size=n),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_RUN)
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            key = (lang.as_py(), source.as_py())
            own, seen = counts.setdefault(key, Counter()), set()
            for piece in terms(text.as_py()):
                own.update(piece)
                seen.update(piece)
            docs.setdefault(key, Counter()).update(seen)
            if sum(map(len, counts.values())) > MOST_COUNTED:
                yield from emitted()
    yield from emitted()


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of language, term and source."""
    keys = ("lang", "term", "source")
    for batch in whole_runs(batches, keys):
        at = starts(batch, keys)
        sums = [pa.array(np.add.reduceat(batch.column(c).to_numpy(), at)) for c in ("docs", "count")]
        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns[:3], *sums], schema=_RUN)


def _kept_terms(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of terms with enough documents, each row with the term's count in the language; ``first`` is 1 once a term."""
        for batch in whole_runs(batches, ("lang", "term")):
            at = starts(batch, ("lang", "term"))
            lengths = np.diff(np.append(at, batch.num_rows))
            docs, total = (np.add.reduceat(batch.column(c).to_numpy(), at) for c in ("docs", "count"))
            first = np.zeros(batch.num_rows, np.int64)
            first[at] = 1
            columns = {"lang": batch.column("lang"), "term": batch.column("term"), "source": batch.column("source"), "count": batch.column("count")}
            columns |= {"lang_count": pa.array(np.repeat(total, lengths)), "first": pa.array(first)}
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(np.repeat(docs >= least, lengths)))

    return run


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, term, source, count, lang_count, first)`` of terms that at least ``min_docs`` documents of their language have."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    run = "lang string, term string, source string, docs long, count long"
    partial = rows.mapInArrow(_partial_runs, run)
    runs = partial.repartition(n, "lang", "term", "source").sortWithinPartitions("term", "lang", "source").mapInArrow(_joined_runs, run)
    ordered = runs.repartition(n, "lang", "term").sortWithinPartitions("term", "lang", "source")
    return ordered.mapInArrow(_kept_terms(min_docs), "lang string, term string, source string, count long, lang_count long, first long")


def _p(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(10^9 (count + 2) / (total + 2 kept))`` in decimals, since the product passes 64 bits; 1 where nothing is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    share = F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * wide(count + 2), wide(total + 2 * kept))
    return F.when(kept > 0, share + 1).otherwise(F.lit(1).cast("long"))


def _value(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``: both are at most 10^9 + 1, so squares stay within 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class _Tile:
    """Sums over the terms of one tile for each pair of its sources."""

    def __init__(self, key: tuple):
        self.key = key
        self.sides: tuple[dict[str, int], dict[str, int]] = ({}, {})  # the least p of each source, rows and columns of the tile
        self.at: dict[str, int] = {}
        self.seen = 0

    def announce(self, part: pa.RecordBatch) -> None:
        for source, own, p in zip(*(part.column(c).to_pylist() for c in ("source", "own_tile", "p")), strict=True):
            self.sides[own != self.key[1]][source] = p

    def begin(self) -> None:
        sources = [*self.sides[0], *self.sides[1]]
        self.at = {s: k for k, s in enumerate(sources)}
        self.least = np.array([*self.sides[0].values(), *self.sides[1].values()], np.int64)
        self.cut = len(self.sides[0])
        self.right = slice(0, None) if self.key[1] == self.key[2] else slice(self.cut, None)
        self.sums = np.zeros((self.cut, len(self.least[self.right])), np.int64)

    def add(self, part: pa.RecordBatch) -> None:
        """Rows of whole runs, a run for each term."""
        at = starts(part, ("term",))
        dense = np.tile(self.least, (len(at), 1))
        dense[np.repeat(np.arange(len(at)), np.diff(np.append(at, part.num_rows))), [self.at[s] for s in part.column("source").to_pylist()]] = part.column("p")
        for k in range(self.cut):
            p, q = dense[:, k : k + 1], dense[:, self.right]
            self.sums[k] += ((p - q) ** 2 // (p + q)).sum(axis=0)
        self.seen += len(at)

    def pairs(self) -> Iterator[dict]:
        names = list(self.at)
        for i, a in enumerate(names[: self.cut]):
            for j, b in enumerate(names[self.right]):
                if a < b or self.key[1] != self.key[2]:
                    yield {"lang": self.key[0], "a": a, "b": b, "value": int(self.sums[i, j]), "seen": self.seen}


def _partial_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scans runs sorted by tile and term. A tile's sources stand before its terms, as rows of the empty term."""
    tile, keys = None, ("lang", "tile_row", "tile_col")
    for batch in whole_runs(batches, (*keys, "term")):
        cuts = [*starts(batch, keys).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(start, end - start)
            key = tuple(part.column(c)[0].as_py() for c in keys)
            if tile is None or tile.key != key:
                if tile is not None:
                    yield pa.RecordBatch.from_pylist(list(tile.pairs()), _PAIR)
                tile = _Tile(key)
            is_source = pc.equal(part.column("term"), "")
            if named := pc.sum(is_source).as_py():
                tile.announce(part.slice(0, named))
                tile.begin()
            if part.num_rows > (named or 0):
                tile.add(part.slice(named or 0))
    if tile is not None:
        yield pa.RecordBatch.from_pylist(list(tile.pairs()), _PAIR)


def _pair_values(runs: DataFrame, groups: DataFrame, partitions: int) -> DataFrame:
    """``(lang, a, b, value)`` of each pair ``a``, ``b`` of a language's sources, once."""
    tiles = F.greatest(F.ceil(F.col("n_sources") / TILE), F.lit(1)).cast("int")
    buckets = F.greatest(F.lit(1), F.ceil(F.lit(2 * partitions) / (tiles * (tiles + 1)))).cast("int")
    placed = groups.select("lang", "source", "p0", tiles.alias("tiles"), buckets.alias("buckets"), F.pmod(F.xxhash64("source"), tiles).cast("int").alias("own_tile"))
    rows = runs.join(placed.select("lang", "source", "tiles", "buckets", "own_tile"), ["lang", "source"]).select(
        "lang", "source", "tiles", "own_tile", "term", "p", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket")
    )
    named = placed.select(
        "lang", "source", "tiles", "own_tile", F.lit("").alias("term"), F.col("p0").alias("p"),
        F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket")
    )
    dealt = rows.unionByName(named).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumn("tile_row", F.least("own_tile", "other")).withColumn("tile_col", F.greatest("own_tile", "other"))
    dealt = dealt.repartition(partitions, "lang", "tile_row", "tile_col", "bucket").select("lang", "tile_row", "tile_col", "term", "source", "own_tile", "p")
    partial = dealt.sortWithinPartitions("lang", "tile_row", "tile_col", "term", "source").mapInArrow(
        _partial_pairs, "lang string, a string, b string, value long, seen long"
    )
    sums = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    least = lambda side, p: groups.select("lang", F.col("source").alias(side), F.col("p0").alias(p), F.col("kept").alias(f"{p}_kept"))
    both = sums.join(least("a", "p0_a"), ["lang", "a"]).join(least("b", "p0_b"), ["lang", "b"])
    return both.select("lang", "a", "b", (F.col("value") + (F.col("p0_a_kept") - F.col("seen")) * _value(F.col("p0_a"), F.col("p0_b"))).alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each source against the others, and the ``top`` terms that it has too many of."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    runs = materialise(kept_terms(docs, min_docs), "term_runs")
    langs = runs.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.sum("first").alias("kept"))
    totals = runs.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    found = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = found.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "kept"])
    groups = groups.join(found.groupBy("lang").agg(F.count("*").alias("n_sources")), "lang")
    groups = materialise(groups.withColumn("p0", _p(F.lit(0).cast("long"), F.col("total"), F.col("kept"))), "term_groups")
    known = runs.join(groups.select("lang", "source", "total", "lang_total", "kept"), ["lang", "source"])
    known = known.withColumn("p", _p(F.col("count"), F.col("total"), F.col("kept")))

    pairs = _pair_values(known.select("lang", "source", "term", "p"), groups, n)
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.withColumn("side", sides).select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")

    q = _p(F.col("lang_count"), F.col("lang_total"), F.col("kept"))
    more = known.withColumn("q", q).where(F.col("p") > F.col("q"))
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _value(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(more).where(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (
    SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM docs),
kept AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
members AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, sum(coalesce(n, 0)) AS total FROM members LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
probs AS (
    SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (m.total + 2 * s.v) AS p
    FROM totals m JOIN sizes s USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
whole AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term),
lang_probs AS (
    SELECT w.lang, w.term, 1 + (1000000000::HUGEINT * (w.n + 2)) // (t.total + 2 * s.v) AS q
    FROM whole w JOIN sizes s USING (lang) JOIN (SELECT lang, sum(n) AS total FROM whole GROUP BY lang) t USING (lang)),
diffs AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM probs a JOIN probs b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
    FROM members a JOIN members b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN diffs d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
more AS (
    SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS value
    FROM probs p JOIN lang_probs q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM more))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
