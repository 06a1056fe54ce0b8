"""Benchmark decontamination with a Wu-Manber search over words.

The alphabet of the search is words. Windows of benchmark words are the test
strings. For every length there is a table of shifts by block (the last two
words of the text window, one for single words): an unknown block lets the
window move on by its whole length less one. Where the shift is zero, a bucket
keyed by the block names the strings that end in it, and comparing them with the
text confirms an occurrence.

Benchmarks are searched for in blocks of bounded size, each broadcast alone, so
they may be larger than memory: one block needs one pass over the documents.

Defined cases: null and empty texts have no words and no hits; repeated
documents are judged one by one; items that repeat an id count once; items
without words are left out; empty tables give no hits; other columns are not
looked at. The time is in proportion to a text's length, however long it is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialise, slices, table, text_key, texts_of

WINDOW = 10
#: Bytes of benchmark text in one broadcast block; a worker's tables take some fifty times as much.
BLOCK_BYTES = 2 << 20
#: What is no word becomes a space; A-Z becomes a-z.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class _OneLength:
    """Wu-Manber tables for test strings of ``m`` words."""

    def __init__(self, m: int, strings: list[tuple[bytes, ...]]):
        self.m, self.block = m, min(2, m)
        self.most = m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for s in strings:
            for j in range(self.block, m + 1):
                key = s[j - self.block : j] if self.block == 2 else s[j - 1]
                self.shift[key] = min(self.shift.get(key, self.most), m - j)
            self.bucket.setdefault(key, []).append(s)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """Where each occurring string starts."""
        m, most, n = self.m, self.most, len(words)
        if n < m:
            return
        get, j, single = self.shift.get, m - 1, self.block == 1
        while j < n:
            key = words[j] if single else (words[j - 1], words[j])
            by = get(key, most)
            if by:
                j += by
                continue
            at = j - m + 1
            for s in self.bucket[key]:
                if s[0] == words[at] and list(s) == words[at : j + 1]:
                    yield at, s
            j += 1


class Searcher:
    """Finds the windows of benchmark items in lists of words."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        # A word is held once, however many windows have it, and so are the items of a window.
        once: dict = {}
        owners: dict[tuple[bytes, ...], tuple] = {}
        for item, text in items:
            words = [once.setdefault(w, w) for w in words_of(text or "")]
            mine = once.setdefault((None, item), (item,))
            for k in range(max(1, len(words) - window + 1) if words else 0):
                s = tuple(words[k : k + window])
                others = owners.get(s, ())
                if not others:
                    owners[s] = mine
                elif item not in others:
                    more = (*others, item)
                    owners[s] = once.setdefault((None, *more), more)
        self.items = owners
        by_length: dict[int, list] = defaultdict(list)
        for s in owners:
            by_length[len(s)].append(s)
        self.tables = [_OneLength(m, strings) for m, strings in sorted(by_length.items())]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The hit runs of words, as (start, end), and the items with occurring windows."""
        runs, found = [], set()
        for t in self.tables:
            for at, s in t.find(words):
                runs.append((at, at + t.m))
                found.update(self.items[s])
        return merge(runs), found


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The benchmark in lists of at most ``block_bytes`` of text (or one longer item).

    Rows are dealt by a hash of item and text into as many blocks as the bytes
    ask for; only one of them at a time is with the driver.
    """
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


def _run_type(id_type: str, item_type: str) -> str:
    return f"id {id_type}, text_key long, n_words long, runs array<struct<a:int,b:int>>, items array<{item_type}>"


def _pass(docs: DataFrame, searcher, item_type: str) -> DataFrame:
    """One search over all documents; docs has ``id``, ``text``, ``text_key``."""
    arrow_item = pa.int64() if item_type == "bigint" else pa.string()
    runs_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = searcher.value
        for batch in batches:
            for part in slices(batch):
                n, runs, items = [], [], []
                for text in texts_of(part):
                    words = words_of(text)
                    hit, which = found.search(words)
                    n.append(len(words))
                    runs.append([{"a": a, "b": b} for a, b in hit])
                    items.append(sorted(which, key=str))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("text_key"), pa.array(n, pa.int64()), pa.array(runs, runs_type),
                        pa.array(items, pa.list_(arrow_item))
                    ],
                    ["id", "text_key", "n_words", "runs", "items"]
                )

    return docs.mapInArrow(run, _run_type(docs.schema["id"].dataType.simpleString(), item_type))


def _total(runs: Column) -> Column:
    """Words in the union of runs."""
    step = F.aggregate(
        F.array_sort(runs),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, r: F.struct(
            (s["n"] + F.greatest(r["b"] - F.greatest(r["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], r["b"]).alias("end")
        ),
    )
    return step["n"]


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``(id, text_key, n_words, n_hit, items)`` for each document row."""
    spark = docs.sparkSession
    item_type = "bigint" if benchmark.schema[item_col].dataType.simpleString() in ("int", "bigint") else "string"
    if item_type == "string":
        benchmark = benchmark.withColumn(item_col, F.col(item_col).cast("string"))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(text_col).alias("text_key"))
    passes: list[DataFrame] = []
    blocks = item_blocks(benchmark, item_col, "text", block_bytes)
    rows = next(blocks)
    while rows is not None:
        more = next(blocks, None)
        tables = spark.sparkContext.broadcast(Searcher(rows, window))
        one = _pass(docs, tables, item_type)
        if passes or more is not None:  # of several blocks one is searched for after the other, so that workers hold one
            one = materialise(one.withColumn("k", F.lit(len(passes))), "block-hits")
            tables.unpersist()
        passes.append(one)
        rows = more
    found = passes[0]
    if len(passes) > 1:
        # Copies of a row have the same results, which a set holds once for each block.
        for one in passes[1:]:
            found = found.unionByName(one)
        found = found.groupBy("id", "text_key").agg(
            F.max("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_set("runs"))).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
            F.count_if(F.col("k") == 0).alias("copies"),
        )
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select(F.col("id").alias(id_col), "text_key", "n_words", _total(F.col("runs")).alias("n_hit"), "items")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; a filter, so nothing is shuffled.

    Of several blocks each filters what the one before kept, which is written in
    between, so that a worker holds the tables of one block.
    """
    for k, rows in enumerate(item_blocks(benchmark, item_col, "text", block_bytes)):
        clean = _is_clean(docs.sparkSession.sparkContext.broadcast(Searcher(rows, window)))
        docs = (materialise(docs, "uncontaminated") if k else docs).where(clean(text_col))
    return docs


def _is_clean(searcher):
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not searcher.value.search(words_of(t or ""))[0] for t in texts], dtype=bool)

    return F.pandas_udf(clean, "boolean")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT item_id, array_to_string(w[k:k + 9], ' ') AS s, least(10, len(w)) AS m
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
spans AS (
  SELECT rid, k, m, array_to_string(w[k:k + m - 1], ' ') AS s
  FROM (SELECT d.rid, d.w, lens.m, unnest(range(1, len(d.w) - lens.m + 2)) AS k FROM d, lens WHERE len(d.w) >= lens.m)),
hits AS (SELECT rid, k, spans.m AS m, item_id FROM spans JOIN win USING (s) WHERE spans.m = win.m),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + m)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hits GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
