"""Quality rules: in-text repetition, and lines that many documents of a host share.

A line's norm is its text with A-Z in lower case, digits as one mark and white
space as single spaces. Its hash is counted over the distinct documents of each
host (the ``source``), where rows with equal texts are one document. Lines of
more documents than the limit are removed, and documents that keep too small a
share of their words are rejected.

Defined cases: null and empty texts have no words and fail the base rules;
repeated rows are judged one by one with equal results; a null host is a host;
empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialise, slices, table, text_key, texts_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Distinct documents of a host that may share a line.
MAX_HOST_DOCS = 30
#: Least share of a document's words, in per cent, outside removed lines.
MIN_LEFT_PERCENT = 30

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_DIGITS = re.compile(rb"[0-9]+")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    row = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    if len(ids) < 1 << 21:
        key = (row[:-2] << 42) | (row[1:-1] << 21) | row[2:]
    else:  # ranks of pairs leave room for the third word
        pair = np.unique(row[:-1] * len(ids) + row[1:], return_inverse=True)[1]
        key = pair[:-1] * len(ids) + row[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def line_hash(line: bytes) -> int:
    """The first 64 bits of the MD5 of a line's norm, in the order of the digests."""
    norm = b" ".join(_DIGITS.sub(b"0", line.lower()).split())
    return int.from_bytes(hashlib.md5(norm).digest()[:8], "big") - (1 << 63)


def measure(text: str) -> dict:
    """The base figures of a text, and its distinct lines as (hash, words)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    by_hash: dict[int, int] = {}
    for x in lines:
        h = line_hash(x)
        by_hash[h] = by_hash.get(h, 0) + len(x.split())
    return {
        "n_words": len(words),
        "word_chars": len(text) - (len(raw) - len(raw.translate(None, _SPACE))),
        "n_symbols": len(raw) - len(raw.translate(None, _SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "lines": [{"hash": h, "words": k} for h, k in by_hash.items()],
    }


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(docs: DataFrame) -> DataFrame:
    lines_type = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = [measure(t) for t in texts_of(part)]
                base = [pa.array([x[k] for x in got], pa.int64()) for k in _BASE]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("host"), part.column("text_key"), *base,
                        pa.array([x["lines"] for x in got], lines_type)
                    ],
                    ["id", "host", "text_key", *_BASE, "lines"]
                )

    kind = docs.schema["id"].dataType.simpleString()
    figures = ", ".join(f"{k} long" for k in _BASE)
    return docs.mapInArrow(run, f"id {kind}, host string, text_key long, {figures}, lines array<struct<hash:long,words:long>>")


def _frequent(lines: DataFrame, max_host_docs: int) -> DataFrame:
    """``(host, hash)`` of the lines above the limit.

    The first grouping deals rows by line and document, so that a line of a third
    of all documents is spread over all tasks; each task then sends one count of it.
    """
    pairs = lines.groupBy("host", "hash", "text_key").agg(F.lit(1).alias("one"))
    counts = pairs.groupBy("host", "hash").agg(F.count("*").alias("n_docs"))
    return counts.where(F.col("n_docs") > max_host_docs).select(F.col("host").alias("_host"), F.col("hash").alias("_hash"))


def _judged(
    docs: DataFrame, id_col: str, text_col: str, host_col: str, max_host_docs: int, min_left_percent: int
) -> tuple[DataFrame, DataFrame]:
    """Figures and verdicts by (id, text_key), and the occurrences of frequent lines."""
    docs = docs.select(
        F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"),
        text_key(text_col).alias("text_key")
    )
    rows = materialise(_measured(docs), "measured")
    lines = rows.select("id", "host", "text_key", F.explode("lines").alias("line")).select("id", "host", "text_key", "line.*")
    frequent = _frequent(lines, max_host_docs)
    gone = lines.join(frequent, lines["host"].eqNullSafe(frequent["_host"]) & (lines["hash"] == frequent["_hash"]), "left_semi")
    gone = materialise(gone.select("id", "text_key", "hash", "words").distinct(), "frequent")
    lost = gone.groupBy("id", "text_key").agg(F.sum("words").alias("n_removed_words")).select(
        F.col("id").alias("_id"), F.col("text_key").alias("_key"), "n_removed_words"
    )
    rows = rows.drop("lines").join(lost, rows["id"].eqNullSafe(lost["_id"]) & (rows["text_key"] == lost["_key"]), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    removed = F.coalesce("n_removed_words", F.lit(0))
    left = 100 * (F.col("n_words") - removed) >= min_left_percent * F.col("n_words")
    rows = rows.select(
        "id", "host", "text_key", *_BASE, removed.alias("n_removed_words"), failed.alias("base_failed"), (~failed & left).alias("kept")
    )
    return rows, gone


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_docs: int = MAX_HOST_DOCS,
    min_left_percent: int = MIN_LEFT_PERCENT
) -> DataFrame:
    """Figures, ``base_failed`` and ``kept`` for each document row."""
    rows, _ = _judged(docs, id_col, text_col, host_col, max_host_docs, min_left_percent)
    return rows.select(F.col("id").alias(id_col), *_BASE, "base_failed", "kept", "n_removed_words")


def clean_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_docs: int = MAX_HOST_DOCS,
    min_left_percent: int = MIN_LEFT_PERCENT
) -> DataFrame:
    """The kept documents without the lines above the limits, all columns.

    ``n_chars``, if there, is set to the new length where a text has changed.
    """
    rows, gone = _judged(docs, id_col, text_col, host_col, max_host_docs, min_left_percent)
    cut = gone.groupBy("id", "text_key").agg(F.collect_set("hash").alias("_cut"))  # a document's own lines at most
    kept = rows.where("kept").select("id", "text_key").distinct()
    kept = kept.join(
        cut.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), "_cut"),
        F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left"
    )
    # Own columns are kept as one struct, so that no name of theirs can clash.
    kept = kept.select(F.col("id").alias("kept_id"), F.col("text_key").alias("kept_key"), F.col("_cut").alias("cut"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    was = F.col(f"own.`{text_col}`")
    out = own.join(kept, F.col(f"own.`{id_col}`").eqNullSafe(F.col("kept_id")) & (text_key(was) == F.col("kept_key")))
    out = out.withColumn("clean", F.when(F.col("cut").isNull(), was).otherwise(F.pandas_udf(_without_lines, "string")(was, F.col("cut"))))
    columns = {c: F.col(f"own.`{c}`") for c in docs.columns}
    columns[text_col] = F.col("clean")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(
            F.col("cut").isNotNull(), F.char_length("clean").cast(docs.schema["n_chars"].dataType)
        ).otherwise(columns["n_chars"])
    return out.select(*[x.alias(c) for c, x in columns.items()])


def _without_lines(texts: pd.Series, cuts: pd.Series) -> pd.Series:
    def one(text: str | None, cut) -> str | None:
        if text is None or cut is None or not len(cut):
            return text
        cut = set(cut)
        lines = text.split("\n")
        return "\n".join(x for x in lines if not x.strip() or line_hash(x.encode("utf-8", "surrogatepass")) not in cut)

    return pd.Series([one(t, c) for t, c in zip(texts, cuts, strict=True)], dtype=object)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_W = "[^\\x20\\x09-\\x0D]+"
OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text, md5(coalesce(text, '')) AS digest, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
l AS (SELECT rid, host, digest, pos, line, regexp_extract_all(line, '{_W}') AS lw
      FROM (SELECT rid, host, digest, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
lines AS (SELECT rid, host, digest, line, len(lw) AS words,
                 regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS norm
          FROM l WHERE len(lw) > 0),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid),
tri AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c
        FROM (SELECT rid, p, w[p:p + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3))),
own AS (SELECT rid, any_value(host) AS host, any_value(digest) AS digest, norm, sum(words) AS words FROM lines GROUP BY rid, norm),
freq AS (SELECT host, norm FROM own GROUP BY host, norm HAVING count(DISTINCT digest) > {MAX_HOST_DOCS}),
lost AS (SELECT rid, CAST(sum(words) AS BIGINT) AS n FROM own SEMI JOIN freq USING (host, norm) GROUP BY rid),
reps AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest(range(p, p + 3)) AS q FROM tri WHERE c > 1) GROUP BY rid)
SELECT *, NOT base_failed AND 100 * (n_words - n_removed_words) >= {MIN_LEFT_PERCENT} * n_words AS kept FROM (
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
       len(w) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * len(w) AS base_failed,
       coalesce(lost.n, 0) AS n_removed_words
FROM d LEFT JOIN dups USING (rid) LEFT JOIN reps USING (rid) LEFT JOIN lost USING (rid))
"""
