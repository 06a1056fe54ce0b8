"""Packing documents into training sequences along a space-filling curve.

Each document's token ids give a signed hashed count vector, which a fixed
random matrix projects to a few dimensions. The coordinates, cut to a grid,
have a place on a Hilbert curve; documents are range-sorted by it, so that
similar ones are neighbours, and packed in that order: ids are laid end to end
and cut every ``length`` ids. Only the last sequence of a partition is short.

Documents are tokenised once and kept in the shared folder, so that finding the
ranges does not tokenise again. Equal keys are ordered, and split between
ranges, by id and by the row's place in that table.

Defined cases: null and empty texts are the end id alone; repeated rows are
packed one by one; an empty table gives no pieces; other columns are not looked
at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialise, range_count, slices, table
from .tokens import LIGHT_SLICE, byte_slices, encoder

VOCABULARY = "byte_bpe_50k.json"
LENGTH = 2048
BUCKETS = 1024
DIMENSIONS = 4
BITS = 12
#: Most ids in a shuffled row, so that ranges of equally many rows are of similar size.
CHUNK = 4096


@cache
def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint32) * np.uint32(2654435761)
    return x ^ (x >> np.uint32(15))


def grid_point(ids: np.ndarray) -> np.ndarray:
    """The grid coordinates of a document: its hashed counts, projected and cut."""
    mixed = _mixed(ids)
    bucket = (mixed >> np.uint32(1)) % BUCKETS
    sign = np.where(mixed & np.uint32(1), 1.0, -1.0)
    counts = np.bincount(bucket, weights=sign, minlength=BUCKETS)
    norm = np.sqrt((counts * counts).sum()) or 1.0
    at = np.clip((counts / norm) @ _projection() / 6 + 0.5, 0, 1 - 2.0**-BITS)
    return (at * (1 << BITS)).astype(np.int64)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of grid points on a Hilbert curve (Skilling's transposition), as longs."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenised(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, light: bool = False) -> DataFrame:
    """``(id, key, part, row, start, doc_tokens, ids)``: the curve's key, the row's place, and its ids as bytes, ``CHUNK`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row, here = encoder(vocabulary, light), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in byte_slices(batch, text_col, LIGHT_SLICE) if light else byte_slices(batch, text_col):
                every, at = encode.encode_column(part.column(text_col))
                ids = [every[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                keys = hilbert_key(np.array([grid_point(x) for x in ids]))
                cuts = [(k, c) for k, x in enumerate(ids) for c in range(0, len(x), CHUNK)]
                at, starts = (np.array(x, np.int64) for x in zip(*cuts, strict=True))
                chunks = [ids[k][c : c + CHUNK] for k, c in cuts]
                # Two bytes an id where they suffice; the length tells which.
                narrow = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else x.tobytes() for x in chunks]
                sizes = np.array([len(x) for x in ids], np.int64)
                columns = [
                    part.column(id_col).take(pa.array(at)), pa.array(keys[at]), pa.array(np.full(len(at), here, np.int32)),
                    pa.array(row + at), pa.array(starts), pa.array(sizes[at]), pa.array([len(x) for x in chunks], pa.int32()),
                    pa.array(narrow, pa.binary())
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "key", "part", "row", "start", "doc_tokens", "n", "ids"])
                row += len(ids)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"id {kind}, key long, part int, row long, start long, doc_tokens long, n int, ids binary"
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, light: bool = False) -> DataFrame:
    """One row for each piece of a document: where it lies in which sequence.

    ``light`` takes less memory and more time; the rows are the same.

    ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, key)``.
    """
    spark = docs.sparkSession
    rows = materialise(tokenised(docs, id_col, text_col, vocabulary, light), "tokens")
    order = ["key", "id", "part", "row", "start"]
    ranges = range_count(spark, rows.agg(F.sum(F.octet_length("ids"))).first()[0])
    rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                for at, (n, first, raw) in enumerate(
                    zip(part.column("n").to_pylist(), part.column("start").to_pylist(), part.column("ids").to_pylist(), strict=True)
                ):
                    wide = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                    start = 0
                    while start < n:
                        take = min(n - start, length - filled)
                        out.append((at, first + start, take, zlib.crc32(wide[start : start + take].tobytes()), sequence, filled))
                        start, filled = start + take, filled + take
                        if filled == length:
                            sequence, filled = sequence + 1, 0
                at, *rest = (np.array(x, np.int64) for x in zip(*out, strict=True))
                of = lambda name, at=at, part=part: part.column(name).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [of("id"), *map(pa.array, rest[:3]), of("doc_tokens"), *map(pa.array, rest[3:]), of("key")], [id_col, *_PIECE, "key"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select("id", "key", "start", "doc_tokens", "n", "ids").mapInArrow(
        run, f"`{id_col}` {kind}, " + ", ".join(f"{k} long" for k in _PIECE) + ", key long"
    )


_PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", *_PIECE)
