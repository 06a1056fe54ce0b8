"""Token-id files in Simple-8b, a word-aligned code.

Every 64-bit word holds a selector in its top four bits and 60 bits of payload;
the selector tells how many ids of which width are packed there, the first in
the lowest bits. Selector 0 is an escape: its payload counts the words after it
that hold one id each in full. Packing takes, at every place, the selector that
fits most ids.

A file holds whole documents in ascending order of their ids and is cut into
blocks of ``BLOCK`` token ids. Words never cross a block, and the file lists the
word at which each block starts, so blocks can be coded and read side by side
in array operations, or one alone. Layout, little-endian::

    magic "S8B1", u32 block size, u64 ids, u64 documents, u64 blocks, u64 words
    u64[documents] ids of each document, u64[blocks] first words, u64[words] words

Files are rows of a Parquet table (``part``, ``seq``, the documents' ids, the
file's bytes), which Spark writes to and reads from any store. Documents are
range-partitioned by id, so ``part`` and ``seq`` order the files.

Defined cases: null and empty texts are the end id alone; repeated rows are
written one after another, equal ids in the order of their texts' hashes; an empty table
gives no files; other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import range_count, scratch_path, table, text_key
from .tokens import byte_slices, encoder

VOCABULARY = "word_bpe_49k.json"
BLOCK = 1024
#: Ids after which a file is closed at the next end of a document.
FILE_IDS = 1 << 20
MAGIC = b"S8B1"
#: Ids in a word and their width, by selector from 1.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_HEAD = struct.Struct("<4sIQQQQ")
_PAYLOAD = 60


def _float_widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; where rounding to a float makes it one too many, the code is just less tight."""
    return np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)


_SHORT_WIDTHS = _float_widths(np.arange(1 << 16))


def _widths(ids: np.ndarray) -> np.ndarray:
    return _SHORT_WIDTHS[ids] if not len(ids) or ids.max() < len(_SHORT_WIDTHS) else _float_widths(ids)


def _best(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place the selector that packs most ids before its block's end; 0 for an escape."""
    n = len(ids)
    width = _widths(ids)
    room = np.minimum(ends - np.arange(n), 255).astype(np.uint8)
    best = np.zeros(n, np.uint8)
    most, size = width, 1
    for selector in range(len(PACKINGS), 0, -1):
        count, bits = PACKINGS[selector - 1]
        while size < count:  # most[i]: the greatest width among ids i .. i + size - 1
            add = min(size, count - size)
            most = np.concatenate(
                [np.maximum(most[:-add], most[add:]), np.full(min(add, n), 255, np.uint8)]
            )[:n] if n > add else np.full(n, 255, np.uint8)
            size += add
        fits = most <= bits
        fits &= room >= count
        np.putmask(best, fits, selector)
    return best


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The words of a sequence of unsigned ids, and the first word of each block."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    starts = np.arange(0, n, block)
    ends = np.minimum(starts + block, n)
    best = _best(ids, np.repeat(ends, ends - starts))
    counts = np.array([1, *[c for c, _ in PACKINGS]])
    takes = counts[best]
    # All blocks advance together, a word at a time.
    at, live, places = starts.copy(), np.arange(len(starts)), []
    while len(live):
        places.append(at[live])
        at[live] += takes[at[live]]
        live = live[at[live] < ends[live]]
    begins = np.zeros(n, bool)
    for p in places:
        begins[p] = True
    place = np.nonzero(begins)[0]
    selector = best[place]
    escaped = selector == 0
    # An escape has a second word with the whole id.
    spot = np.arange(len(place)) + np.concatenate([[0], np.cumsum(escaped)[:-1]]) if len(place) else place
    words = np.zeros(len(place) + int(escaped.sum()), np.uint64)
    packed = np.where(escaped, np.uint64(1), selector.astype(np.uint64) << np.uint64(_PAYLOAD))
    left, lane, need = np.nonzero(~escaped)[0], 0, counts[selector]
    bits = np.array([0, *[b for _, b in PACKINGS]], np.uint64)[selector]
    while len(left):
        packed[left] |= ids[place[left] + lane] << (bits[left] * np.uint64(lane))
        lane += 1
        left = left[need[left] > lane]
    words[spot] = packed
    words[spot[escaped] + 1] = ids[place[escaped]]
    return words, spot[np.searchsorted(place, starts)].astype(np.uint64)


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of a run of words that starts and ends with blocks."""
    words = np.ascontiguousarray(words, np.uint64)
    selector = (words >> np.uint64(_PAYLOAD)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == 0).any():
        # Words in full follow an escape, and may look like any other word.
        at = 0
        zeros = np.nonzero(selector == 0)[0]
        for z in zeros.tolist():
            if z >= at:
                at = z + 1 + int(words[z])
                raw[z + 1 : at] = True
        selector[raw] = 0
    counts = np.array([0, *[c for c, _ in PACKINGS]])[selector]
    counts[raw] = 1
    bits = np.array([0, *[b for _, b in PACKINGS]], np.uint64)[selector]
    ends = np.cumsum(counts)
    lane = (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)).astype(np.uint64)
    wide = np.repeat(bits, counts)
    ids = (np.repeat(words, counts) >> (lane * wide)) & ((np.uint64(1) << wide) - np.uint64(1))
    if raw.any():
        ids[ends[raw] - 1] = words[raw]
    return ids


def pack_file(documents: list[np.ndarray], block: int = BLOCK) -> bytes:
    ids = np.concatenate(documents).astype(np.uint64) if documents else np.empty(0, np.uint64)
    words, firsts = encode(ids, block)
    sizes = np.array([len(d) for d in documents], "<u8")
    head = _HEAD.pack(MAGIC, block, len(ids), len(documents), len(firsts), len(words))
    return head + sizes.tobytes() + firsts.astype("<u8").tobytes() + words.astype("<u8").tobytes()


class TokenFile:
    """Reads a file's documents, or any range of its ids through the block offsets."""

    def __init__(self, data: bytes):
        magic, self.block, self.n_ids, documents, blocks, words = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        body = np.frombuffer(data, "<u8", offset=_HEAD.size)
        self.sizes, self._firsts, self._words = np.split(body, [documents, documents + blocks])
        if len(self._words) != words:
            raise ValueError("a token file is cut short")

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n_ids if end is None else min(end, self.n_ids)
        if start >= end:
            return np.empty(0, np.uint64)
        first, last = start // self.block, -(-end // self.block)
        stop = int(self._firsts[last]) if last < len(self._firsts) else len(self._words)
        skip = start - first * self.block
        return decode(self._words[int(self._firsts[first]) : stop])[skip : skip + end - start]


def write_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, file_ids: int = FILE_IDS
) -> None:
    """Tokenises ``docs`` and writes the table of files to ``path``."""
    spark = docs.sparkSession
    order = [id_col, "_text_key"]  # a range's sample is sent to the driver, so the text itself is no key
    ranges = range_count(spark, docs.agg(F.sum(F.octet_length(text_col))).first()[0])
    rows = docs.select(
        id_col, text_col, text_key(text_col).alias("_text_key")
    ).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_words, part_no, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
        names, tokens, held, kind = [], [], 0, None

        def closed() -> pa.RecordBatch:
            columns = [
                pa.array([part_no], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()),
                pa.array([names], pa.list_(kind)), pa.array([pack_file(tokens)], pa.binary())
            ]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "n_ids", "ids", "data"])

        for batch in batches:
            kind = batch.column(id_col).type
            for piece in byte_slices(batch, text_col):
                every, at = encode_words.encode_column(piece.column(text_col))
                for k, name in enumerate(piece.column(id_col).to_pylist()):
                    names.append(name)
                    tokens.append(every[at[k] : at[k + 1]])
                    held += len(tokens[-1])
                    if held >= file_ids:
                        yield closed()
                        names, tokens, held, seq = [], [], 0, seq + 1
        if tokens:
            yield closed()

    rows.mapInArrow(run, f"part int, seq int, n_ids long, ids array<{id_type.simpleString()}>, data binary").write.parquet(path)


def read_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of each document, decoded from the files."""
    files = spark.read.parquet(path)
    # Ids before each file: within its part by a window, and before the part from
    # one sum for each of the parts, of which there are as many as write tasks.
    totals = sorted(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    befores, seen = [], 0
    for part, n in totals:
        befores.append((part, seen))
        seen += n
    before = spark.createDataFrame(befores or [(0, 0)], "part int, before long")
    within = Window.partitionBy("part").orderBy("seq")
    places = files.select("part", "seq", "n_ids").withColumn("local", F.sum("n_ids").over(within) - F.col("n_ids"))
    places = places.join(F.broadcast(before), "part").select("part", "seq", (F.col("before") + F.col("local")).alias("base"))
    id_type = files.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                file = TokenFile(one.column("data")[0].as_py())
                raw = memoryview(file.ids().astype("<u4")).cast("B")
                ends = np.cumsum(file.sizes.astype(np.int64))
                starts = ends - file.sizes.astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        one.column("part").take(pa.array([0] * len(crc))), one.column("seq").take(pa.array([0] * len(crc))),
                        one.column("ids").flatten(), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())
                    ],
                    ["part", "seq", id_col, "local", "n_tokens", "ids_crc32"],
                )

    # Few bytes a document are left when the place of its file is joined.
    rows = files.select("part", "seq", "ids", "data").mapInArrow(
        run, f"part int, seq int, `{id_col}` {id_type}, local long, n_tokens long, ids_crc32 long"
    )
    return rows.join(places, ["part", "seq"]).select(id_col, (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_files(table(spark, sf_dir, "documents"), path)
    return read_files(spark, path)
