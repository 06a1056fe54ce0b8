"""Secret scans: patterns, and a token-efficiency test for random strings.

Three patterns find assignments of secrets, access keys and long hexadecimal
runs. Besides, runs of key characters are encoded with a byte-level vocabulary
(tiktoken): text that resembles what the vocabulary was made from takes few
tokens, a random string many. A low ratio of characters to tokens marks a run,
unless it has the form of a digest, a UUID or another identifier, or a pattern
has found it already. Where words are joined to a random string, the run's densest
stretches of tokens are tested, wherever they lie and however long the run is, and
then its pieces between separators.

Defined cases: null and empty texts have no spans; repeated rows are scanned one
by one; empty tables give empty results; other columns, whatever their names,
stay as they are. Of very long texts the time grows in proportion to the length.
Spans that start at one place are ordered by kind; a dense span never overlaps
one of a pattern. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import slices, table, texts_of

VOCABULARY = "byte_bpe_50k.tiktoken"
KINDS = ["assign", "access", "hex", "dense"]
MARK = "<secret>"
#: Least characters of a run that is tested, and the ratio below which it is a secret.
MIN_RUN = 20
MAX_RATIO = 2.0
#: Characters that are encoded at a time. A token may be cut there, but stretches go on across.
ENCODE_AT_ONCE = 4096
#: How far a stretch is widened to a separator.
WIDEN = 64
#: A run of which this share of the characters follow the one before them in the code is an alphabet or a count.
SEQUENCE_SHARE = 0.8

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_PIECE = re.compile(rf"[A-Za-z0-9]{{{MIN_RUN},}}")
_LETTERS = re.compile(rf"[A-Za-z]{{{MIN_RUN},}}")
_SEPARATORS = "+/_=-"
_UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
#: Forms of digests (MD5, SHA-1, SHA-2) and of identifiers: UUIDs, joined words with numbers, dates and times, paths of such.
_KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
    r"|(?:(?:[0-9]{2}T[0-9]{2}|[0-9]{8}T[0-9]{4,6}Z?|[0-9]{2}Z|[A-Za-z]*+[0-9]*+)[-_/+=])*+(?:[0-9]{8}T[0-9]{4,6}Z?|[0-9]{2}T[0-9]{2}|[0-9]{2}Z|[A-Za-z]*+[0-9]*+)"
    r"|[0-9=_/+-]+)"
)


@cache
def _encoding(vocabulary: str):
    import tiktoken

    path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("runs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """The spans of the three patterns as (start, kind, end), in that order.

    Runs of one character class are matched whole, so a least length within the
    pattern finds the same runs as a test afterwards. For assignments it would
    not: a match that fails the test still takes its characters.
    """
    found = []
    low = text.lower()
    if any(x in low for x in _ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _uncovered(start: int, end: int, covered: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a stretch outside others that are long enough for a run."""
    for a, b in [*sorted(covered), (end, end)]:
        if min(a, end) - start >= MIN_RUN:
            yield start, min(a, end)
        start = max(start, b)


def _sequence(run: str) -> bool:
    codes = np.frombuffer(run.encode(), np.uint8).astype(np.int16)
    return len(codes) > 1 and float(np.mean(np.diff(codes) == 1)) >= SEQUENCE_SHARE


def _known(run: str) -> bool:
    """Whether a run is a digest, an identifier, or an alphabet."""
    return bool(_KNOWN.fullmatch(run)) or _sequence(run)


def _encode(run: str, encoding) -> list[int]:
    out = []
    for start in range(0, len(run), ENCODE_AT_ONCE):
        out += encoding.encode_ordinary(run[start : start + ENCODE_AT_ONCE])
    return out


def _is_dense(run: str, encoding, max_ratio: float) -> bool:
    if not _DIGIT.search(run) or not _LETTER.search(run) or _known(run):
        return False
    return len(run) < max_ratio * len(_encode(run, encoding))


def _best(ends: np.ndarray, score: np.ndarray, first: int, last: int) -> tuple[int, int] | None:
    """The stretch of at least ``MIN_RUN`` characters between two places with the highest score, if that is positive."""
    e, s = ends[first : last + 1], score[first : last + 1]
    before = np.searchsorted(e, e - MIN_RUN, side="right") - 1  # the last start that is far enough
    can = before >= 0
    if not can.any():
        return None
    low = np.minimum.accumulate(s)
    gain = np.where(can, s - low[np.maximum(before, 0)], -np.inf)
    j = int(np.argmax(gain))
    if gain[j] <= 0:
        return None
    return first + int(np.argmin(s[: before[j] + 1])), first + j


def _stretches(ends: np.ndarray, score: np.ndarray) -> Iterator[tuple[int, int]]:
    """All dense stretches as pairs of places between tokens.

    A place with a new least score parts the run: a stretch that goes on over it is
    better from there, unless that is too short. So blocks between such places are
    searched with so many characters on both sides, and what a block's best stretch
    leaves is searched again. Stretches may overlap.
    """
    todo = [(0, len(ends) - 1)]
    while todo:
        first, last = todo.pop()
        if ends[last] - ends[first] < MIN_RUN:
            continue
        s = score[first : last + 1]
        cuts = np.append(np.append(0, np.flatnonzero(s[1:] < np.minimum.accumulate(s)[:-1]) + 1), len(s))
        for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if q - p < 2:
                continue
            p, q = first + p, first + q - 1
            p = max(first, int(np.searchsorted(ends, ends[p] - MIN_RUN, side="right")) - 1)
            q = min(last, int(np.searchsorted(ends, ends[q] + MIN_RUN)) + 1)
            if (found := _best(ends, score, p, q)) is not None:
                yield found
                todo += [(p, found[0]), (found[1], q)]


def _dense_within(run: str, encoding, max_ratio: float) -> list[tuple[int, int]]:
    """The secrets of a run: the whole, else dense stretches, and of what is left dense pieces between separators."""
    tokens, known = _encode(run, encoding), _known(run)
    if not known and _DIGIT.search(run) and _LETTER.search(run) and len(run) < max_ratio * len(tokens):
        return [(0, len(run))]
    sizes = np.array([len(encoding.decode_single_token_bytes(t)) for t in tokens])
    ends, score = (np.append(0, np.cumsum(x)) for x in (sizes, max_ratio - sizes))
    found: list[tuple[int, int]] = []
    for i, j in () if known else _stretches(ends, score):
        a, b = int(ends[i]), int(ends[j])
        # To the separators around it, if they are near.
        left = max(run.rfind(x, max(0, a - WIDEN), a) for x in _SEPARATORS) + 1
        a = left if left else (0 if a <= WIDEN else a)
        right = min((k for x in _SEPARATORS if (k := run.find(x, b, b + WIDEN)) >= 0), default=-1)
        b = right if right >= 0 else (len(run) if len(run) - b <= WIDEN else b)
        if not _known(run[a:b]):
            found.append((a, b))
    found = _united(found)
    for start, end in list(_uncovered(0, len(run), found)):
        for m in _PIECE.finditer(run, start, end):
            if _is_dense(m[0], encoding, max_ratio):
                found.append((m.start(), m.end()))
            else:
                letters = [x for x in _LETTERS.finditer(m[0]) if len(x[0]) < max_ratio * len(_encode(x[0], encoding)) and not _sequence(x[0])]
                found += [(m.start() + x.start(), m.start() + x.end()) for x in letters]
    return found


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dense_spans(text: str, taken: list[tuple[int, int, int]], vocabulary: str, max_ratio: float) -> list[tuple[int, int, int]]:
    """Parts of runs that take many tokens for their length and lie outside ``taken``."""
    found = []
    for m in _RUN.finditer(text):
        covered = [(a, b) for a, _, b in taken if a < m.end() and m.start() < b]
        covered += [(m.start() + x.start(), m.start() + x.end()) for x in _UUID.finditer(m[0])]
        for start, end in _uncovered(m.start(), m.end(), covered):
            found += [(start + a, 3, start + b) for a, b in _dense_within(text[start:end], _encoding(vocabulary), max_ratio)]
    return found


def scan(text: str, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> tuple[list, list]:
    """The patterns' spans, and all spans."""
    base = base_spans(text)
    return base, sorted(base + dense_spans(text, base, vocabulary, max_ratio))


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO
) -> DataFrame:
    """``(id, n_assign, n_access, n_hex, n_dense, base, spans)`` for each row; spans as ``kind:start:end``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = [scan(t, vocabulary, max_ratio) for t in texts_of(part, text_col)]
                counts = [pa.array([sum(k == kind for _, k, _ in every) for _, every in got], pa.int64()) for kind in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), *counts, pa.array([_named(b) for b, _ in got]), pa.array([_named(x) for _, x in got])],
                    [id_col, *[f"n_{k}" for k in KINDS], "base", "spans"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"
    )


def without_secrets(text: str, mark: str = MARK, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> str:
    """The text with the union of its spans replaced by marks."""
    out, at = [], 0
    for a, _, b in scan(text, vocabulary, max_ratio)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(
    docs: DataFrame, text_col: str = "text", mark: str = MARK, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO
) -> DataFrame:
    """All rows and columns, secrets replaced by ``mark``; ``n_chars``, if there, follows changed texts."""

    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without_secrets(t, mark, vocabulary, max_ratio) for t in texts], dtype=object)

    # Own columns are kept as one struct, so that no name of theirs can clash.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    was = F.col(f"own.`{text_col}`")
    own = own.withColumn("clean", F.pandas_udf(clean, "string")(was))
    columns = {c: F.col(f"own.`{c}`") for c in docs.columns}
    columns[text_col] = F.col("clean")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("clean").eqNullSafe(was), columns["n_chars"]).otherwise(
            F.char_length("clean").cast(docs.schema["n_chars"].dataType)
        )
    return own.select(*[x.alias(c) for c, x in columns.items()])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_dense")
