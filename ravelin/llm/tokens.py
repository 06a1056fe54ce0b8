"""Token ids of whole texts with the tokenizers library, through a cache of words.

Pre-tokenizers of the two vocabularies never join what stands before a space or
line feed with it if a visible character follows, nor a line feed with that
character, nor a letter with punctuation after it other than an apostrophe, so a
text can be cut there and the parts encoded alone. The cuts are
found in a batch's bytes at once, the distinct parts of a batch are looked up,
and only parts not seen before are encoded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
#: Parts kept that have been seen in two batches, and in one.
_MOST_PARTS, _MOST_NEW = 400_000, 450_000
#: The same, and bytes of a slice, where workers hold the tables of other operators too.
_LIGHT_PARTS, _LIGHT_NEW, LIGHT_SLICE = 100_000, 120_000, 2 << 20
_JOIN = 2000
#: Parts that can't touch a mark between them: no white space or control character within.
_PLAIN = re.compile(r" ?[^\s\x00-\x20\x7f-\xa0]+")
#: First bytes of visible characters: ASCII, and U+00C0 to U+023F.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xC9] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = True
_LETTER[0x61:0x7B] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[0x21:0x7F] = True
_PUNCTUATION[0x30:0x3A] = False
_PUNCTUATION[_LETTER] = False
_PUNCTUATION[ord("'")] = False
#: Second bytes of U+00C0 to U+00FF that are letters; 0xD7 and 0xF7 are signs.
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False


def byte_slices(batch: pa.RecordBatch, column: str, most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, or one longer row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


class WordEncoder:
    """Encodes columns of texts; ``leading`` tells whether ids depend on the space before a word, ``light`` asks for small caches."""

    def __init__(self, path: str, leading: bool, light: bool = False):
        self._most_parts, self._most_new = (_LIGHT_PARTS, _LIGHT_NEW) if light else (_MOST_PARTS, _MOST_NEW)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are text
        self._mark = "\n" if leading else " \x01 "
        (self._mark_id,) = self._tokenizer.encode(self._mark, add_special_tokens=False).ids
        self._known: dict[bytes, bytes] = {}
        self._new: dict[bytes, bytes] = {}

    def _learn(self, parts: list[bytes]) -> None:
        """Encodes new parts, many plain ones to a call with marks between them."""
        texts = [p.decode() for p in parts]
        plain = [k for k, t in enumerate(texts) if _PLAIN.fullmatch(t)]
        for at in range(0, len(plain), _JOIN):
            some = plain[at : at + _JOIN]
            found = self._tokenizer.encode_batch_fast([self._mark.join([texts[k] for k in some])], add_special_tokens=False)
            ids = np.array(found[0].ids, "<u4")
            marks = np.nonzero(ids == self._mark_id)[0]
            if len(marks) == len(some) - 1:
                raw, ends = ids.tobytes(), (4 * marks).tolist()
                cuts = map(slice, [0, *[x + 4 for x in ends]], [*ends, len(raw)])
                self._new.update(zip([parts[k] for k in some], map(raw.__getitem__, cuts), strict=True))
        rest = [k for k, p in enumerate(parts) if p not in self._new]
        found = self._tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)
        self._new.update((parts[k], np.array(x.ids, "<u4").tobytes()) for k, x in zip(rest, found, strict=True))

    def _look_up(self, parts: list[bytes]) -> list[bytes]:
        """The ids of distinct parts. What is met again is kept longer."""
        known, new = self._known, self._new
        if len(known) > self._most_parts:
            known.clear()
        if len(new) > self._most_new:
            new.clear()
        ids = [*map(known.get, parts)]
        rare = [k for k, x in enumerate(ids) if x is None]
        met = [k for k in rare if parts[k] in new]
        self._learn([parts[k] for k in rare if parts[k] not in new])
        for k in rare:
            ids[k] = new[parts[k]]
        for k in met:
            known[parts[k]] = new.pop(parts[k])
        return ids

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column, each text's followed by the end id, and where each text's start (one more at the end)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1]
        first, last = int(bounds[0]), int(bounds[-1])
        raw = np.frombuffer(data, np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
        cut = np.zeros(len(raw) + 1, bool)
        starts = bounds - first
        visible = _VISIBLE[raw[1:]]
        inner = starts[(starts > 0) & (starts < len(raw))]
        visible[inner - 1] = False  # what starts the next text is no neighbour of what ends this one
        line = (raw[:-1] == 10) & visible
        cut[:-2] |= line | ((raw[:-1] == 32) & visible)
        cut[1:-1] |= line
        letter = _LETTER[raw]
        letter[1:] |= (raw[:-1] == 0xC3) & _SECOND[raw[1:]]
        cut[1:-1] |= letter[:-1] & _PUNCTUATION[raw[1:]]
        cut[starts] = True
        at = np.nonzero(cut)[0].astype(np.int32)  # starts of parts, and the end
        parts = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)])
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        ids = [*self._look_up(distinct), np.array([END_ID], "<u4").tobytes()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), "<u4")
        firsts = np.cumsum(sizes) - sizes
        # Each text is its parts and then the end id, as one more part.
        ends = np.searchsorted(at, starts[1:])
        which = np.insert(coded.indices.to_numpy(zero_copy_only=False), ends, len(ids) - 1)
        takes = sizes[which]
        before = np.cumsum(takes) - takes
        out = flat[np.repeat(firsts[which] - before, takes) + np.arange(takes.sum())]
        docs = np.zeros(n + 1, np.int64)
        np.cumsum(takes, out=takes)
        docs[1:] = takes[ends + np.arange(n)]
        return out, docs

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids with the end id."""
        ids, at = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@cache
def encoder(vocabulary: str, light: bool = False) -> WordEncoder:
    """One encoder for each vocabulary file and Python worker."""
    path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
    return WordEncoder(path, leading=not os.path.basename(path).startswith("word_"), light=light)
