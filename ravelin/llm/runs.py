"""Runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts(batch: pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    """The rows at which a run of equal ``keys`` begins."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = batch.column(k)
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The same sorted rows in batches that end where a run of ``keys`` ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(starts(batch, keys)[-1])
        goes_on = held and all(batch.column(k)[0].equals(held[-1].column(k)[0]) for k in keys)
        if held and (last or not goes_on):
            parts = [*held, batch.slice(0, last)] if goes_on else held
            yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            if not goes_on and last:
                yield batch.slice(0, last)
            held = []
        elif last:
            yield batch.slice(0, last)
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
