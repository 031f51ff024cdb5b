"""Streaming over groups of rows that stand together in a sorted partition."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by ``key``, several groups at a time."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        if kept and kept[-1].column(key)[0].as_py() == k[0] == k[-1]:
            kept.append(batch)
            continue
        last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        done = pa.Table.from_batches([*kept, batch.slice(0, last)]) if kept or last else None
        if done is not None and done.num_rows:
            yield done
        kept = [batch.slice(last)]
    if kept:
        yield pa.Table.from_batches(kept)


def run_bounds(values: np.ndarray) -> list[int]:
    """Where each run of equal values starts, and the end of the last."""
    return [*np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist(), len(values)] if len(values) else [0]


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for ``mapInArrow``, returning freed memory to the system when a task ends.

    An executor keeps more Python workers than it has cores, which take turns; memory that an idle one holds on to counts beside the busy ones'.
    """

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)
