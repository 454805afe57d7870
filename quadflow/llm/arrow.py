"""Arrow helpers shared by the Python kernels: bounded slices of text columns
and small record batches, so that a task's memory does not follow the batch
size Spark happens to send."""

from __future__ import annotations

import ctypes
import sys
import types

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000


def texts(column: pa.Array) -> pa.Array:
    """The column as a string array without nulls (null becomes empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    return column


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets start at 0."""
    column = texts(column)
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES):
    """(lo, hi) ranges of consecutive rows of about ``limit`` bytes; a single
    larger row is a range of its own."""
    lo, total, n = 0, 0, len(sizes)
    for i in range(n):
        if i > lo and total + sizes[i] > limit:
            yield lo, i
            lo, total = i, 0
        total += int(sizes[i])
    if lo < n:
        yield lo, n


def text_slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES):
    """Slices of a batch by the byte size of one text column:
    (sub-batch, bytes, offsets)."""
    data, off = utf8(batch.column(name))
    for lo, hi in slices(np.diff(off), limit):
        yield batch.slice(lo, hi - lo), data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
    release()


def release() -> None:
    """Gives memory that this Python worker has freed back to the system, so
    that a worker reused by many tasks doesn't keep the peak of each."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across tasks.

    Kernels are pickled by value, so their module globals are fresh in every
    task; only caches of pure functions are kept here."""
    holder = sys.modules.setdefault("_quadflow_worker_store", types.ModuleType("_quadflow_worker_store"))
    return holder.__dict__.setdefault(name, {})
