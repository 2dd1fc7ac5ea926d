"""Arrow UTF-8 buffers as numpy arrays, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and its n + 1 offsets from 0."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type)
    _, places, data = array.buffers()
    if not len(array) or places is None:
        return np.empty(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string array over ``data``, which is not copied."""
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def begins(values: pa.Array) -> np.ndarray:
    """Where a value, or null, differs from the one before it."""
    codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.append(True, codes[1:] != codes[:-1])[: len(codes)]


def running(flags: np.ndarray) -> np.ndarray:
    """How many of ``flags`` are set before each place, and at the end in all."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def occurrences(data: np.ndarray, offsets: np.ndarray, what: bytes) -> np.ndarray:
    """Where ``what`` begins inside one row; rows do not run together."""
    at = np.flatnonzero(data == what[0])
    at = at[at + len(what) <= len(data)]
    for k in range(1, len(what)):
        at = at[data[at + k] == what[k]]
    row = np.searchsorted(offsets, at, "right") - 1
    return at[at + len(what) <= offsets[row + 1]]


def gathered(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The segments of ``source`` one behind another in a new array."""
    before = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    return source[np.repeat(starts - before, lengths) + np.arange(total)]


def sliced(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most ``most`` bytes in the string columns, or
    one row; this bounds what a kernel allocates, whatever Spark sends."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            size += np.diff(utf8(batch.column(c))[1])
        total, first = np.cumsum(size), 0
        while first < batch.num_rows:
            limit = most + (total[first - 1] if first else 0)
            last = max(first + 1, int(np.searchsorted(total, limit, "right")))
            yield batch.slice(first, last - first)
            first = last
