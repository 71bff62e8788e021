"""Whole texts as byte arrays: pieces of bounded size from Arrow columns, and hashes of fixed-length byte strings.

All hashes are vectorised over a piece of many texts at once and use a fixed table of random 64-bit values, so they
agree in every task and every run.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from weftline.session import ship_by_value

ship_by_value(__name__)

_random = np.random.Generator(np.random.PCG64(20240601))
TABLE = _random.integers(0, 2**64, 256, dtype=np.uint64)
ODD = _random.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_29, _32 = np.uint64(29), np.uint64(32)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def release() -> None:
    """Gives freed memory back to the system: workers live on after a task, and what they keep adds up over stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; memory is given back after the last one."""
    try:
        yield from batches
    finally:
        release()


def mixed(x: np.ndarray) -> np.ndarray:
    """x changed in place so that every bit depends on all bits."""
    x ^= x >> _32
    x *= _MIX
    x ^= x >> _29
    x *= ODD[60]
    x ^= x >> _32
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def pieces(column: pa.Array, limit: int = 1 << 19, rows: int = 4096, overlap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row of each part, part's start in its row) of at most about limit bytes.

    Texts beyond limit come in parts that overlap by so many bytes (a part's last overlap bytes begin the next one);
    other texts are one part each.
    """
    data, offsets = buffers(column)
    lengths = np.diff(offsets)
    row, n = 0, len(lengths)
    while row < n:
        if lengths[row] > limit and overlap:
            base = offsets[row]
            for at in range(0, int(lengths[row]) - overlap, limit):
                end = min(at + limit + overlap, int(lengths[row]))
                yield data[base + at : base + end], np.array([0, end - at], np.int64), np.array([row]), np.array([at])
            row += 1
            continue
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), row + rows, n)
        if overlap:
            long = np.flatnonzero(lengths[row:stop] > limit)
            stop = row + int(long[0]) if len(long) and long[0] else stop
        yield data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], np.arange(row, stop), np.zeros(stop - row, np.int64)
        row = stop


def doubled(h: np.ndarray, d: int, which: int) -> np.ndarray:
    """Hashes of strings twice as long: of the d bytes at i and the d bytes at i + d."""
    out = h[:-d] * ODD[which]
    out += h[d:]
    return out


def byte_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the 32 bytes and of the 64 bytes at each place, and the mixed hash of 32 (empty if data is shorter)."""
    h = TABLE[data]
    for which, d in enumerate((1, 2, 4, 8, 16)):
        if len(h) <= d:
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint64)
        h = doubled(h, d, which)
    h32 = mixed(h)
    h64 = mixed(doubled(h32, 32, 5)) if len(h32) > 32 else np.empty(0, np.uint64)
    return h32, h64, h32


def window_hashes(h64: np.ndarray, length: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the bytes at each place, of a length from 65 to 128."""
    d = length - 64
    if len(h64) <= d:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return mixed(doubled(h64, d, 6)), mixed(doubled(h64, d, 7))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width values in a row."""
    n, have = len(v) - width + 1, 1
    if n <= 0:
        return v[:0]
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[:n], v[width - have : width - have + n]) if have < width else v[:n]
