"""Texts of Arrow batches as byte arrays, word hashes, and groups of sorted batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def tidy(run):
    """``run`` over a task's batches, with its memory given back at the end.

    Workers go on to other tasks, and what the allocators keep adds up to
    more than a small executor has.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; NULL is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2] or b"", np.uint8), off


def pieces(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes together, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base modulo 2^64, and their inverses."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ``values[start:end]`` that depend on the content alone."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix(((sums[end] - sums[start]) * down[start]) + (end - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray, i: int, j: int, lower: bool = True):
    """Word hashes of rows ``i`` to ``j``, the bounds of each row in them, and
    the bytes with each word's start and end."""
    rel = (off[i : j + 1] - off[i]).astype(np.int64)
    raw = data[off[i] : off[j]]
    buf = LOWER[raw] if lower else raw
    solid = np.zeros(len(buf) + 1, bool)
    solid[:-1] = ~SPACE[raw]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    cuts = rel[1:-1]
    start[cuts] = solid[cuts]
    start = np.flatnonzero(start[:-1])
    end = ~solid[1:]
    end[cuts[cuts > 0] - 1] = True
    end = np.flatnonzero(end & solid[:-1]) + 1
    return range_hashes(BYTE[buf], start, end), np.searchsorted(start, rel), buf, start, end


def record_batches(batches, limit: int = 32 << 20):
    """Batches cut so that no more than about ``limit`` bytes are worked on at once."""
    for batch in batches:
        n = max(1, min(batch.num_rows, int(batch.num_rows * limit / max(batch.nbytes, 1))))
        for i in range(0, batch.num_rows, n):
            yield batch.slice(i, n)


def sorted_groups(batches, key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by a hash column ``key``.

    Only groups of two rows or more come out; a table holds many groups.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        if held and k[0] == k[-1] == held[-1].column(key)[-1].as_py():
            held.append(batch)
            continue
        cut = int(np.searchsorted(k, k[-1])) if k[0] <= k[-1] else 0
        cut = cut if k[0] != k[-1] else 0
        held.append(batch.slice(0, cut))
        yield from _several(held, key)
        held = [batch.slice(cut)]
    yield from _several(held, key)


def _several(held, key):
    held = [b for b in held if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        k = table.column(key).to_numpy()
        same = k[1:] == k[:-1]
        keep = np.zeros(len(k), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if keep.any():
            yield table.filter(pa.array(keep))


def bounds(k: np.ndarray) -> np.ndarray:
    """Where the groups of a sorted array begin, and its length."""
    return np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)] if len(k) else np.zeros(1, np.int64)
