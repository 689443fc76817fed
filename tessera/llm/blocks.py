"""Whole-column text work on Arrow buffers: word bounds, hashes and compact sorted arrays, without a Python loop by word."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes handled at once; a longer text is handled whole.
CHUNK = 1 << 20
_BASE, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1024), _BASE)]))
    return _powers


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes: first row, end row, bytes, offsets."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def settled(run: Callable) -> Callable:
    """run over batches; at its end what its arrays have freed goes back to the system. Workers stay, and would hold it beside the next task."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none goes over the end of a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans (none empty): a polynomial in an odd base, scrambled."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    heads = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(heads, lens)
    bytes_ = data[np.repeat(starts, lens) + place].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(bytes_ * powers(int(lens.max()) + 1)[place], heads) + lens.astype(np.uint64))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lowered, and each row's offsets among them."""
    starts, ends = word_bounds(data, at)
    return span_hashes(LOWER[data], starts, ends), np.searchsorted(starts, at)


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal rank side by side, so that the shuffle's compression finds the zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """An ascending uint64 array as differences in planes."""
    return planes(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, np.uint64), dtype=np.uint64)


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[heads], np.add.reduceat(c.astype(np.int64), heads) if len(k) else np.zeros(0, np.int64)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in an ascending table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


def row_sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of x between offsets; empty rows give 0."""
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)]) if x.dtype.kind in "iub" else None
    if total is not None:
        return total[at[1:]] - total[at[:-1]]
    out = np.zeros(len(at) - 1, x.dtype)
    full = at[1:] > at[:-1]
    if full.any():
        out[full] = np.add.reduceat(x, at[:-1][full])
    return out
