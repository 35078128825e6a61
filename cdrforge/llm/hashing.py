"""Words and their 64-bit hashes for whole Arrow columns at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 is the
same as ``[^\\x20\\x09-\\x0D]+`` over code points. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_TABLE = np.random.Generator(np.random.PCG64(20240611)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = [np.ones(1, np.uint64)]
CHUNK = 1 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x + U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    if len(_powers[0]) < n:
        p = np.full(2 * n, _BASE)
        p[0] = 1
        _powers[0] = np.multiply.accumulate(p)
    return _powers[0][:n]


class Words(NamedTuple):
    data: np.ndarray  # bytes of the texts
    offsets: np.ndarray  # of the texts in data, one more than texts
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, one more than texts
    hash: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")  # beyond 2 GB chunks of short offsets are not combined
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = buffers(column)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = end - start
    at = np.cumsum(long) - long
    if len(at):
        inside = np.arange(at[-1] + long[-1]) - np.repeat(at, long)
        h = np.add.reduceat((_LOWER if lower else _TABLE)[data[solid]] * powers(int(long.max()))[inside], at)
    else:
        h = np.zeros(0, np.uint64)
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), mix(h ^ long.astype(np.uint64)))


def pieces(batch: pa.RecordBatch | pa.Table, text: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about ``most`` bytes of text, so that work arrays stay small."""
    _, offsets = buffers(batch.column(text))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def windows(h: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Polynomial (Rabin-Karp) hash of each run of ``size`` consecutive values; mixed."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    total, b = h[: len(h) - size + 1].copy(), U(base)
    for k in range(1, size):
        total *= b
        total += h[k : len(h) - size + 1 + k]
    return mix(total)
