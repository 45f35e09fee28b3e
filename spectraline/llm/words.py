"""Words of Arrow text columns as NumPy arrays: ends, 64-bit hashes, and hashes of word runs.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; as these are ASCII, bytes and code
points agree on where words end. Equal words have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_pow = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """The first n powers (at least) of an odd base modulo 2**64."""
    global _pow
    if len(_pow) < n:
        grown = np.full(max(n, 2 * len(_pow)), U(_BASE | 1), U)
        grown[0] = 1
        _pow = np.multiply.accumulate(grown)
    return _pow


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (splitmix finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Words:
    """Words of n rows: of word i, its row, its hash, and its bytes data[start:end]."""

    n: int
    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def first(self) -> np.ndarray:
        """n + 1 positions: the words of row r are first[r]..first[r + 1]."""
        return np.searchsorted(self.row, np.arange(self.n + 1))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(column: pa.Array, lower: bool = False) -> Words:
    data, at = text_bytes(column)
    if lower:
        data = LOWER[data]
    n, size = len(at) - 1, len(data)
    space = SPACE[data]
    before, after = np.ones(size, bool), np.ones(size, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = at[:-1][at[:-1] < size]
    before[edges] = True
    edges = at[1:][at[1:] > 0] - 1
    after[edges] = True
    inside = ~space
    start, end = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(n, data, none, none, none, np.zeros(0, U))
    row = np.searchsorted(at[1:], start, side="right")
    size_of = end - start
    first = np.cumsum(size_of) - size_of
    place = np.arange(int(size_of.sum())) - np.repeat(first, size_of)
    value = (data[inside].astype(U) + U(1)) * powers(int(size_of.max()))[place]
    return Words(n, data, row, start, end, mix(np.add.reduceat(value, first) + size_of.astype(U)))


def runs(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which k words of one row begin, and the hashes of these runs."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    total, weight = np.zeros(n, U), powers(k + 1)
    for j in range(k):
        total += h[j : n + j] * weight[j]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return at, mix(total[at] + U(k))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch with about limit bytes of text at most, or one row: bounds memory for long texts."""
    _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(values: pa.Array, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)
