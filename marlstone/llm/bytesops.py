"""Numpy over the bytes of many texts at once: slices of Arrow columns, words, rolling hashes.

Every function works on one flat byte buffer with document offsets; no Python loop runs per byte
or per word. Hashes are 64 bits wide: a polynomial over random byte values, then a finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
#: [\x20\x09-\x0D]
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_slices(column, max_bytes: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets) of runs of rows of at most ``max_bytes``; a longer text comes alone. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(where, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        to = min(to, n)
        yield at, to, flat[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


@lru_cache(maxsize=2)
def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, U(_BASE)), np.full(n, U(pow(_BASE, -1, 2**64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    size = 1 << 20
    while size < n:
        size *= 2
    return _power_table(size)


def forget_powers() -> None:
    """Free the tables of powers; 16 MB at least."""
    _power_table.cache_clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the word."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_hash(flat: np.ndarray) -> np.ndarray:
    up, _ = powers(len(flat) + 1)
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[flat] * up[: len(flat)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, end); equal spans have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of the maximal runs of non-white bytes; runs end with their document."""
    if not len(flat):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~WHITE[flat]
    first = np.zeros(len(flat) + 1, bool)
    first[offsets] = True
    before = np.empty(len(flat), bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[first[:-1]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(flat), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[first[1:]] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
