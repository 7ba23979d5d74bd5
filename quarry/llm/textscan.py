"""Vectorised word scanning over the raw UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes other than space and tab to carriage return; those six are single bytes in UTF-8, so
no decoding is needed. Words get 64-bit polynomial hashes from prefix sums, windows of words combine them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that are scanned at once; a longer document is scanned alone.
CHUNK_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [_RANDOM.integers(1, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(16)]
_BASE = 0x9E3779B97F4A7C15 | 1
_UNDO = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, offsets, is_null) of a binary or string Arrow array; data and offsets are views."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n, kind = len(column), np.int64 if wide else np.int32
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64), np.empty(0, bool)
    offsets = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets, np.asarray(column.is_null())


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about size bytes of text each, at least one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of rows lo to hi: starts and ends (byte positions from base), the row of each, counts by row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool = False):
        self.base = int(offsets[lo])
        raw = data[self.base : int(offsets[hi])]
        edges = (offsets[lo : hi + 1] - self.base).astype(np.int64)
        self.bytes, self.edges, self.rows = (_LOWER[raw] if lower else raw), edges, hi - lo
        space = _SPACE[raw]
        begins = ~space
        if len(raw):
            inner = edges[1:-1]
            inner = inner[inner < len(raw)]
            after = np.empty(len(raw), bool)
            after[0] = True
            after[1:] = space[:-1]
            after[inner] = True  # a row's first byte begins a word even if the row before ended in one
            ends_here = np.empty(len(raw), bool)
            ends_here[-1] = True
            ends_here[:-1] = space[1:]
            ends_here[inner[inner > 0] - 1] = True
            self.starts = np.flatnonzero(begins & after)
            self.ends = np.flatnonzero(begins & ends_here) + 1
        else:
            self.starts = self.ends = np.empty(0, np.int64)
        self.space = space
        first = np.searchsorted(self.starts, edges)
        self.first, self.counts = first, np.diff(first)
        self.row = np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        n = len(self.bytes) + 1
        if len(_powers[0]) < n:
            for i, factor in enumerate((_BASE, _UNDO)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                _powers[i] = np.cumprod(steps, dtype=np.uint64)
        total = np.zeros(n, np.uint64)
        np.cumsum(_BYTE[self.bytes] * _powers[0][: n - 1], out=total[1:])
        out = (total[self.ends] - total[self.starts]) * _powers[1][self.starts]
        if len(_powers[0]) > 8 * CHUNK_BYTES:  # after a giant document
            _powers[:] = [_powers[0][:1], _powers[1][:1]]
        return mix(out)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of its first word) of every run of size words within a row."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        out = np.zeros(len(at), np.uint64)
        for i in range(size):
            out += hashes[at + i] * _STEP[i]
        return mix(out), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of rows lo to hi, one after another, and the hi - lo + 1 edges between rows.

    A row with fewer than size words has its whole sequence as one shingle, one without words has none.
    """
    words = Words(data, offsets, lo, hi, lower=True)
    hashes = words.hashes()
    out, at = words.windows(hashes, size)
    row = words.row[at]
    few = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for i in range(size - 1):
            has = words.counts[few] > i
            whole[has] += hashes[words.first[few[has]] + i] * _STEP[i]
        whole = mix(whole + words.counts[few].astype(np.uint64) * _STEP[15])
        out, row = np.concatenate([out, whole]), np.concatenate([row, few])
        order = np.argsort(row, kind="stable")
        out, row = out[order], row[order]
    edges = np.searchsorted(row, np.arange(words.rows + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[keep], np.searchsorted(row[keep], np.arange(words.rows + 1))
