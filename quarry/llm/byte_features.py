"""Hashed byte n-grams of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quarry.llm.textscan import chunks, column_bytes

_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def hashed_rows(column: pa.Array, sizes: tuple[int, ...], bits: int, table: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """For each row the features (0 to 2**bits - 1) of its n-grams of each size; table maps bytes first."""
    data, offsets, null = column_bytes(column)
    for lo, hi in chunks(offsets):
        base = int(offsets[lo])
        raw = data[base : int(offsets[hi])]
        raw = (table[raw] if table is not None else raw).astype(np.uint32)
        edges = (offsets[lo : hi + 1] - base).tolist()
        codes = []
        for size in sizes:
            n = max(0, len(raw) - size + 1)
            code = np.full(n, size * 0x01000193, np.uint32)
            for i in range(size):
                code = (code ^ raw[i : i + n]) * _FACTORS[i]
            code ^= code >> np.uint32(15)
            codes.append(((code * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)).astype(np.int32))
        for row, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if null[lo + row]:
                yield np.empty(0, np.int32)
                continue
            parts = [code[a : max(a, b - size + 1)] for code, size in zip(codes, sizes, strict=True)]
            yield parts[0] if len(parts) == 1 else np.concatenate(parts)
