"""Work units: rows that share a key, dealt by it and sorted, read as a stream of complete runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together, besides a batch.
GROUP_BYTES = 4 << 20


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the consecutive rows with an equal key, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key)
        change = np.flatnonzero(np.asarray(pc.not_equal(column[1:], column[:-1]))) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            value = column[a].as_py()
            if held and value != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = value
    if held:
        yield pa.Table.from_batches(held)


def grouped(batches: Iterator[pa.RecordBatch], size: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold size bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def gathered(at: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The indices at, at + 1, ... of many values from each place, one run after another."""
    stops = np.cumsum(many)
    return np.repeat(at - stops + many, many) + np.arange(stops[-1] if len(stops) else 0)


class Remembered:
    """Runs of ids that were worked out for different strings, by string.

    Up to limit strings are remembered, besides those of one call; then those go that few calls have asked for.
    """

    def __init__(self, limit: int, kind: np.dtype | type):
        self.limit, self.known = limit, {}
        self.ids, self.sizes, self.used = np.empty(0, kind), np.empty(0, np.int64), np.empty(0, np.int32)

    def find(self, strings: pa.Array, work_out: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The places of different strings; work_out gives the ids of new ones, and how many each has."""
        texts = strings.to_pylist()
        if len(self.known) > self.limit:
            self._forget()
        place = np.fromiter(map(self.known.get, texts, repeat(-1)), np.int64, len(texts))
        self.used[place[place >= 0]] += 1
        new = np.flatnonzero(place < 0)
        if len(new):
            ids, sizes = work_out(strings.take(pa.array(new)))
            place[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip([texts[i] for i in new.tolist()], place[new].tolist(), strict=True))
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.used = np.concatenate([self.used, np.ones(len(new), np.int32)])
        return place

    def _forget(self) -> None:
        least = 2
        while (self.used >= least).sum() > self.limit // 2:
            least *= 2
        stay = np.flatnonzero(self.used >= least)
        strings, self.known = list(self.known), {}
        self.known = {strings[i]: n for n, i in enumerate(stay.tolist())}
        self.ids = self.ids[gathered((np.cumsum(self.sizes) - self.sizes)[stay], self.sizes[stay])]
        self.sizes, self.used = self.sizes[stay], self.used[stay] // 2

    def joined(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of one place after another, and how many each has."""
        many = self.sizes[place]
        return self.ids[gathered((np.cumsum(self.sizes) - self.sizes)[place], many)], many


def tiled(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes from each start to the next."""
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)])


class Forest:
    """Union-find over 0 to n - 1, rooted at the least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))], np.int64)
