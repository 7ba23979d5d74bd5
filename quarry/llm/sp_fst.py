"""SentencePiece encoding and decoding by weighted finite-state transduction.

Compiled once a model: the normaliser (spaces and marks become the mark, one mark is put in front); the pieces, a trie
of arcs whose accepting states carry a piece and its weight, the negated score; byte fallback, arcs over one character
that no piece covers, dearer than any piece; and for byte-pair models a constraint transducer over adjacent pieces,
whose arcs weigh 0 where merging leaves the two pieces side by side and infinity elsewhere. The normaliser is composed
with the trie while compiling: arcs that would read the mark read a space, so the trie runs over the bytes of a text.

An input is composed with them: the trie is walked from every position, which gives the lattice's arcs; its states are
(position, last piece). The tropical-semiring shortest path relaxes the arcs by minimum in the order of their starts.
For byte-pair models pieces t1..tk are what merging yields exactly if each adjacent pair is what merging yields for
the pair alone, since a merge only sees neighbouring symbols and the first merge across a border would also happen in
that pair. So at each position one last piece has a finite weight, and one state a position is enough. For unigram
models there is no constraint, and the least weight decides.

Inputs are cut where no piece can span: between characters whose bytes no piece has side by side. All different cuts of
a batch are composed and relaxed in lockstep, a byte position at a time, and the texts' ids are put together from
theirs. A worker remembers some REMEMBERED cuts' paths, and the constraint's answers in a table of 2 ** PAIR_BITS.

Decoding runs the transducers backwards: pieces to bytes, marks to spaces, and the mark in front removed; bytes that are
not UTF-8 become replacement characters.

Supported are models with identity normalisation, escaped and kept spaces and byte fallback; others raise ValueError.
Defined results: a null or empty text has no ids and decodes to an empty text; an escape mark in a text decodes to a
space, as in the library. Rows are independent: ties, repeated rows, null and repeated ids need nothing special. A
batch holds at least one text, so a very long one is encoded alone, in memory of some 60 times its bytes. Ties
between paths of a unigram model go to the one whose last piece is longest. Empty input gives an empty result. Other columns than the named ones are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.storage import bounded_batches
from quarry.llm.textscan import column_bytes
from quarry.llm.units import Remembered, gathered, grouped, tiled

MARK = "▁"
#: Cuts whose paths a worker remembers, besides a batch's; merges of pieces; bits of the constraint's table.
REMEMBERED, HISTORIES, PAIR_BITS = 200_000, 8192, 20
#: Bytes of different cuts that are relaxed together; ids decoded at a time.
BLOCK, DECODED = 1 << 18, 1 << 17
INFINITY = float("inf")

_SIZE = np.ones(256, np.int32)
_SIZE[0xC0:0xE0], _SIZE[0xE0:0xF0], _SIZE[0xF0:] = 2, 3, 4


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(key & 7) or varint(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Trie:
    """Byte strings as arcs of a double array: the child of node s by byte b is at base[s] + b if its parent is s."""

    def __init__(self, strings: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        accepts = [-1]
        for text, value in strings.items():
            node = 0
            for byte in text:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    accepts.append(-1)
                node = children[node][byte]
            accepts[node] = value
        size = 2 * len(children) + 1024
        base, free = np.zeros(len(children), np.int64), np.ones(size, bool)
        free[0] = False
        arcs = [np.array(sorted(c), np.int64) for c in children]
        order = sorted(range(len(children)), key=lambda s: -len(arcs[s]))
        alone = [s for s in order if len(arcs[s]) == 1]
        low: dict[int, int] = {}
        for node in order[: len(order) - len(alone) - sum(not len(a) for a in arcs)]:
            own = arcs[node]
            start = low.get(len(own), 0)
            while True:
                tried = start + np.flatnonzero(free[start + own[0] : start + own[0] + 2048])
                tried = tried[tried + own[-1] < size]
                fit = free[tried[:, None] + own].all(axis=1)
                if fit.any():
                    break
                start = low[len(own)] = start + 1024
            base[node] = tried[fit.argmax()]
            free[base[node] + own] = False
        places = np.flatnonzero(free[256:])[: len(alone)] + 256
        base[alone] = places - np.array([arcs[s][0] for s in alone], np.int64)
        place = np.zeros(len(children), np.int64)
        for node, below in enumerate(children):
            for byte, child in below.items():
                place[child] = base[node] + byte
        self.base, self.parent, self.value = np.zeros(size, np.int32), np.full(size + 256, -1, np.int32), np.full(size, -1, np.int32)
        self.base[place], self.value[place] = base, accepts
        for node, below in enumerate(children):
            for child in below.values():
                self.parent[place[child]] = place[node]


class Pairs:
    """Whether one piece may follow another: a table with two places for a key; what it lacks is asked and entered."""

    def __init__(self, ask: Callable[[int], bool]):
        self.ask, self.table = ask, np.full(1 << PAIR_BITS, -1, np.int64)

    def allowed(self, keys: np.ndarray) -> np.ndarray:
        first, second = ((keys.view(np.uint64) * np.uint64(m) >> np.uint64(64 - PAIR_BITS)).view(np.int64) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
        found = self.table[first]
        other = np.flatnonzero(found >> 1 != keys)
        found[other] = self.table[second[other]]
        missing = other[found[other] >> 1 != keys[other]]
        if len(missing):
            new, at, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            entries = np.array([k << 1 | self.ask(k) for k in new.tolist()], np.int64)
            one, two = first[missing[at]], second[missing[at]]
            self.table[np.where(self.table[one] < 0, one, two)] = entries
            found[missing] = entries[back]
        return (found & 1).astype(bool)


class Transducer:
    def __init__(self, model: bytes):
        """model: a serialised SentencePiece model."""
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        parts = dict(_fields(model))
        trainer, normaliser = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
        if normaliser.get(2):
            raise ValueError("only identity normalisation is supported")
        if normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("removal of spaces and unescaped spaces are not supported")
        self.front, self.merging = bool(normaliser.get(3, 1)), trainer.get(3, 1) == 2
        self.n = sp.get_piece_size()
        self.arcs: dict[str, tuple[int, float]] = {}
        self.byte_ids = np.full(256, -1, np.int32)
        written: list[bytes] = []
        for i in range(self.n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                written.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                written.append(b"" if not sp.is_unknown(i) else " ⁇ ".encode())
            else:
                self.arcs[piece] = (i, -sp.get_score(i))
                written.append(piece.replace(MARK, " ").encode())
        if (self.byte_ids < 0).any():
            raise ValueError("models without byte fallback are not supported")
        self.written, self.written_sizes = np.frombuffer(b"".join(written), np.uint8), np.array([len(x) for x in written])
        self.written_at = np.cumsum(self.written_sizes) - self.written_sizes
        self.pieces = {i: p for p, (i, _) in self.arcs.items()}
        joined = [p for p in self.arcs if len(p) > 1]
        inner = {c for p in joined for c in p}
        if self.merging and not inner <= self.arcs.keys():
            raise ValueError("a piece is merged from characters that are no pieces")
        # the weights by piece; the last is that of byte fallback
        self.weight = np.full(self.n + 1, 10.0 + max(w for _, w in self.arcs.values()))
        for i, w in self.arcs.values():
            self.weight[i] = w
        own = [p for p in self.arcs if not self.merging or self.merge(p)[-1][2] == p]
        self.trie = Trie({p.replace(MARK, " ").encode(): self.arcs[p][0] for p in own})
        # two bytes that no piece has side by side are apart, if the second begins a character
        self.apart = np.ones(1 << 16, bool)
        for piece in joined:
            raw = np.frombuffer(piece.replace(MARK, " ").encode(), np.uint8).astype(np.intp)
            self.apart[raw[:-1] << 8 | raw[1:]] = False
        self.apart.reshape(256, 256)[:, 0x80:0xC0] = False
        self.pairs = Pairs(lambda key: self.adjacent(*divmod(key, self.n)))
        self.history = lru_cache(HISTORIES)(lambda piece: self.merge(self.pieces[piece]))
        self.known = Remembered(REMEMBERED, np.int32)

    def merge(self, text: str) -> list[tuple[float, str, str]]:
        """Byte-pair merging of a text by itself: the weight of each merge in turn, with the first and last symbol after
        it; before the merges, the first and last character with no weight."""
        parts, out = list(text), [(-INFINITY, text[0], text[-1])]
        while len(parts) > 1:
            best, at = INFINITY, -1
            for i in range(len(parts) - 1):
                arc = self.arcs.get(parts[i] + parts[i + 1])
                if arc and arc[1] < best:
                    best, at = arc[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out.append((best, parts[0], parts[-1]))
        return out

    def adjacent(self, left: int, right: int) -> bool:
        """The constraint: merging both pieces' characters in one text never merges across their border."""
        a, b, i, j = self.history(left), self.history(right), 0, 0
        while True:
            across = self.arcs.get(a[i][2] + b[j][1], (0, INFINITY))[1]
            next_a = a[i + 1][0] if i + 1 < len(a) else INFINITY
            next_b = b[j + 1][0] if j + 1 < len(b) else INFINITY
            if across < next_a and across <= next_b and across < INFINITY:
                return False
            if next_a == next_b == INFINITY:
                return True
            if next_a <= next_b:  # of equal weights the leftmost goes first
                i += 1
            else:
                j += 1

    def lattice(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, piece) of the arcs over all cuts: the trie walked from every character, and byte fallback (-1).
        ends: of each position, the end of its cut."""
        lead = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
        start, node = lead, np.zeros(len(lead), np.int32)
        covered = np.zeros(len(data), bool)
        found, size = [], 0
        while len(start):
            at = self.trie.base[node] + data[start + size]
            ok = self.trie.parent[at] == node
            start, node, size = start[ok], at[ok], size + 1
            piece = self.trie.value[node]
            hit = piece >= 0
            from_, piece = start[hit], piece[hit]
            found.append((from_, np.full(len(from_), size, np.int32), piece))
            if size <= 4:
                covered[from_[_SIZE[data[from_]] == size]] = True
            more = start + size < ends[start]
            start, node = start[more], node[more]
        bare = lead[~covered[lead]]
        found.append((bare, _SIZE[data[bare]], np.full(len(bare), -1, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def shortest_paths(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the paths of cuts that lie one after another, none empty, and how many each has."""
        edges = edges.astype(np.int32)
        sizes, k = np.diff(edges), len(edges) - 1
        number = np.repeat(np.arange(k, dtype=np.int32), sizes)
        start, size, piece = self.lattice(data, np.repeat(edges[1:], sizes))
        step = start - edges[:-1][number[start]]
        longest = int(sizes.max())
        order = np.argsort(step.astype(np.uint16) if longest < 1 << 16 else step, kind="stable")
        # a cut of m bytes has m + 1 states
        begin = start[order]
        begin += number[begin]
        end, piece = begin + size[order], piece[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(step, minlength=longest))]).tolist()
        first = edges[:-1] + np.arange(k, dtype=np.int32)
        cost, last, back = np.full(len(data) + k, INFINITY), np.full(len(data) + k, -1, np.int32), np.zeros(len(data) + k, np.int32)
        cost[first] = 0
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if lo == hi:
                continue
            s, e, p = begin[lo:hi], end[lo:hi], piece[lo:hi]
            reached = cost[s] + self.weight[p]
            better = reached < cost[e]
            if self.merging:
                left = last[s]
                asked = np.flatnonzero(better & (left >= 0) & (p >= 0))
                better[asked] = self.pairs.allowed(left[asked].astype(np.int64) * self.n + p[asked])
            e = e[better]
            cost[e], last[e], back[e] = reached[better], p[better], s[better]
        return self._traced(data, first, first + sizes, number, last, back)

    def _traced(self, data: np.ndarray, first: np.ndarray, at: np.ndarray, number: np.ndarray, last: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        live, steps = np.arange(len(first)), []
        counts = np.zeros(len(first), np.int64)
        while len(live):
            here = at[live]
            before = back[here]
            steps.append((live, last[here], before))
            counts[live] += 1
            at[live] = before
            live = live[before != first[live]]
        ends = np.cumsum(counts)
        ids, states = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.int32)
        for i, (live, piece, before) in enumerate(steps):
            ids[ends[live] - 1 - i], states[ends[live] - 1 - i] = piece, before
        if (ids >= 0).all():
            return ids, counts
        own = np.repeat(np.arange(len(first)), counts)
        position = states - own.astype(np.int32)
        many = np.where(ids < 0, _SIZE[data[position]], 1)
        spread = gathered(position, many)
        return np.where(np.repeat(ids, many) < 0, self.byte_ids[data[np.minimum(spread, len(data) - 1)]], np.repeat(ids, many)), np.bincount(own, many, len(first)).astype(np.int64)

    def normal(self, texts: pa.Array) -> pa.Array:
        """Texts as the trie reads them, without the space in front."""
        texts = pc.fill_null(texts, "")
        return pc.replace_substring(texts, MARK, " ") if pc.any(pc.match_substring(texts, MARK)).as_py() else texts

    def encode(self, normal: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        if self.front:
            normal = pc.if_else(pc.equal(normal, ""), "", pc.binary_join_element_wise(" ", normal, ""))
        data, offsets, _ = column_bytes(normal)
        base, stop = int(offsets[0]), int(offsets[-1])
        data, offsets = data[base:stop], offsets - base
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(normal), np.int64)
        begins = np.zeros(len(data), bool)
        begins[1:] = self.apart[data[:-1].astype(np.uint16) << 8 | data[1:]]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        coded = tiled(data, starts).dictionary_encode()
        ids, many = self.known.joined(self.known.find(coded.dictionary, self.encode_cuts)[np.asarray(coded.indices)])
        stops = np.concatenate([[0], np.cumsum(many)])
        return ids, np.diff(stops[np.searchsorted(starts, offsets)])

    def encode_cuts(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different cuts, and how many each has; cuts of like length are relaxed together."""
        order = np.argsort(np.asarray(pc.binary_length(cuts)), kind="stable")
        data, edges, _ = column_bytes(cuts.take(pa.array(order)))
        ids, counts, lo = [], [], 0
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + BLOCK, "right")) - 1)
            found = self.shortest_paths(data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo])
            ids.append(found[0])
            counts.append(found[1])
            lo = hi
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        place = np.argsort(order)
        return ids[gathered((np.cumsum(counts) - counts)[place], counts[place])], counts[place]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of consecutive runs of ids."""
        sizes = self.written_sizes[ids]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(stops[-1], np.uint8)
        for lo in range(0, len(ids), DECODED):
            some = slice(lo, lo + DECODED)
            out[stops[lo] : stops[min(lo + DECODED, len(ids))]] = self.written[gathered(self.written_at[ids[some]], sizes[some])]
        edges = stops[np.concatenate([[0], np.cumsum(counts)])]
        texts = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out)])
        try:
            texts = texts.cast(pa.large_string())
        except pa.ArrowInvalid:
            texts = pa.array([x.as_py().decode("utf-8", "replace") for x in texts], pa.large_string())
        if self.front:
            texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
        return texts.cast(pa.string())


_compiled: dict[bytes, Transducer] = {}


def transducer(model: bytes) -> Transducer:
    """The compiled model, once a worker."""
    if model not in _compiled:
        _compiled.clear()
        _compiled[model] = Transducer(model)
    return _compiled[model]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))


ENCODED = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, ids array<int>, decoded string"


def _encode(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in grouped(batches):
            normal = t.normal(batch.column("text"))
            ids, counts = t.encode(normal)
            decoded = t.decode(ids, counts)
            raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts).tolist()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            out = [batch.column("doc_id"), pa.array(counts), pa.array(crc, pa.int64()), pc.equal(decoded, normal), _lists(ids, counts), decoded]
            yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in ENCODED.split(", ")])
            del batch, normal, ids, counts, decoded, raw, ends, crc, out
            pa.default_memory_pool().release_unused()

    return run


def encode_documents(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: doc_id, n_tokens, ids_crc32, round_trip (the ids decode to the text), ids and decoded.

    model: a path that the driver can read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_encode(read_model(model)), ENCODED)


def _decode(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in batches:
            lists = pc.if_else(pc.is_valid(batch.column("ids")), batch.column("ids"), pa.scalar([], pa.list_(pa.int32())))
            counts = np.asarray(pc.list_value_length(lists), np.int64)
            texts = t.decode(np.asarray(lists.flatten(), np.int64), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, text); a null list is an empty text."""
    bounded_batches(encoded.sparkSession)
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(read_model(model)), "doc_id long, text string")
