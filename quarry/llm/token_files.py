"""Token-ID files: flat unsigned integers with 64-bit document offsets, memory-mapped.

Documents are dealt to partitions by ranges of their id and sorted in each; ranges also tell apart rows of one id, by a
hash of the text and the row's place in the input, so an id (or the null id) of any number of rows fills many parts. A
task writes three flat little-endian files: ``.bin`` (token ids, uint16 where the vocabulary allows, else uint32),
``.idx`` (int64, number of documents + 1 offsets from the part's start) and ``.ids`` (int64 document ids, with
``.nul``, a byte each, for null ids). The driver gets one row a part, in the order of partitions, and turns their token
counts into bases by prefix sums; part base + local offset is a document's place in the whole corpus. The manifest
lists the parts and their bases. Reading maps the files where their file system is mounted; elsewhere it reads ranges.

A task names its files after its attempt, and the manifest holds only files that a finished task reported, so a lost
executor or a second attempt leaves nothing wrong behind.

Texts are encoded whole, through the tokenizers library. For its byte-level splitter they are first cut where a new
pre-token begins whatever stands around (see ``cuts``); the library encodes each different cut of a batch that a worker
does not remember, and the rest is lookup. Runs of Latin letters go to the library's merge model many at a time, behind
a space or line break each, which no token has after a letter. Texts with white space beyond ASCII or with the string
of an added token, and all texts under another splitter, are given to the library in one piece.

Defined results: a null text is an empty one, and still gets its end id. Null ids come first. Rows that repeat an id
stay separate documents, ordered by a hash of their text. A very long text is a batch of its own. Empty input writes a
manifest without parts and reads back as an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.storage import bounded_batches
from quarry.llm.textscan import column_bytes
from quarry.llm.units import Remembered, gathered, grouped, tiled

END_ID = 0
#: Cuts that a worker remembers; cuts that go to the merge model at a time; tokens that are read at a time.
REMEMBERED, JOINED, READ_TOKENS = 600_000, 100, 2_000_000
#: Bytes of text that are encoded at a time, besides a batch.
ENCODE_BYTES = 8 << 20
#: A run of Latin letters, and white space beyond ASCII's.
LATIN = "^ ?[A-Za-zÀ-ÖØ-öø-ɏ]+$"
ODD_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Kinds of bytes.
OTHER, BREAK, SPACE, LETTER, DIGIT, SIGN, QUOTE = range(7)

_KIND = np.full(256, OTHER, np.uint8)
_KIND[9:14], _KIND[32], _KIND[33:127] = BREAK, SPACE, SIGN
_KIND[48:58], _KIND[39] = DIGIT, QUOTE
_KIND[65:91] = _KIND[97:123] = LETTER
_CUT = np.zeros((7, 7), bool)
_CUT[[OTHER, LETTER, DIGIT, SIGN, QUOTE], BREAK] = _CUT[[OTHER, LETTER, DIGIT, SIGN, QUOTE], SPACE] = True
_CUT[LETTER, [DIGIT, SIGN, QUOTE]] = _CUT[DIGIT, [LETTER, SIGN, QUOTE]] = _CUT[SIGN, [LETTER, DIGIT]] = True


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = path[5:]
        path = "/" + path.lstrip("/")
    return (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> None:
    fs, local = place(path)
    fs.create_dir(os.path.dirname(local), recursive=True)
    with fs.open_output_stream(local) as out:
        out.write(data)


class Values:
    """A file of numbers: mapped where the file system is mounted, else read by ranges."""

    def __init__(self, path: str, kind: str):
        self.kind = np.dtype(kind)
        fs, local = place(path)
        self.mapped = isinstance(fs, pafs.LocalFileSystem)
        if self.mapped:
            self.values = np.memmap(local, self.kind, "r") if os.path.getsize(local) else np.empty(0, self.kind)
        else:
            self.file = fs.open_input_file(local)
            self.many = self.file.size() // self.kind.itemsize

    def __len__(self) -> int:
        return len(self.values) if self.mapped else self.many

    def read(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = len(self) if hi is None else hi
        return self.values[lo:hi] if self.mapped else np.frombuffer(self.file.read_at((hi - lo) * self.kind.itemsize, lo * self.kind.itemsize), self.kind)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the cuts of UTF-8 texts begin: places at which the byte-level splitter begins a new pre-token, and before
    and after which it does the same without the rest of the text.

    A run of white space belongs to nothing before it. In front of a word its last character stands alone, or with the
    word if it is a space; the others are one pre-token, as a run at a text's end is. Letters, digits and signs follow
    one another in different pre-tokens. An apostrophe may take letters behind it, so it is not parted from them.
    """
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))  # À to ɏ, but for the two signs among them
    lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]
    kind[lead] = kind[lead + 1] = LETTER
    first = offsets[:-1][np.diff(offsets) > 0]
    begins = np.zeros(len(data), bool)
    begins[1:] = _CUT[kind[:-1], kind[1:]]
    blank = (kind == BREAK) | (kind == SPACE)
    before = blank[:-1] & ~blank[1:]
    before[first[1:] - 1] = False
    before = np.flatnonzero(before)
    begins[before] = True
    begins[before[kind[before] == BREAK] + 1] = True
    begins[first] = True
    return np.flatnonzero(begins)


class TextEncoder:
    """Token ids of whole texts through the tokenizers library."""

    def __init__(self, spec: str, kind: str, end: int):
        """spec: a tokenizer's file."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.end = Tokenizer.from_str(spec), np.dtype(kind), end
        self.model, self.known = self.tokenizer.model, Remembered(REMEMBERED, self.kind)
        parts = json.loads(spec)
        split, model = parts["pre_tokenizer"] or {}, parts["model"]
        own = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        plain = parts["normalizer"] is None and not parts.get("truncation") and not parts.get("padding")
        self.bytewise = plain and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.added = [t["content"] for t in parts["added_tokens"]]
        # bytes that print are shown as their Latin-1 characters, the others in turn as those from 256 on
        prints = [33 <= c <= 126 or 161 <= c <= 172 or 174 <= c for c in range(256)]
        self.shown = {c: chr(c) if prints[c] else chr(256 + c - sum(prints[:c])) for c in range(256)}
        self.space, self.line = self.shown[32], self.shown[10]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token[0] in (self.space, self.line)]] = True
        # runs of letters may stand in one text if no merge crosses the space or line break between them
        letters = {self.shown[c] for c in (*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA))}
        self.joins = model["type"] == "BPE" and own
        for pair in model["merges"] if self.joins else ():
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            after = right[0] in (self.space, self.line) and left[-1] in letters and letters.issuperset(left[1:])
            self.joins &= not after and not (left[-1] == self.line and right[0] in letters)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text by itself, and how many it has."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in lists for i in x], self.kind), np.array([len(x) for x in lists], np.int64)

    def letters(self, texts: list[str], mark: str) -> tuple[np.ndarray, np.ndarray]:
        """As ids, for runs of letters: with a space in front, or without (mark: a line break to put there)."""
        found: list[int] = []
        for lo in range(0, len(texts), JOINED):
            text = mark + mark.join(texts[lo : lo + JOINED])
            shown = text.replace(" ", self.space).replace("\n", self.line) if text.isascii() else text.encode().decode("latin-1").translate(self.shown)
            found += [t.id for t in self.model.tokenize(shown)]
        ids = np.array(found, self.kind)
        first = np.flatnonzero(self.begins[ids])
        sizes = np.diff(np.append(first, len(ids)))
        return (np.delete(ids, first), sizes - 1) if mark else (ids, sizes)

    def work_out(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        strings = strings.cast(pa.string())
        run = np.asarray(pc.match_substring_regex(strings, LATIN)) & self.joins
        spaced = np.asarray(pc.starts_with(strings, " "))
        order, ids, sizes = [], [], []
        for some, encode in ((run & spaced, lambda x: self.letters(x, "")), (run & ~spaced, lambda x: self.letters(x, "\n")), (~run, self.ids)):
            if some.any():
                order.append(np.flatnonzero(some))
                found = encode(strings.filter(pa.array(some)).to_pylist())
                ids.append(found[0])
                sizes.append(found[1])
        ids, sizes, back = np.concatenate(ids), np.concatenate(sizes), np.argsort(np.concatenate(order))
        return ids[gathered((np.cumsum(sizes) - sizes)[back], sizes[back])], sizes[back]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and how many each has."""
        whole = np.full(len(texts), not self.bytewise)
        if self.bytewise:
            whole |= np.asarray(pc.match_substring_regex(texts, ODD_SPACE))
            for string in self.added:
                whole |= np.asarray(pc.match_substring(texts, string))
        data, offsets, _ = column_bytes(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        ids, sizes = np.empty(0, self.kind), np.zeros(len(texts), np.int64)
        if len(data):
            starts = cuts(data, offsets)
            coded = tiled(data, starts).dictionary_encode()
            ids, many = self.known.joined(self.known.find(coded.dictionary, self.work_out)[np.asarray(coded.indices)])
            sizes = np.diff(np.concatenate([[0], np.cumsum(many)])[np.searchsorted(starts, offsets)])
        at = np.flatnonzero(whole)
        apart, apart_sizes = self.ids(texts.filter(pa.array(whole)).to_pylist()) if len(at) else (ids[:0], sizes[:0])
        totals = sizes + 1
        totals[at] += apart_sizes
        stops = np.cumsum(totals)
        out = np.full(stops[-1] if len(stops) else 0, self.end, self.kind)
        out[gathered(stops - totals, sizes)] = ids
        out[gathered((stops - totals)[at], apart_sizes)] = apart
        return out, totals


_encoders: dict[tuple[str, str, int], TextEncoder] = {}


def _write(folder: str, spec: str, kind: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (spec, kind, end)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = TextEncoder(*key)
        encoder = _encoders[key]
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        offsets, ids = [np.zeros(1, np.int64)], []
        out, at = None, 0
        for batch in grouped(batches, ENCODE_BYTES):
            if out is None:
                fs, local = place(name)
                fs.create_dir(os.path.dirname(local), recursive=True)
                out = fs.open_output_stream(local + ".bin")
            tokens, sizes = encoder.encode(batch.column("text").fill_null(""))
            out.write(tokens.data)
            offsets.append(at + np.cumsum(sizes))
            at += len(tokens)
            ids.append(batch.column("doc_id"))
        if out is None:
            return
        out.close()
        doc_ids = pa.chunked_array(ids)
        write_file(name + ".idx", np.concatenate(offsets).astype("<i8").tobytes())
        write_file(name + ".ids", np.asarray(doc_ids.fill_null(0)).astype("<i8").tobytes())
        write_file(name + ".nul", np.asarray(doc_ids.is_null()).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([task.partitionId()], pa.int32()), pa.array([len(doc_ids)]), pa.array([at])], names=["file", "part", "n_docs", "n_tokens"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Write the files below folder and return the manifest. tokenizer: a path that the driver can read."""
    from tokenizers import Tokenizer

    bounded_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    kind = "<u2" if max(Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True), end + 1) <= 1 << 16 else "<u4"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumns({"mark": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange("doc_id", "mark", "at").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    parts = dealt.mapInArrow(_write(folder, spec, kind, end), "file string, part int, n_docs long, n_tokens long").collect()  # one row a part
    parts = sorted(parts, key=lambda r: r["part"])
    bases = np.concatenate([[0], np.cumsum([r["n_tokens"] for r in parts])]).astype(int).tolist() if parts else [0]
    manifest = {"dtype": kind, "end_id": end, "n_tokens": bases[-1], "parts": [{"file": r["file"], "base": b, "n_docs": r["n_docs"], "n_tokens": r["n_tokens"]} for r, b in zip(parts, bases, strict=False)]}
    write_file(f"{folder}/manifest.json", json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    fs, local = place(f"{folder}/manifest.json")
    with fs.open_input_file(local) as f:
        return json.loads(f.read())


def _read(kind: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                name, base = part["file"], part["base"]
                offsets, ids, null = (Values(name + x, k).read() for x, k in ((".idx", "<i8"), (".ids", "<i8"), (".nul", "u1")))
                tokens, lo = Values(name + ".bin", kind), 0
                while lo < len(ids):
                    hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + READ_TOKENS, "right")) - 1)
                    hi = min(hi, len(ids))
                    edges = offsets[lo : hi + 1] - offsets[lo]
                    some = tokens.read(int(offsets[lo]), int(offsets[hi])).astype("<u4")
                    raw, cut = memoryview(some).cast("B"), (4 * edges).tolist()
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    out = [pa.array(np.array(ids[lo:hi], np.int64), mask=np.array(null[lo:hi], bool)), pa.array(base + offsets[lo:hi]), pa.array(np.diff(edges)), pa.array(crc, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        out.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(some.astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(out, names=names)
                    lo = hi

    return run


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """A row a document, from the files: doc_id, start, n_tokens, ids_crc32, and its ids if wanted."""
    manifest = read_manifest(folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    parts = [(p["file"], p["base"]) for p in manifest["parts"]]
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(parts, "file string, base long").repartition(len(parts)).mapInArrow(_read(manifest["dtype"], with_ids), schema)
