"""Quality rules: compression bands.

Every whole text is compressed with zstandard, and so is each of its fixed chunks; where a remainder is left, the last
chunk is the end of the text, so every byte of a text of a chunk or more lies in a judged one. A shorter text is its own
chunk, judged as a whole. Repetitive text compresses too well, incompressible text (keys, encoded data) hardly at all;
both limits lie close to the ratios of running prose and depend on the length, as a longer text compresses better. All
lengths have limits. The base counts (words, symbols, repeated lines and windows) are exact and come first.

Defined results: a null or empty text has no words and fails the base rule. Every row is judged by itself, so ties,
repeated rows and very long texts need nothing special. A null id is carried as null. Empty input gives an empty
result. Only the id and text columns are read; names of other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.storage import bounded_batches
from quarry.llm.textscan import Words, chunks, column_bytes

#: Robust deviations between the reference's prose and a limit.
MARGIN = 5
#: Ratio limits (lowest, highest) of a whole text of 2 ** k bytes by k, with straight lines in k between; shorter texts
#: than the first, which all fail the base rule, and longer ones than the last have the limits of these. From 8 to 15
#: they are whole_limits() over all documents at sf0.1 that pass the base rule; the lowest also allows for
#: two_languages() of them, which compress less. Beyond, where that table has six texts, the lowest stays and the
#: highest goes on at its last slope. Below, where it has none, they are whole_limits() over short_cuts() of them.
WHOLE = {
    6: (0.665, 1.187), 7: (1.002, 1.462),
    8: (1.14, 1.755), 9: (1.323, 1.846), 10: (1.584, 2.049), 11: (1.765, 2.189), 12: (1.92, 2.291), 13: (2.028, 2.401), 14: (2.035, 2.493),
    15: (2.11, 2.581), 16: (2.11, 2.669), 17: (2.11, 2.757), 18: (2.11, 2.845), 19: (2.11, 2.933), 20: (2.11, 3.021),
}
_BITS, _LEAST, _MOST = np.array([(k, *v) for k, v in WHOLE.items()]).T
#: Bytes of a chunk, and the limits of a full one: chunk_limits() over the same documents, likewise.
CHUNK, CHUNK_LIMITS = 4096, (1.919, 2.305)
LEVEL = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, chunk_low double, chunk_high double, base_failed boolean, kept boolean"


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def repeated_words(words: Words, size: int = 3) -> np.ndarray:
    """By row: words that lie in a window of size words found twice or more in the row."""
    hashes, at = words.windows(words.hashes(), size)
    keyed = hashes + words.row[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    order = np.argsort(keyed)
    same = np.zeros(len(keyed), bool)
    if len(keyed) > 1:
        equal = keyed[order][1:] == keyed[order][:-1]
        same[order[1:]] |= equal
        same[order[:-1]] |= equal
    covered = np.zeros(len(words.row), bool)
    for i in range(size):
        covered[at[same] + i] = True
    return np.bincount(words.row[covered], minlength=words.rows)


def band_verdict(size: int, ratio: float, low: float, high: float) -> bool:
    """Whether the ratios of the whole text and of its chunks lie within their limits."""
    least, most = (np.interp(np.log2(max(size, 1)), _BITS, limit) for limit in (_LEAST, _MOST))
    return bool(least <= ratio <= most) and (low != low or (low >= CHUNK_LIMITS[0] and high <= CHUNK_LIMITS[1]))


def two_languages(texts: list[bytes], languages: list[str]) -> list[bytes]:
    """Texts of which one half is in one language and the other in another: every text with the next longer one of another."""
    order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), texts[i]))
    other: dict[str, int] = {}
    out = []
    for i in reversed(order):
        j = min((at for x, at in other.items() if x != languages[i]), key=lambda at: len(texts[at]), default=None)
        if j is not None:
            half = len(texts[i]) // 2
            out.append(texts[i][:half] + texts[j][:half])
        other[languages[i]] = i
    return out


def short_cuts(texts: list[bytes]) -> list[bytes]:
    """The beginnings of texts, of 64 to 256 bytes by a hash."""
    return [t[: 64 + zlib.crc32(t) % 193] for t in texts]


def whole_limits(sizes: np.ndarray, ratios: np.ndarray, languages: np.ndarray, knots: range = range(8, 16)) -> dict[int, tuple[float, float]]:
    """WHOLE from a corpus: by language a line of least absolute deviations over log2 of the length, bent at the knots.

    The limits lie MARGIN robust deviations (1.4826 times the median absolute one, by knot) below the lowest line and
    above the highest. Medians bear a minority of faulty texts, so no labels are needed.
    """
    at = np.clip(np.log2(sizes), knots[0], knots[-1])
    shape = np.stack([np.interp(at, knots, row) for row in np.eye(len(knots))], 1)
    bend = 0.03 * np.diff(np.eye(len(knots)), 2, axis=0)  # carries a line on where a language has no text
    away, lines = np.empty(len(sizes)), []
    for language in np.unique(languages):
        own = languages == language
        x, y, weight = shape[own], ratios[own], np.ones(own.sum())
        for _ in range(60):
            root = np.sqrt(weight)
            line = np.linalg.lstsq(np.vstack([x * root[:, None], bend]), np.r_[y * root, np.zeros(len(bend))])[0]
            weight = 1 / np.maximum(np.abs(y - x @ line), 1e-3)
            weight /= weight.max()
        away[own] = np.abs(y - x @ line)
        lines.append(line)
    octave = np.minimum(at.astype(int), knots[-2])  # the last knot has the deviation of the octave below it
    spread = np.array([1.4826 * np.median(away[octave == min(k, knots[-2])]) for k in knots])
    low, high = np.min(lines, 0) - MARGIN * spread, np.max(lines, 0) + MARGIN * spread
    return {k: (round(float(a), 3), round(float(b), 3)) for k, a, b in zip(knots, low, high, strict=True)}


def chunk_limits(ratios: np.ndarray, languages: np.ndarray) -> tuple[float, float]:
    """CHUNK_LIMITS from the ratios of full chunks, as whole_limits without the length."""
    middle = {x: np.median(ratios[languages == x]) for x in np.unique(languages)}
    spread = 1.4826 * np.median(np.abs(ratios - np.array([middle[x] for x in languages])))
    return round(float(min(middle.values()) - MARGIN * spread), 3), round(float(max(middle.values()) + MARGIN * spread), 3)


def ratios(text: bytes, zstd: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """(whole, lowest of chunks, highest of chunks); nan where there is none. A remainder is judged in the last CHUNK bytes."""
    if not text:
        return float("nan"), float("nan"), float("nan")
    whole = len(text) / len(zstd.compress(text))
    starts = [*range(0, len(text) - CHUNK + 1, CHUNK)]
    if starts and len(text) % CHUNK:
        starts.append(len(text) - CHUNK)
    each = [CHUNK / len(zstd.compress(text[i : i + CHUNK])) for i in starts]
    return whole, min(each, default=float("nan")), max(each, default=float("nan"))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zstd = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        data, offsets, _ = column_bytes(batch.column("text"))
        for lo, hi in chunks(offsets):
            words = Words(data, offsets, lo, hi)
            n, edges, raw = words.counts.astype(np.int64), words.edges, words.bytes
            total = np.zeros((2, len(raw) + 1), np.int64)
            np.cumsum(~words.space & ((raw & 0xC0) != 0x80), out=total[0, 1:])
            np.cumsum(_SYMBOL[raw], out=total[1, 1:])
            chars, symbols = total[:, edges[1:]] - total[:, edges[:-1]]
            repeats = repeated_words(words)
            texts = [raw[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            found = [ratios(t, zstd) for t in texts]
            failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
            kept = [not f and band_verdict(len(t), *r) for f, t, r in zip(failed, texts, found, strict=True)]
            whole, low, high = (pa.array(np.array(x), pa.float64(), from_pandas=True) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(chars), pa.array(symbols), pa.array([duplicate_lines(t) for t in texts], pa.int64()), pa.array(repeats.astype(np.int64)), whole, low, high, pa.array(failed), pa.array(kept, pa.bool_())],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document with its counts, ratios and verdict."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(_judge, SCHEMA)


def _passing(index: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(index).cast(pa.binary())
            rows = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts], names=["doc_id", "text"])
            verdicts = [v for out in _judge(iter([rows])) for v in out.column("kept").to_pylist()]
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    return keep


def passing_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, whole, whose text is kept; one pass without a shuffle."""
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(_passing(docs.columns.index(text)), docs.schema)
