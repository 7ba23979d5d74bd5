"""Quality classifier: weak labels whose accuracies are estimated, then a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on each text; they overlap, so that each kind of fault (noise, repetition)
is seen by two or more of them. The latent classes are good and one for each kind of fault. Accuracies are not given: expectation-maximisation
over the counts of vote patterns estimates, for each labeller and class, how often it votes what. Patterns are at most
3 ** labellers whatever the corpus, counted over all documents, so this runs on the driver. Each pattern's posterior
then labels documents for a logistic scorer over hashed byte trigrams (letter case kept), which judges every document.

The scorer is fitted on about SAMPLE documents, drawn by a hash of the id; the sample's features are what reaches the
driver. A document is kept unless the scorer puts it below THRESHOLD.

Defined results: a text that is null or has no word has score 0 and is not kept. Rows are judged apart: repeated rows
get equal scores; very long texts are scanned whole, alone. A null id is drawn by its text. If all patterns fall in one
class, or nothing is sampled, the posterior alone decides. Empty input gives an empty result. Only the id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.byte_features import hashed_rows
from quarry.llm.quality_rules import duplicate_lines, repeated_words
from quarry.llm.storage import bounded_batches
from quarry.llm.textscan import Words, chunks, column_bytes

BITS, SAMPLE, THRESHOLD = 14, 3000, 0.5
ROUNDS, STEPS, RATE, DECAY = 100, 150, 4.0, 1e-5
#: A labeller's name, the limits of what it measures (bad from the second on, good up to the first), and the class that
#: its vote against a text speaks for; class 0 is good.
NOISE, REPETITION, CLASSES = 1, 2, 3
LABELLERS = (
    ("symbols_per_word", 0.03, 0.1, NOISE),
    ("upper_case_share", 0.2, 0.5, NOISE),
    ("exclamations_per_word", 0.05, 0.2, NOISE),
    ("repeated_window_share", 0.1, 0.3, REPETITION),
    ("repeated_neighbour_share", 0.03, 0.1, REPETITION),
    ("duplicate_line_share", 0.05, 0.3, REPETITION),
    ("digits_per_letter", 0.1, 0.3, NOISE),
    ("open_line_share", 0.5, 0.9, NOISE),
    ("other_byte_share", 0.08, 0.15, NOISE),
    ("odd_ending_share", 0.1, 0.3, NOISE),
)
BAD, NONE, GOOD = 0, 1, 2

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_KIND = np.zeros((4, 256), np.int64)
_KIND[0, list(b"#*$%&|<>")] = 1
_KIND[1, list(b"!")] = 1
_KIND[2, 65:91] = 1
_KIND[3, 48:58] = 1
_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = 1
#: Bytes of words that are neither letters nor beyond ASCII; endings of words that running text has.
_OTHER = np.zeros(256, np.int64)
_OTHER[33:127] = 1 - _LETTER[33:127]
_PLAIN = np.ones(256, bool)
_PLAIN[33:127] = False
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *b".,;:?)\x22\x27"]] = True


def measure(column: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of rows by labellers: what each labeller measures, nan where it cannot; and the words of each row last."""
    data, offsets, _ = column_bytes(column)
    for lo, hi in chunks(offsets):
        words = Words(data, offsets, lo, hi)
        edges, raw, n = words.edges, words.bytes, words.counts.astype(np.float64)

        def total(flags: np.ndarray, raw=raw, edges=edges) -> np.ndarray:
            sums = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(flags[raw], out=sums[1:])
            return (sums[edges[1:]] - sums[edges[:-1]]).astype(np.float64)

        symbols, marks, upper, digits = (total(k) for k in _KIND)
        letters = total(_LETTER)
        in_words = total((~_IS_SPACE).astype(np.int64))
        other = total(_OTHER)
        odd = np.bincount(words.row[~_PLAIN[raw[words.ends - 1]]], minlength=words.rows) if len(words.ends) else np.zeros(words.rows)
        hashes = words.hashes()
        same = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1]) if len(hashes) > 1 else np.empty(0, bool)
        neighbours = np.bincount(words.row[1:][same], minlength=words.rows) if len(same) else np.zeros(words.rows)
        lines, copies, loose = np.zeros(words.rows), np.zeros(words.rows), np.zeros(words.rows)
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            text = raw[a:b].tobytes()
            each = [x for line in text.split(b"\n") if (x := line.rstrip())]
            lines[i], copies[i] = len(each), duplicate_lines(text)
            loose[i] = sum(x[-1:] not in b'.!?:;"\x27)' for x in each)
        with np.errstate(divide="ignore", invalid="ignore"):
            values = [symbols / n, upper / letters, marks / n, repeated_words(words) / n, neighbours / n, copies / lines, digits / letters, loose / lines, other / in_words, odd / n]
        yield np.where(np.isfinite(np.stack([*values, n], 1)), np.stack([*values, n], 1), np.nan)


def votes(values: np.ndarray) -> np.ndarray:
    out = np.full((len(values), len(LABELLERS)), NONE)
    for j, (_, good, bad, _) in enumerate(LABELLERS):
        out[values[:, j] <= good, j] = GOOD
        out[values[:, j] >= bad, j] = BAD
    return out


def pattern_of(voted: np.ndarray) -> np.ndarray:
    return voted @ 3 ** np.arange(len(LABELLERS))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(3 ** len(LABELLERS), np.int64)
    for batch in batches:
        for values in measure(batch.column("text")):
            voted = votes(values)[values[:, -1] > 0]
            counts += np.bincount(pattern_of(voted), minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["pattern", "n"])


@dataclass
class LabelModel:
    """posterior: P(good) by pattern; table: P(vote | class), by labeller, class and vote; share: of each class."""

    posterior: np.ndarray
    table: np.ndarray
    share: np.ndarray


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over vote patterns, from majority votes on."""
    k = len(LABELLERS)
    powers = 3 ** np.arange(k)
    seen = patterns[:, None] // powers % 3
    n = counts.astype(np.float64)
    # a document is at first good unless somebody says bad: heuristics look for different faults
    kind = np.array([c for _, _, _, c in LABELLERS])
    says = np.stack([(seen[:, kind == c] == BAD).sum(axis=1) for c in range(CLASSES)], 1)
    against = says.sum(axis=1, keepdims=True)
    belief = 0.9 * np.where(against > 0, says / np.maximum(against, 1), [1.0] + [0.0] * (CLASSES - 1)) + 0.1 / CLASSES
    table, share = np.full((k, CLASSES, 3), 1 / 3), np.full(CLASSES, 1 / CLASSES)

    def posterior(voted: np.ndarray) -> np.ndarray:
        log = np.log(share)[None] + sum(np.log(table[j].T[voted[:, j]]) for j in range(k))
        out = np.exp(log - log.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)

    for _ in range(rounds):
        mass = (n[:, None] * belief).T
        share = (mass.sum(axis=1) + 1) / (n.sum() + CLASSES)
        for v in (BAD, NONE, GOOD):
            table[:, :, v] = (mass @ (seen == v)).T + 1
        table /= table.sum(axis=2, keepdims=True)
        before, belief = belief, posterior(seen)
        if np.abs(belief - before).max(initial=0) < 1e-9:
            break
    return LabelModel(posterior(np.arange(3**k)[:, None] // powers % 3)[:, 0], table, share)


def accuracies(model: LabelModel) -> dict[str, float]:
    """How often each labeller is right where it votes, by the model itself."""
    out = {}
    for (name, *_), t in zip(LABELLERS, model.table, strict=True):
        right = model.share[0] * t[0, GOOD] + model.share[1:] @ t[1:, BAD]
        out[name] = float(right / (right + model.share[0] * t[0, BAD] + model.share[1:] @ t[1:, GOOD]))
    return out


def _features(codes: np.ndarray) -> np.ndarray:
    v = np.sqrt(np.bincount(codes, minlength=1 << BITS))
    return v / max(np.sqrt(len(codes)), 1.0)


def _sampled(posterior: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            values = np.concatenate([*measure(column), np.empty((0, len(LABELLERS) + 1))])
            target = posterior[pattern_of(votes(values))]
            rows = [_features(codes) for codes in hashed_rows(column, (3,), BITS)]
            at = [np.flatnonzero(v) for v in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(target), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([v[a].astype("<f4").tobytes() for v, a in zip(rows, at, strict=True)], pa.binary())], names=["key", "target", "at", "value"]
            ).filter(pa.array(values[:, -1] > 0))

    return run


def fit_scorer(rows: list) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic scorer from rows (target, at, value), both classes weighing the same."""
    target = np.array([r["target"] for r in rows])
    at = [np.frombuffer(r["at"], "<u2").astype(np.int64) for r in rows]
    n = np.array([len(a) for a in at])
    rows, target, at = [r for r, m in zip(rows, n, strict=True) if m], target[n > 0], [a for a in at if len(a)]
    if not rows:
        return np.zeros(1 << BITS), 0.0
    starts = np.concatenate([[0], np.cumsum([len(a) for a in at])[:-1]])
    col, own, value = np.concatenate(at), np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate([np.frombuffer(r["value"], "<f4") for r in rows]).astype(np.float64)
    mass = np.array([max(1e-9, (1 - target).sum()), max(1e-9, target.sum())])
    weigh = (1 - target) / mass[0] / 2 + target / mass[1] / 2
    goal = target / mass[1] / 2
    w, bias, ahead, ahead_bias = np.zeros(1 << BITS), 0.0, np.zeros(1 << BITS), 0.0
    for step in range(STEPS):  # accelerated full-batch gradient
        score = np.add.reduceat(value * ahead[col], starts) + ahead_bias
        gap = weigh / (1 + np.exp(-np.clip(score, -50, 50))) - goal
        w2 = ahead - RATE * (np.bincount(col, value * gap[own], 1 << BITS) + DECAY * ahead)
        b2 = ahead_bias - RATE * gap.sum()
        pull = step / (step + 3)
        ahead, ahead_bias = w2 + pull * (w2 - w), b2 + pull * (b2 - bias)
        w, bias = w2, b2
    return w, float(bias)


def _judge(posterior: np.ndarray, weights: np.ndarray | None, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            values = np.concatenate([*measure(column), np.empty((0, len(LABELLERS) + 1))])
            n = np.nan_to_num(values[:, -1]).astype(np.int64)
            weak = np.where(n > 0, posterior[pattern_of(votes(values))], 0.0)
            score = weak.copy()
            if weights is not None:
                raw = np.array([_features(codes) @ weights if len(codes) else np.nan for codes in hashed_rows(column, (3,), BITS)])
                score = np.where((n > 0) & np.isfinite(raw), 1 / (1 + np.exp(-np.clip(np.nan_to_num(raw) + bias, -50, 50))), weak)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(weak), pa.array(score), pa.array(score >= THRESHOLD)], names=["doc_id", "n_words", "weak_label", "score", "kept"])

    return run


def label_model(docs: DataFrame, text: str = "text") -> tuple[LabelModel, int]:
    """The label model, and the number of documents with a word."""
    found = docs.select(F.col(text).alias("text")).mapInArrow(_patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # 3 ** labellers at most
    patterns, counts = np.array([r["pattern"] for r in found], np.int64), np.array([r["n"] for r in found], np.int64)
    return estimate(patterns, counts), int(counts.sum())


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, weak_label, score, kept."""
    bounded_batches(docs.sparkSession)
    model, n = label_model(docs, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    key = F.coalesce(F.xxhash64("doc_id") + F.when(F.col("doc_id").isNotNull(), 0), F.xxhash64("text"))
    drawn = rows.withColumn("key", key).where(F.pmod("key", F.lit(1 << 30)) < F.lit(SAMPLE / max(1, n) * (1 << 30)))
    sample = sorted(drawn.select("key", "text").mapInArrow(_sampled(model.posterior), "key long, target double, at binary, value binary").collect(), key=lambda r: (r["key"], r["at"]))  # about SAMPLE rows
    both = min(sum(r["target"] >= 0.5 for r in sample), sum(r["target"] < 0.5 for r in sample)) > 0
    weights, bias = fit_scorer(sample) if both else (None, 0.0)
    return rows.mapInArrow(_judge(model.posterior, weights, bias), "doc_id long, n_words long, weak_label double, score double, kept boolean")
