"""Language identification by nearest centroids.

A text is a vector of hashed byte n-grams (2 and 3 bytes of the lower-cased text, anything but letters folded to
spaces): square roots of counts times inverse document frequencies, of length 1. Each language has several centroids,
from spherical k-means over its own vectors. A text gets the language of the centroid with the greatest cosine; where
that cosine is below the language's limit, the text is rejected: it is far from everything that was learned. The limit
falls with the root of the number of n-grams below FULL, as the cosine of a short text to any dense centroid does.

Document frequencies come from every training row; centroids are fitted on at most about SAMPLE rows a language, drawn
by a hash of the id, and the vectors of one language meet in one task: SAMPLE times 16 KB whatever the corpus. What
reaches the driver is one number a feature and CLUSTERS centroids a language.

Training rows have an id with crc32 mod FOLDS other than 0, a language and a text with a letter. Prediction sees
nothing but text.

Defined results: a text that is null or has no letter is ``und`` with score 0, and rejected. Ties go to the centroid
that comes first by language and number. Without training rows every text is ``und``, rejected. A null id is never a
training row and not held out. Rows are judged apart; very long texts are scanned whole, alone. Empty input gives an
empty result. Only the id, text and language columns are read; ``accepted_documents`` carries all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.byte_features import hashed_rows
from quarry.llm.storage import bounded_batches, small

#: One id in FOLDS is held out; bits of a feature; rows sampled and centroids for each language; k-means rounds.
FOLDS, BITS, SAMPLE, CLUSTERS, ROUNDS = 5, 12, 400, 4, 12
#: A language's limit: this part of the cosine that all but FEW of its sample reach.
SLACK, FEW = 0.5, 0.01
#: N-grams from which a text has to reach the limit itself.
FULL = 512
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 0x20


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def _counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """A vector of n-gram counts for each row."""
    for codes in hashed_rows(pc.utf8_lower(texts), (2, 3), BITS, _FOLD):
        yield np.bincount(codes, minlength=1 << BITS)


def has_letter(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a task's rows; feature -1 has the number of rows."""
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for counts in _counts(batch.column("text")):
            df += counts > 0
            n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at]).astype(np.int32)), pa.array(np.concatenate([[n], df[at]]))], names=["feature", "n"])


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    limits: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each row."""
        letters, n = has_letter(texts), len(texts)
        languages, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        if not len(self.centroids):
            return languages, score, rejected
        for i, counts in enumerate(_counts(texts)):
            if not letters[i]:
                continue
            v = np.sqrt(counts) * self.idf
            length = np.sqrt(v @ v)
            if not length:
                v, length = np.sqrt(counts), np.sqrt(counts.sum())
            cosines = self.centroids @ (v / max(length, 1e-12))
            best = int(cosines.argmax())
            languages[i], score[i] = self.languages[best], min(1.0, max(0.0, float(cosines[best])))
            rejected[i] = score[i] < self.limits[best] * min(1.0, np.sqrt(counts.sum() / FULL))
        return languages, score, rejected


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], []
            for counts in _counts(batch.column("text")):
                n.append(max(1, int(counts.sum())))
                v = np.sqrt(counts) * idf
                out.append((v / max(np.sqrt(v @ v), 1e-12)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(out, pa.binary())], names=["lang", "doc_id", "n", "vector"])

    return run


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, each row's cosine to its own). Starts from the mean, then from the farthest rows."""
    mean = v.mean(axis=0)
    centres = [v[int((v @ mean).argmax())]]
    while len(centres) < min(k, len(v)):
        close = np.max(v @ np.stack(centres).T, axis=1)
        centres.append(v[int(close.argmin())])
    c = np.stack(centres)
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        sums = np.stack([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c, (v @ c.T).max(axis=1)


def _fit_language(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "vector"], kind="stable")
    v = np.stack([np.frombuffer(x, "<f4") for x in rows["vector"]]).astype(np.float64)
    centroids, cosine = spherical_kmeans(v, CLUSTERS)
    expected = np.minimum(1.0, np.sqrt(rows["n"].to_numpy() / FULL))
    limit = SLACK * float(np.quantile(cosine / expected, FEW))
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "cluster": range(len(centroids)), "vector": [c.astype("<f4").tobytes() for c in centroids], "limit": limit})


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    found = {r["feature"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    n, df = found.pop(-1, 0), np.zeros(1 << BITS)
    df[list(found)] = list(found.values())
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    if not n:
        return Model(idf, np.empty((0, 1 << BITS)), [], np.empty(0))
    shares = rows.groupBy("lang").agg((F.lit(float(SAMPLE)) / F.count("*")).alias("share"))
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(small(shares), "lang").where(uniform < F.col("share")).select("lang", F.col("doc_id").cast("string").alias("doc_id"), "text")
    fitted = sample.mapInArrow(_vectors(idf), "lang string, doc_id string, n long, vector binary").groupBy("lang").applyInPandas(_fit_language, "lang string, cluster int, vector binary, limit double")
    parts = sorted(fitted.collect(), key=lambda r: (r["lang"], r["cluster"]))  # CLUSTERS a language
    return Model(idf, np.stack([np.frombuffer(r["vector"], "<f4") for r in parts]).astype(np.float64), [r["lang"] for r in parts], np.array([r["limit"] for r in parts]))


def identify(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, rejected."""
    bounded_batches(docs.sparkSession)
    model = model or fit(docs, doc_id, text, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, score, rejected = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(languages, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted_documents(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """The rows of docs, whole, whose text is near a learned language."""
    bounded_batches(docs.sparkSession)
    model, index = model or fit(docs, text=text), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~model.predict(batch.column(index))[2]))

    return docs.mapInArrow(run, docs.schema)
