"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

The model is fitted in one task on a bounded sample (``FIT_ROWS`` labelled rows, those with the
smallest hash of their id), so its cost does not grow with the corpus; every text is scored as a
sparse dot product. A second word equal to the first counts as a repeat mark, so repetition shows
in the n-grams whatever the word is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import batch_of, documents, map_batches

BITS = 18
#: Bound of the labelled rows that the model is fitted on.
FIT_ROWS = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.0005, 0.01
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_CACHE_WORDS = 200_000


class Features:
    """Sparse vectors of texts: square roots of n-gram shares, so each vector has length one."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = _WORD.findall(text)
        if not words:
            return np.zeros(1, dtype=np.int64), np.ones(1)
        ids = self.ids
        if len(ids) > _CACHE_WORDS:
            ids.clear()
        for w in set(words).difference(ids):
            ids[w] = zlib.crc32(w.encode("utf-8", "replace"))
        one = np.fromiter(map(ids.__getitem__, words), dtype=np.uint64, count=len(words))
        second = np.where(one[1:] == one[:-1], np.uint64(7), one[1:])
        first = np.where(one[1:] == one[:-1], np.uint64(7), one[:-1])
        two = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
        grams = np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), two])
        where, n = np.unique((grams >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        return where, np.sqrt(n / len(grams))


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of FTRL-proximal logistic regression; the bias is the last weight."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    bias = np.array([1 << BITS])
    for _ in range(epochs):
        for where, x, y in rows:
            i, v = np.concatenate([where, bias]), np.append(x, 1.0)
            w = weights(i)
            g = (sigmoid(w @ v) - y) * v
            grown = np.sqrt(n[i] + g * g)
            z[i] += g - (grown - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(slice(None)).astype(np.float32)


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text is divisible by five (null: held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> np.ndarray:
    """Fit on at most ``rows`` labelled documents outside the held-out fold.

    A document with several labels counts with the lowest; null labels and ids are left out. With
    no usable label the weights are zero (every score one half).
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    labels = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
    chosen = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = documents(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")  # at most `rows` of 12 bytes

    def vectors(batch: pa.RecordBatch):
        make, where, value = Features(), [], []
        for t in batch.column("text"):
            w, x = make(t.as_py())
            where.append(w.astype("<i4").tobytes())
            value.append(x.astype("<f4").tobytes())
        yield batch_of(["doc_id", "quality", "w", "x"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()], [batch.column("doc_id"), batch.column("quality"), where, value])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = {}
        for b in batches:
            for i, y, w, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "quality", "w", "x")), strict=True):
                read[(zlib.crc32(str(i).encode()), i, zlib.crc32(w))] = (np.frombuffer(w, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float), y)
        weights = fit([read[k] for k in sorted(read)]) if read else np.zeros((1 << BITS) + 1, dtype=np.float32)
        yield batch_of(["weights"], [pa.binary()], [[weights.astype("<f4").tobytes()]])

    made = map_batches(sample, vectors, "doc_id long, quality int, w binary, x binary")
    out = made.repartition(1).mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(out[0]["weights"], "<f4") if out else np.zeros((1 << BITS) + 1, dtype=np.float32)


def scorer(weights: np.ndarray):
    """Function from a text to its score."""
    make, w, bias = Features(), weights[:-1].astype(float), float(weights[-1])

    def score(text: str) -> float:
        where, x = make(text)
        return sigmoid(w[where] @ x + bias)

    return score


def scores(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; null text counts as empty.

    A null ``doc_id`` stays null and counts as held out; repeated rows each give a row; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch):
        score = scorer(weights)
        yield batch_of(["doc_id", "score"], [pa.int64(), pa.float64()], [batch.column("doc_id"), [score(t.as_py()) for t in batch.column("text")]])

    out = map_batches(documents(docs), run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns."""
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch):
        score = scorer(weights)
        yield batch.filter(pa.array([score(t.as_py() or "") >= threshold for t in batch.column(at)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
