"""Toxicity (operator 2): cumulative-link ordinal regression over sparse text features.

Grades run from 0 (clean) to 3 (severe): P(grade <= j) = logistic(threshold_j - w.x) with one weight
vector for all ordered thresholds. Labels only say toxic or not, so the training grades of toxic rows
are drawn from how often words stand in them that are found nearly only in toxic rows: up to the lower
third of the toxic rows it is grade 1, above the upper third 3. Features are the words (exact 64-bit
hashes, so that rare words cannot collide) that the sample ties to toxic rows; values are log(1 + times).
The expected severity is the mean grade under the model. Fitted on a bounded sample of labelled rows
(MAX_ROWS, MAX_WORDS), never on held-out ones; all texts are scored whole, long ones too. As the grades of the
sample restate how many toxic words a text holds, a severity says no more than that. Null and empty texts have no
features; without toxic training rows every text is clean. An id with several labels counts with the largest.
Repeated rows are scored and returned each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_arrow
from .quality import labelled_sample, sparse_rows
from .words import ITEM_BYTES, WordHashes, texts

MAX_ROWS = 20_000
GRADES = 4
#: A word becomes a feature if so many sampled rows have it and so large a share of them is toxic.
MIN_ROWS, MIN_SHARE = 4, 0.9
#: Features at most: of more words tied to toxicity the most frequent.
MAX_WORDS = 200_000


@dataclass
class Ordinal:
    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray
    cuts: np.ndarray  # ascending thresholds

    def expected(self, x: np.ndarray, at: np.ndarray) -> tuple[float, float]:
        """Expected grade, and the probability of any grade above 0."""
        above = 1 - _logistic(self.cuts - float(self.weights[at] @ x))
        return float(above.sum()), float(above[0])

    def features(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, times = np.unique(hashes, return_counts=True)
        if not len(self.vocabulary):
            return np.zeros(0), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == words
        return np.log1p(times[hit]), at[hit]


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], width: int, vocabulary: np.ndarray, steps: int = 500, rate: float = 0.5, decay: float = 1e-6) -> Ordinal:
    """Full-batch gradient descent with per-weight step sizes; cuts stay ordered as the first plus positive gaps."""
    w, first, gaps = np.zeros(width), 2.0, np.zeros(GRADES - 2)
    index = np.concatenate([np.full(len(a), i) for i, (_, a, _) in enumerate(rows)]) if rows else np.zeros(0, int)
    at = np.concatenate([a for _, a, _ in rows]).astype(int) if rows else index
    x = np.concatenate([v for v, _, _ in rows]) if rows else np.zeros(0)
    y, n = np.array([g for _, _, g in rows], dtype=int), max(1, len(rows))
    sums = [np.full(width, 1e-6), 1e-6, np.full(GRADES - 2, 1e-6)]
    for _ in range(steps if rows else 0):
        cuts = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        z = np.bincount(index, w[at] * x, len(rows))
        below = _logistic(np.concatenate([[-40], cuts, [40]])[None, :] - z[:, None])
        below[:, 0], below[:, -1] = 0, 1
        slope, rows_at = below * (1 - below), np.arange(len(rows))
        p = np.maximum(below[rows_at, y + 1] - below[rows_at, y], 1e-9)
        upper, lower = slope[rows_at, y + 1] / p, slope[rows_at, y] / p
        dz = upper - lower  # of the loss
        dcut = np.array([(lower[y == j + 1].sum() - upper[y == j].sum()) / n for j in range(GRADES - 1)])
        grads = [np.bincount(at, x * dz[index], width) / n + decay * w, dcut.sum(), np.exp(gaps) * dcut[::-1].cumsum()[::-1][1:]]
        for k, g in enumerate(grads):
            sums[k] = sums[k] + g * g
        w -= rate * grads[0] / np.sqrt(sums[0])
        first -= rate * grads[1] / np.sqrt(sums[1])
        gaps -= rate * grads[2] / np.sqrt(sums[2])
    return Ordinal(vocabulary, w, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> Ordinal:
    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in it:
            found = [cache.of(t.translate(ITEM_BYTES).split()).view(np.int64) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), batch.column(2)], ["doc_id", "words", "label"])

    spark = docs.sparkSession
    words = labelled_sample(docs, labels, "toxic", most).transform(map_arrow, extract, "doc_id long, words array<long>, label int")
    path = _kept(spark, words)
    rows = spark.read.parquet(path)
    one = rows.select("label", F.explode(F.array_distinct("words")).alias("word"))
    tied = one.groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).where((F.col("n") >= MIN_ROWS) & (F.col("toxic") >= MIN_SHARE * F.col("n")))
    words = tied.orderBy(F.desc("n"), "word").limit(MAX_WORDS).select("word").toArrow()["word"].to_numpy()
    vocabulary = np.sort(words.astype(np.int64).view(np.uint64))
    model = Ordinal(vocabulary, np.zeros(len(vocabulary)), np.zeros(GRADES - 1))
    known = spark.sparkContext.broadcast(model)

    def shrink(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [known.value.features(np.array(h, dtype=np.int64).view(np.uint64)) for h in batch.column(1).to_pylist()]
            sizes = [len(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.list_(pa.float64())), pa.array([a for _, a in found], pa.list_(pa.int64())), pa.array(sizes, pa.int64()), batch.column(2)], ["doc_id", "x", "at", "size", "label"])

    got = sparse_rows(rows.transform(map_arrow, shrink, "doc_id long, x array<double>, at array<long>, size long, label int"))
    times = [float(np.expm1(x).sum()) for _, x, _, _ in got]
    toxic = sorted(t for t, (_, _, label, _) in zip(times, got, strict=True) if label)
    if not toxic:
        return Ordinal(vocabulary[:0], np.zeros(0), np.array([35.0, 36.0, 37.0]))
    low, high = toxic[len(toxic) // 3], toxic[2 * len(toxic) // 3]
    grade = lambda t, label: 0 if not label else 1 + (t > low) + (t > high)
    return fit([(x, at, grade(t, label)) for t, (at, x, label, _) in zip(times, got, strict=True)], len(vocabulary), vocabulary)


def _kept(spark, df: DataFrame) -> str:
    from .common import scratch_path

    path = scratch_path(spark, "toxicity-sample")
    df.write.parquet(path)
    return path


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, expected_severity (0 to 3), score (probability of any toxicity), severity (nearest
    grade, at least 1 where toxic), predicted (1: score at or above 0.5)."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, model = WordHashes(), sent.value
        for batch in it:
            got = [model.expected(*model.features(cache.of(t.translate(ITEM_BYTES).split()))) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e for e, _ in got], pa.float64()), pa.array([p for _, p in got], pa.float64())], ["doc_id", "expected_severity", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, score, "doc_id long, expected_severity double, score double")
    toxic = F.col("score") >= 0.5
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_severity", "score", F.when(toxic, F.greatest(F.lit(1), F.round("expected_severity").cast("int"))).otherwise(0).alias("severity"), toxic.cast("int").alias("predicted"))
