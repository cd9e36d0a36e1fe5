"""Quality classifier (operator 4): a factorisation machine.

Inputs are hashed words (tf, length-normalised), statistics of the text's structure and its size; never
labels, lang, source or doc_id. The score is
    b + sum w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]
whose pairwise part takes linear time by the sum-of-squares identity, passed through a logistic
function. It is fitted by AdaGrad on a bounded sample of labelled rows (MAX_ROWS and MAX_FEATURES, chosen by
a hash of the id) of which none is held out; every text is scored whole, long ones too. Null and empty texts
get the score of a text without words. If no row can be learned from, all scores are 0.5. An id with several
labels counts with the largest, null labels and ids are not learned from. Repeated rows are scored and returned
each, equal texts alike; an empty table gives no rows. Other columns, whatever their names, are not read;
keep_good keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_arrow, materialize
from .words import LOWER_BYTES, WordHashes, texts

MAX_ROWS = 6_000
#: Features of all sampled rows together (64 MB on the driver), however long the texts.
MAX_FEATURES = 4_000_000
WORD_BITS = 14
FACTORS = 6
EPOCHS = 6
THRESHOLD = 0.3

SYMBOLS = b"#*$%&|<>"
_ASCII_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?"
#: Names of the structure statistics, in the order of the first features.
STATS = ("constant", "symbols", "capitals", "digits", "marks", "distinct", "runs", "repeats", "word length", "size", "lines", "empty")


def structure(text: bytes, words: list[bytes], hashes: np.ndarray) -> list[float]:
    size, n = max(1, len(text)), max(1, len(words))
    share = lambda chars: (size - len(text.translate(None, chars))) / size if text else 0.0
    runs = float((hashes[1:] == hashes[:-1]).mean()) if len(words) > 1 else 0.0
    distinct = len(np.unique(hashes)) / n
    if len(words) > 16:  # a run of eight words that comes back
        eights = hashes[:-7].copy()
        for j in range(1, 8):
            eights = eights * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - 7 + j]
        repeats = 1 - len(np.unique(eights)) / len(eights)
    else:
        repeats = 0.0
    stats = [1.0, 8 * share(SYMBOLS), 2 * share(_ASCII_UPPER), 4 * share(_DIGITS), 8 * share(_MARKS), distinct, 2 * runs, 2 * repeats]
    return [*stats, min(4.0, len(text) / n / 10), np.log1p(len(words)) / 10, min(2.0, text.count(b"\n") * 20 / n), float(not words)]


def features(text: bytes, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; the statistics first, then the hashed words of the lower-cased text."""
    words = text.split()
    hashes = cache.of(words)
    first = structure(text, words, hashes)
    low = text.translate(LOWER_BYTES).split()
    bucket, times = np.unique(cache.of(low) & np.uint64((1 << WORD_BITS) - 1), return_counts=True)
    values = np.log1p(times)
    values = values / max(1.0, float(np.sqrt((values**2).sum())))
    return np.concatenate([np.arange(len(first)), bucket.astype(np.int64) + len(first)]), np.concatenate([first, values]).astype(np.float64)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at]
        linear = self.bias + self.weights[at] @ x
        pairs = 0.5 * float(((x @ v) ** 2).sum() - (x * x) @ (v * v).sum(axis=1))
        return float(1 / (1 + np.exp(-np.clip(linear + pairs, -35, 35))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5) -> Machine:
    """AdaGrad on the logistic loss, rows in an order drawn from a fixed seed."""
    width, rng = len(STATS) + (1 << WORD_BITS), np.random.default_rng(7)
    w, v = np.zeros(width), rng.normal(0, 0.02, (width, factors))
    sum_w, sum_v, b, sum_b = np.full(width, 1e-2), np.full((width, factors), 1e-2), 0.0, 1e-2
    for _ in range(epochs if rows else 0):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            va = v[at]
            s = x @ va
            z = b + w[at] @ x + 0.5 * float((s**2).sum() - (x * x) @ (va * va).sum(axis=1))
            g = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y
            sum_b += g * g
            b -= rate * g / np.sqrt(sum_b)
            gw = g * x + decay * w[at]
            sum_w[at] += gw**2
            w[at] -= rate * gw / np.sqrt(sum_w[at])
            gv = g * (x[:, None] * s - va * (x * x)[:, None]) + decay * va
            sum_v[at] += gv**2
            v[at] = va - rate * gv / np.sqrt(sum_v[at])
    return Machine(b, w, v)


def below(share: float, key: Column) -> Column:
    """Whether the key's 63-bit hash lies below a share of all of them, however small the share."""
    return F.shiftrightunsigned(F.xxhash64(key), 1) < F.lit(min((1 << 63) - 1, int(share * (1 << 63))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, label of about `most` rows at most, chosen by a hash of the id; never held-out rows.
    The ids are at most a few bytes times `most`, so they may be broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    share = 0.95 * most / max(1, known.count())
    chosen = known.where(below(share, F.col("doc_id"))) if share < 1 else known
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def sparse_rows(df: DataFrame, most: int = MAX_FEATURES) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
    """(at, x, label, size) of each row of df (doc_id, at, x, size, label) in a fixed order, as NumPy views of Arrow
    columns: no Python object a feature. Of more than `most` features, rows are thinned out by a hash of the id."""
    df = materialize(df, "sample-features")
    total = df.agg(F.sum(F.size("at"))).first()[0] or 0
    got = (df.where(below(most / total, F.concat(F.col("doc_id").cast("string"), F.lit("-thin")))) if total > most else df).toArrow().combine_chunks()
    if not got.num_rows:
        return []
    flat = {}
    for name, kind in (("at", np.int64), ("x", np.float64)):
        column = got[name].chunk(0) if hasattr(got[name], "chunk") else got[name]
        flat[name] = column.values.to_numpy().astype(kind)
        ends = column.offsets.to_numpy()
    order = np.lexsort((got["size"].to_numpy(), got["doc_id"].to_numpy()))
    labels, sizes = got["label"].to_numpy(), got["size"].to_numpy()
    return [(flat["at"][ends[i] : ends[i + 1]], flat["x"][ends[i] : ends[i + 1]], int(labels[i]), int(sizes[i])) for i in order]


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> Machine:
    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in it:
            found = [features(t, cache) for t in texts(batch, "text")]
            at, x = pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), at, x, pa.array([len(a) for a, _ in found], pa.int64()), batch.column(2)], ["doc_id", "at", "x", "size", "label"])

    rows = sparse_rows(labelled_sample(docs, labels, "quality", most).transform(map_arrow, extract, "doc_id long, at array<int>, x array<double>, size long, label int"))
    return fit([(at, x, label) for at, x, label, _ in rows])


def score_quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, model = WordHashes(), sent.value
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(*features(t, cache)) for t in texts(batch, "text")], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, score, "doc_id long, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1: score at or above the threshold)."""
    scored = score_quality(docs, train(docs, labels, most))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose own text scores at or above the threshold."""
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, model = WordHashes(), machine.value
        for batch in it:
            yield batch.filter(pa.array([model.score(*features(t, cache)) >= threshold for t in texts(batch, "text")], pa.bool_()))

    return docs.transform(map_arrow, keep, docs.schema)
