"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (N-gram sizes below) of its lower-case code points, hashed
into 2**BITS columns. Each present feature has the value of its log-count ratio between the classes,
zero if fewer than LEAST_TEXTS texts have it or the ratio is under LEAST_RATIO; a logistic model is trained
on these values, and its margin is calibrated together with the log of the number of features, so that
long texts don't gather chance weight. The margins to calibrate on come from models of the other folds.

Training uses a bounded sample of labelled rows outside the held-out fold (``PER_CLASS`` rows of a
class, texts of at most ``MAX_CHARS`` code points); scoring reads every whole text.

Defined cases: a null or empty text has no features and gets the intercept's score; repeated rows are
scored row by row; without labelled rows of both classes every score is 0.0 (``predicted`` 0, and
:func:`keep` keeps all); an empty table gives an empty table; extra columns are not read, and
:func:`keep` returns the input's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from piiguard.llm.common import held_out, labelled_sample, released, table

SIZES = (3, 4, 5)
BITS = 18
#: Code points whose n-grams are made at once.
PIECE_CHARS = 1 << 20
PER_CLASS = 2000
MAX_CHARS = 60_000
THRESHOLD = 0.5
LEAST_TEXTS = 3
LEAST_RATIO = 0.2
#: Parts of the sample, each measured by a model of the others.
FOLDS = 3
ROUNDS = 50
DECAY = 1e-3


def features(text: str) -> np.ndarray:
    """The distinct hashed n-grams of a text, as column numbers; long texts piece by piece."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) > PIECE_CHARS:
        seen = np.zeros(1 << BITS, bool)
        for start in range(0, len(c), PIECE_CHARS):
            seen[_grams(c[start : start + PIECE_CHARS + max(SIZES) - 1])] = True
        return np.flatnonzero(seen)
    return _grams(c)


def _grams(c: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of code points; they take about 60 bytes a code point."""
    found = []
    for n in SIZES:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint32)
        for j in range(n):
            h = (h ^ c[j : len(c) - n + 1 + j]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        found.append(h >> np.uint32(32 - BITS))
    if not found:
        return np.zeros(0, np.int64)
    h = np.concatenate(found).astype(np.int64)
    last = np.empty(1 << BITS, np.int64)  # only entries written here are read
    last[h] = np.arange(len(h))
    return h[last[h] == np.arange(len(h))]


@dataclass(frozen=True)
class Model:
    weights: bytes  # 2**BITS single floats: log-count ratio times linear weight; none without both classes
    bias: float = 0.0
    length_slope: float = 0.0

    def score(self, texts: pa.Array) -> np.ndarray:
        """The score of each text, one at a time; null is empty."""
        if not self.weights:
            return np.zeros(len(texts))
        w = np.frombuffer(self.weights, np.float32)
        z = np.empty(len(texts))
        for i, t in enumerate(texts):
            f = features(t.as_py() or "")
            z[i] = w[f].sum(dtype=np.float64) + self.bias + self.length_slope * np.log1p(len(f))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def ratios(columns: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Naive Bayes log-count ratio of each column, from the numbers of texts that have it."""
    pos, neg = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for c, label in zip(columns, y.tolist(), strict=True):  # a text has each column once
        (pos if label == 1 else neg)[c] += 1
    ratio = np.log((pos + 1.0) / (y.sum() + 2.0)) - np.log((neg + 1.0) / ((1 - y).sum() + 2.0))
    ratio[(pos + neg < LEAST_TEXTS) | (np.abs(ratio) < LEAST_RATIO)] = 0.0
    return ratio


def linear(columns: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each column, ratio times slope, and bias of a logistic fit by Adam on the ratios."""
    ratio = ratios(columns, y)
    # each class carries half the weight while the slopes are fitted; the calibration is on true weights
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    used = [c[ratio[c] != 0] for c in columns]  # before they are put together, as this is in the driver's memory
    flat, row = np.concatenate(used).astype(np.int64), np.repeat(np.arange(len(used)), [len(c) for c in used])
    del used
    value = ratio[flat]
    w, b, m, v, mb, vb = np.full(1 << BITS, 0.02), 0.0, np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z = np.bincount(row, weights=(w * ratio)[flat], minlength=len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        part = g[row]
        part *= value
        gw = np.bincount(flat, weights=part, minlength=1 << BITS) + DECAY * w / len(y)
        del part
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, step = np.sqrt(1 - 0.99**t) / (1 - 0.9**t), 0.01
        w -= step * fix * m / (np.sqrt(v) + 1e-9)
        b -= 10 * step * fix * mb / (np.sqrt(vb) + 1e-9)
    return w * ratio, b


def train(sample: list[tuple[str, int, float]]) -> Model:
    """A linear model of all rows, its margin calibrated on margins across folds and the true class sizes."""
    if len({y for _, y, _ in sample}) < 2:
        return Model(b"")
    columns, y = [features(t).astype(np.int32) for t, _, _ in sample], np.array([s[1] for s in sample], np.float64)
    fold, margin = np.empty(len(y), np.int64), np.empty(len(y))
    for label in (0, 1):  # both classes are dealt out by themselves, so that each fold has its share
        own = np.flatnonzero(y == label)
        fold[own] = np.arange(len(own)) % FOLDS
    for k in sorted(set(fold.tolist())):
        rest = np.flatnonzero(fold != k)
        w, b = linear([columns[i] for i in rest], y[rest]) if len(rest) else (np.zeros(1 << BITS), 0.0)
        for i in np.flatnonzero(fold == k):
            margin[i] = w[columns[i]].sum() + b
    x = np.stack([margin, np.log1p([len(c) for c in columns]), np.ones(len(y))], 1)
    a, slope, c = calibrate(x, y, np.array([s[2] for s in sample]))
    w, b = linear(columns, y)
    return Model((w * a).astype(np.float32).tobytes(), float(b * a + c), float(slope))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic coefficients of the columns of ``x``, the last one constant (Newton, smoothed targets)."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    mean[-1], scale[-1] = 0.0, 1.0
    u, theta, pull = (x - mean) / scale, np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 1e-2), 1e-6)

    def loss(t: np.ndarray) -> float:
        z = u @ t
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 0.5 * (pull * t * t).sum())

    best = loss(theta)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(u @ theta, -30, 30)))
        grad = u.T @ (weight * (p - target)) + pull * theta
        hess = (u * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ u + np.diag(pull)
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and (now := loss(theta - size * step)) > best:
            size /= 2
        if size <= 1e-6 or best - now < 1e-9 * max(best, 1.0):
            break
        theta, best = theta - size * step, now
    out = theta / scale
    out[-1] -= (out * mean)[:-1].sum()
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(labelled_sample(docs, labels, "toxic", PER_CLASS, MAX_CHARS))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats: 1 MB
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)), pa.float64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their own columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            yield batch.filter(pa.array(shared.value.score(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


# ----------------------------------------------------------------------------------------------
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
