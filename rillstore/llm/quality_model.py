"""Quality classifier: ordinal cumulative-link regression on hashed text.

P(grade <= k) = sigmoid(threshold_k - weights . x): one weight vector for all grades, and ordered thresholds (the
first is free, the others add exp of a step). x holds hashed words and shapes of words, as shares of the text's words, and
buckets of length, of repeated neighbours, of distinct words, of line length and of symbols. A text gets its expected grade and the probability of at least
the grade asked for.

At most `TRAIN_ROWS` labelled rows of at most `TRAIN_LENGTH` characters are used for the fit, those with the least hashes of
doc_id; the driver keeps their features only, at most one number for each bucket. Scores cover all rows and whole texts.

Defined cases: a null or empty text has only the bucket of no words; without labelled rows of two grades every
text gets the one grade there is (0 without any) and probability 1; rows with a null grade or doc_id don't train; repeated rows
score alike; of equal hashes the lower doc_id comes first; a very long text counts whole; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import TRAIN_LENGTH, map_slices, ship, training_rows

#: The most labelled rows for the fit.
TRAIN_ROWS = 4_000
#: Weight of the penalty on the weights.
PENALTY = 2e-4
#: Hash buckets; passes over the sample; the least probability of the grade asked for at which a text is kept.
BUCKETS, STEPS, KEEP = 1 << 16, 120, 0.5

WORD = re.compile(r"\S+")
RUNS = re.compile(r"(.)\1+")
UPPER, LOWER, DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]"), re.compile(r"[^\W\d_A]"), re.compile(r"\d")


def bucket(kind: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}") % BUCKETS


def shape(word: str) -> str:
    """Upper-case letters as A, others as a, digits as 9; runs as one."""
    return RUNS.sub(r"\1", DIGIT.sub("9", LOWER.sub("a", UPPER.sub("A", word))))[:12]


class Features:
    """Buckets of words and shapes, remembered up to a bound."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, word: str) -> tuple[int, int]:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = bucket("word", word.lower()), bucket("shape", shape(word))
        return self.known[word]

    def text(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and values, unsorted; a bucket may come again."""
        ws = WORD.findall(text or "")
        n = len(ws)
        layout = [bucket("length", str(min(14, n.bit_length())))]
        if not n:
            return np.array(layout), np.ones(1)
        pairs = np.array([self.of(w) for w in ws], np.int64)
        again = sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n
        distinct = len(set(ws)) / n
        layout += [bucket("again", str(int(10 * again))), bucket("distinct", str(int(10 * distinct))), bucket("line", str(min(9, int(np.log2(1 + n / (1 + text.count("\n")))))))]
        symbols = sum(map(text.count, "#*$%&|<>!")) / max(1, len(text))
        layout.append(bucket("symbols", str(min(9, int(60 * symbols)))))
        at = np.concatenate([pairs.ravel(), layout])
        return at, np.concatenate([np.full(2 * n, 4.0 / n), np.full(len(layout), 0.7)])


@dataclass
class Model:
    grades: tuple[int, ...]
    thresholds: np.ndarray
    weights: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each grade for linear scores x."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - x[:, None], -30, 30)))
        edges = np.hstack([np.zeros((len(x), 1)), below, np.ones((len(x), 1))])
        return np.diff(edges, axis=1)


def loss(params: np.ndarray, doc: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with the penalty, and its gradient. params: weights, first threshold, logs of the steps."""
    w, raw = params[:BUCKETS], params[BUCKETS:]
    k, n = len(raw), len(y)
    thresholds = np.cumsum(np.r_[raw[0], np.exp(raw[1:])])
    x = np.bincount(doc, w[at] * value, n)
    below = np.hstack([np.zeros((n, 1)), 1 / (1 + np.exp(-np.clip(thresholds[None, :] - x[:, None], -30, 30))), np.ones((n, 1))])
    each = np.arange(n)
    upper, lower = below[each, y + 1], below[each, y]
    p = np.maximum(upper - lower, 1e-9)
    up, down = upper * (1 - upper) / p, lower * (1 - lower) / p
    dx = (up - down) / n  # by the linear score
    dt = np.bincount(y, -up / n, k + 1)[:k] + np.bincount(y, down / n, k + 1)[1:]
    tail = np.cumsum(dt[::-1])[::-1]
    grad = np.concatenate([np.bincount(at, dx[doc] * value, BUCKETS) + PENALTY * w, tail[:1], tail[1:] * np.exp(raw[1:])])
    return float(-np.log(p).mean() + PENALTY * (w @ w) / 2), grad


def merged(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of one bucket as one."""
    key, inverse = np.unique(at, return_inverse=True)
    return key.astype(np.int32), np.bincount(inverse, value)


def fit_rows(rows: Iterable[tuple[str | None, int]]) -> Model:
    """Adam on the mean log-likelihood with a small penalty on the weights; the same rows give the same model."""
    own, found, given = Features(), [], []
    for text, grade in rows:  # one text at a time
        found.append(merged(*own.text(text)))
        given.append(grade)
    grades = tuple(sorted(set(given))) or (0,)
    if len(grades) < 2:
        return Model(grades, np.zeros(0), np.zeros(BUCKETS))
    doc = np.repeat(np.arange(len(found)), [len(a) for a, _ in found])
    at, value = np.concatenate([a for a, _ in found]), np.concatenate([v for _, v in found])
    y = np.searchsorted(grades, given)
    k = len(grades) - 1
    shares = np.clip(np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / len(y), 1e-3, 1 - 1e-3)
    first = np.log(shares / (1 - shares))
    params = np.concatenate([np.zeros(BUCKETS), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        _, grad = loss(params, doc, at, value, y)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = params[BUCKETS:]
    return Model(grades, np.cumsum(np.r_[raw[0], np.exp(raw[1:])]), params[:BUCKETS])


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, length: int = TRAIN_LENGTH, held_out: int | None = 1) -> Model:
    """Fit on at most `most` labelled rows, a bounded sample by hash; rows of the held-out remainder don't train."""
    return fit_rows((r.text, r.quality) for r in training_rows(docs, labels, "quality", most, length, held_out).toLocalIterator())


def score(docs: DataFrame, model: Model, at_least: int | None = None, keep: float = KEEP) -> DataFrame:
    """doc_id, grade (expected), tail (probability of at least the grade asked for, the highest by default), kept."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket
    least = max(model.grades) if at_least is None else at_least
    tools: list[Features] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not tools:
            tools.append(Features())
        own = shared.value
        x = np.array([float(own.weights[a] @ v) for a, v in map(tools[0].text, batch.column("text").to_pylist())])
        p = own.probabilities(x) if len(own.thresholds) else np.ones((len(x), 1))
        tail = p[:, [g >= least for g in own.grades]].sum(1)
        arrays = [batch.column("doc_id"), pa.array(p @ np.array(own.grades, float)), pa.array(tail), pa.array(tail >= keep)]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "grade", "tail", "kept"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, grade double, tail double, kept boolean")
