"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows of quality 1; all else that training sees is unlabelled text. The
class prior is estimated from how a first positive-against-unlabelled model ranks held-back rows; then
a linear model minimises prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).

Features are the shares of the trigrams of 16 byte classes (letters by case, digits, single marks, ...),
and how many words repeat the one up to four words before. They take the whole text and no vocabulary, so
that they carry over between languages.

Training reads a bounded sample (``MOST_POSITIVES`` and ``MOST_UNLABELLED`` documents, lowest hashes of
doc_id first); scoring reads all rows. Defined results: null and empty texts have no trigrams and get the
score of the bias alone; a null doc_id is not held out and never trains; without positives every score
is 0.5; repeated rows are scored each and train once; a very long text is a slice of its own; other columns
are kept, but that ``score`` and ``predicted`` replace columns of these names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import extended
from .text import Words, released, slices, utf8
from .training import first_by_hash, fold, labelled_texts, train

MOST_POSITIVES, MOST_UNLABELLED = 4000, 6000
FOLDS = 5
THRESHOLD = 0.3
N_TRIGRAMS = 16**3
#: Shares of words that repeat the word 1 to 4 before reach these steps or not; each is a feature of this weight.
GAPS, STEPS, WEIGHT = 4, np.array([0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.8]), 0.3
N_FEATURES = N_TRIGRAMS + GAPS * len(STEPS)

_CLASS = np.full(256, 15, np.uint16)  # other marks; below: letters, digits, white space and marks of their own
for _number, _members in enumerate([range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!?", b"|", b"*#$%&@", b"'\"`", b"-_/\\:;", b"()[]{}<>=+~^", range(128, 256)]):
    _CLASS[list(_members)] = _number


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each document: square roots of trigrams' shares, then steps of repetition; all 0 without text."""
    n = len(offsets) - 1
    kind = _CLASS[data].astype(np.int64)
    codes = kind[:-2] * 256 + kind[1:-1] * 16 + kind[2:] if len(kind) > 2 else np.zeros(0, np.int64)
    document = np.repeat(np.arange(n), np.diff(offsets))
    inside = document[: len(codes)] == document[2 : len(codes) + 2]
    counts = np.bincount(document[: len(codes)][inside] * N_TRIGRAMS + codes[inside], minlength=n * N_TRIGRAMS).reshape(n, N_TRIGRAMS)
    parts = [np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)]
    words = Words(data, offsets)
    h, of = words.hashes(), words.document()
    for gap in range(1, GAPS + 1):
        again = np.flatnonzero((h[gap:] == h[:-gap]) & (of[gap:] == of[:-gap]))
        share = np.bincount(of[again], minlength=n) / np.maximum(words.counts, 1)
        parts.append(WEIGHT * (share[:, None] >= STEPS).astype(np.float32))
    return np.hstack(parts)


def all_features(column: pa.Array):
    data, offsets = utf8(column)
    for i, j in slices(offsets, most_docs=256):
        yield features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Adam:
    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n, np.float32), np.zeros(n, np.float32), 0, rate

    def step(self, w: np.ndarray, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient**2 - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 5000, batch: int = 256, l2: float = 1e-5) -> np.ndarray:
    """Weights and bias, by batches. With a prior: the non-negative risk; without: positives against unlabelled."""
    w, scale = np.zeros(positive.shape[1] + 1, np.float32), np.float32(8)
    adam, draw = Adam(len(w), 0.05), np.random.default_rng(11)
    for step in range(steps):
        adam.rate = 0.05 * (1 - step / steps)
        p, u = (np.hstack([x[draw.integers(len(x), size=batch)] * scale, np.ones((batch, 1), np.float32)]) for x in (positive, unlabelled))
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        as_positive, p_as_negative, u_as_negative = p.T @ (sp - 1) / batch, p.T @ sp / batch, u.T @ su / batch
        if prior is None:
            gradient = as_positive + u_as_negative
        else:
            negative_risk = np.mean(-np.log1p(1e-6 - su)) - prior * np.mean(-np.log1p(1e-6 - sp))
            gradient = prior * as_positive + (u_as_negative - prior * p_as_negative) if negative_risk >= 0 else prior * p_as_negative - u_as_negative
        adam.step(w, gradient + l2 * w)
    w[:-1] *= scale
    return w.astype(np.float64)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from scores of rows that the scorer wasn't trained on.

    Above a threshold lie a share of the unlabelled rows, at least prior times that of the positives; the
    lowest ratio over thresholds, each with its sampling error added, bounds the prior from above. It is
    lowered by its standard error: too high a prior would stop the non-negative risk before it has fitted.
    """
    cuts = np.unique(np.quantile(positive, np.linspace(0.0, 0.9, 40)))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    error = np.sqrt(1 / len(unlabelled)) + np.sqrt(1 / len(positive))
    best = np.argmin((u + error) / np.maximum(p, 1e-9))
    deviation = np.sqrt(u[best] * (1 - u[best]) / len(unlabelled))
    return float(np.clip((u[best] - deviation) / max(p[best], 1e-9), 0.05, 0.98))


def fit(batches) -> bytes:
    empty = np.zeros((0, N_FEATURES), np.float16)
    parts: dict[bool, list[np.ndarray]] = {True: [empty], False: [empty]}
    for batch in batches:
        marks, first = np.array(batch.column("positive").to_pylist(), bool), 0
        for x in all_features(batch.column("text")):  # half precision: shares of trigrams need no more
            own = marks[first : first + len(x)]
            first += len(x)
            for kind in parts:
                parts[kind].append(x[own == kind].astype(np.float16))
    p, u = (np.concatenate(parts.pop(kind)) for kind in (True, False))
    if not len(p):
        return np.zeros(N_FEATURES + 1).tobytes()
    if len(u) < 10:
        u = np.concatenate([u, p])
    used = np.flatnonzero(p.any(0) | u.any(0))
    p, u = (x[:, used].astype(np.float32) for x in (p, u))
    first = descend(p[::2], u[::2], None, steps=600)
    prior = class_prior(p[1::2] @ first[:-1], u[1::2] @ first[:-1]) if len(p) > 20 and len(u) > 20 else 0.5
    weights = descend(p, u, prior)
    out = np.zeros(N_FEATURES + 1)
    out[used], out[-1] = weights[:-1], weights[-1]
    return out.tobytes()


def fit_quality(docs: DataFrame, labels: DataFrame, most_positives: int = MOST_POSITIVES, most_unlabelled: int = MOST_UNLABELLED) -> bytes:
    learnt = fold("doc_id", FOLDS) != 0
    trusted = labels.filter((F.col("quality") == 1) & learnt).select("doc_id").distinct()
    positives = labelled_texts(docs, first_by_hash(trusted, most_positives, "doc_id"), most_positives)
    others = docs.filter(learnt).select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti")
    unlabelled = labelled_texts(docs, first_by_hash(others.distinct(), most_unlabelled, "doc_id"), most_unlabelled)
    sample = positives.select("text", F.lit(True).alias("positive")).unionAll(unlabelled.select("text", F.lit(False).alias("positive")))
    return train(sample, fit)


def score_quality(docs: DataFrame, model: bytes, threshold: float = THRESHOLD) -> DataFrame:
    """All rows with the columns of docs, ``score`` and ``predicted``."""
    docs, schema = extended(docs, "score double, predicted int")

    @released
    def task(batches):
        w = np.frombuffer(model)
        for batch in batches:
            margins = [x @ w[:-1] + w[-1] for x in all_features(batch.column("text"))]
            score = sigmoid(np.concatenate([*margins, np.zeros(0)]).astype(np.float64))
            columns = {c: batch.column(c) for c in schema.names[:-2]}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    return docs.mapInArrow(task, schema)
