"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Terms are runs of letters and digits, lower-cased. Features are the presence of unigrams, bigrams and
skip-grams (one term left out), hashed to ``BITS`` bits. Per-coordinate rates and the L1 term leave few
weights other than zero; those are what is broadcast.

Training reads a bounded sample of labelled rows (``MOST_ROWS``, lowest hashes of doc_id first); scoring
reads all rows whole. Defined results: null and empty texts have no feature and get the score of the
bias alone; a null doc_id is not held out and never trains; without labelled rows every score is 0.5;
repeated rows are scored each and train once; a very long text is a slice of its own; other columns are
kept, but that ``score`` and ``predicted`` replace columns of these names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import sigmoid
from .storage import extended
from .text import LOWER, NOT_TERM, Words, mix, slices, utf8
from .training import first_by_hash, fold, labelled_texts, train

MOST_ROWS = 8000
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
BITS = 20
ALPHA, BETA, L1, L2, EPOCHS = 8.0, 1.0, 6.0, 0.0, 16

U = np.uint64


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the document of each, repeats included."""
    words = Words(LOWER[data], offsets, NOT_TERM)
    h, document, left = words.hashes(), words.document(), words.left()
    pairs = [(h, np.ones(len(h), bool))]
    for gap in (1, 2):
        ok = (left > gap)[: max(0, len(h) - gap)]
        pairs.append((mix(h[: len(ok)] * U(2 * gap + 1) + mix(h[gap : gap + len(ok)] + U(gap))), ok))
    numbers = np.concatenate([(x[ok] >> U(64 - BITS)).astype(np.int64) for x, ok in pairs])
    return numbers, np.concatenate([document[: len(ok)][ok] for _, ok in pairs])


def fit(batches) -> bytes:
    rows, labels = [], []
    for batch in batches:
        labels += batch.column("label").to_pylist()
        data, offsets = utf8(batch.column("text"))
        for i in range(len(offsets) - 1):
            part = data[offsets[i] : offsets[i + 1]]
            rows.append(np.unique(features(part, np.array([0, len(part)]))[0]).astype(np.int32))
    z, n = np.zeros(1 + (1 << BITS)), np.zeros(1 + (1 << BITS))
    bias = 1 << BITS
    order = np.random.default_rng(7)

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == bias, 0.0, L1)
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS if rows else 0):
        for i in order.permutation(len(rows)):
            at = np.append(rows[i], bias)
            w = weights(at)
            g = float(sigmoid(w.sum())) - labels[i]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(len(z)))
    kept = np.flatnonzero(w)
    return kept.astype(np.uint32).tobytes() + w[kept].astype(np.float32).tobytes()


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> bytes:
    learnt = labels.filter(F.col("toxic").isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sample = labelled_texts(docs, first_by_hash(learnt, most_rows, "doc_id"), most_rows)
    return train(sample.select("text", "label"), fit)


def score_toxicity(docs: DataFrame, model: bytes, threshold: float = THRESHOLD) -> DataFrame:
    """All rows with the columns of docs, ``score`` and ``predicted``."""
    docs, schema = extended(docs, "score double, predicted int")

    def task(batches):
        half = len(model) // 2
        w = np.zeros(1 + (1 << BITS))
        w[np.frombuffer(model[:half], np.uint32)] = np.frombuffer(model[half:], np.float32)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            margins = np.full(len(offsets) - 1, w[-1])
            for i, j in slices(offsets):
                numbers, document = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                weighty = w[numbers] != 0
                once = np.unique((document[weighty] << BITS) | numbers[weighty])
                margins[i:j] += np.bincount(once >> BITS, weights=w[once & ((1 << BITS) - 1)], minlength=j - i)
            score = sigmoid(margins)
            columns = {c: batch.column(c) for c in schema.names[:-2]}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    return docs.mapInArrow(task, schema)
