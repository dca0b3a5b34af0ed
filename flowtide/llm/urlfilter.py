"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

A rule names a host and a path prefix; it fits that host and its subdomains. The longest fitting rule
decides. Urls that no rule fits get the verdict of a model over hashed n-grams of host and path, trained
on a small labelled URL table: a bounded sample (``MOST_URLS``) of the urls that rules do decide, each host
with path once however often it occurs, up to half of the sample from either class.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and gets the
model's verdict for no features; with an empty labelled table or one of a single class the model allows
(or blocks) all by its bias; repeated rows are judged each; only page_id and url are read.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import Adam, sigmoid
from .storage import extended
from .text import U, mix, slices, utf8
from .training import first_by_hash, train

MOST_URLS = 4000
BITS = 16
SIZES = (3, 4, 5)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed rules of the contract, as (verdict, host, path).
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def with_parts(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and ruled (the rule's verdict); all in built-in functions."""
    url = F.coalesce("url", F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pages = pages.withColumns({"host": F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), upper, upper.lower()), "path": F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)})
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return pages.withColumns({"rule": rule, "ruled": verdict})


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the n-grams' features, the row of each, and how many rows."""
    data, offsets = utf8(column)
    numbers, rows = [], []
    for i, j in slices(offsets):
        part, of = data[offsets[i] : offsets[j]].astype(np.uint64), np.repeat(np.arange(i, j), np.diff(offsets[i : j + 1]))
        for n in SIZES:
            count = max(0, len(part) - n + 1)
            code = np.full(count, n, np.uint64)
            for k in range(n):
                code = code * U(257) + part[k : k + count]
            inside = of[:count] == of[n - 1 : n - 1 + count]
            numbers.append((mix(code[inside]) >> U(64 - BITS)).astype(np.int64))
            rows.append(of[:count][inside])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(numbers + empty), np.concatenate(rows + empty), len(offsets) - 1


def both_parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of hosts and of paths, apart from each other, in rows of length 1."""
    host, host_row, n = features(batch.column("host"))
    path, path_row, _ = features(batch.column("path"))
    key = np.unique(np.concatenate([(host_row << BITS + 1) | host, (path_row << BITS + 1) | (1 << BITS) | path]))
    rows, numbers = key >> BITS + 1, key & ((1 << BITS + 1) - 1)
    counts = np.bincount(rows, minlength=n)
    return numbers, rows, 1 / np.sqrt(np.maximum(counts, 1))


def fit(batches) -> bytes:
    numbers, rows, scales, labels, seen = [], [], [], [], 0
    for batch in batches:
        f, r, s = both_parts(batch)
        numbers.append(f), rows.append(r + seen), scales.append(s), labels.append(np.array(batch.column("blocked").to_pylist(), float))
        seen += batch.num_rows
    w = np.zeros(1 + (2 << BITS))
    if seen:
        f, r, s, y = map(np.concatenate, (numbers, rows, scales, labels))
        adam = Adam(len(w), 0.1)
        for _ in range(200):
            margin = np.bincount(r, weights=w[f], minlength=seen) * s + w[-1]
            error = (sigmoid(margin) - y) / seen
            gradient = np.bincount(f, weights=(error * s)[r], minlength=len(w))
            gradient[-1] = error.sum()
            adam.step(w, gradient + 1e-5 * w)
    return w.astype(np.float32).tobytes()


def labelled_urls(parted: DataFrame, most_urls: int) -> DataFrame:
    """host, path and blocked of distinct urls that rules decide, at most half of them from either class."""
    distinct = parted.filter("ruled IS NOT NULL").groupBy("host", "path").agg(F.max(F.col("ruled") == "block").alias("blocked"))
    keyed = distinct.withColumn("key", F.concat("host", "path"))
    chosen = [first_by_hash(keyed.filter(F.col("blocked") == verdict), most_urls // 2, "key") for verdict in (True, False)]
    return chosen[0].unionAll(chosen[1]).drop("key")


def judge_urls(pages: DataFrame, rules=RULES, most_urls: int = MOST_URLS) -> DataFrame:
    """page_id, url, host, path, rule, block_score (of the model) and verdict of every row."""
    parted = with_parts(pages.select("page_id", "url"), rules)
    model = train(labelled_urls(parted, most_urls), fit)
    _, schema = extended(parted.drop("ruled"), "block_score double, verdict string")

    def task(batches):
        w = np.frombuffer(model, np.float32)
        for batch in batches:
            f, r, s = both_parts(batch)
            score = sigmoid(np.bincount(r, weights=w[f], minlength=batch.num_rows) * s + float(w[-1]))
            own = pa.array(np.where(score >= 0.5, "block", "allow"), pa.string())
            columns = {c: batch.column(c) for c in schema.names[:-2]}
            yield pa.RecordBatch.from_pydict(columns | {"block_score": pa.array(score), "verdict": pc.coalesce(batch.column("ruled"), own)})

    return parted.mapInArrow(task, schema)
