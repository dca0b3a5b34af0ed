"""Bounded, deterministic samples of labelled rows, and training on one in a single task."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids have no fold."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def first_by_hash(rows: DataFrame, n: int, key: str) -> DataFrame:
    """The n rows whose keys hash lowest: the same ones in every run, drawn from all rows."""
    order = F.xxhash64(F.lit(20240601), F.col(key))
    return rows.orderBy(order, *[c for c in rows.columns if c != key]).limit(n)


def labelled_texts(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Texts of the at most n given ids, with the ids' other columns; where an id repeats in docs, its least text.

    So a repeated id has one place in the sample, whatever its rows.
    """
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return first_by_hash(texts.groupBy(ids.columns).agg(F.min("text").alias("text")), n, "doc_id")


def train(sample: DataFrame, fit: Callable[[Iterator[pa.RecordBatch]], bytes]) -> bytes:
    """Run fit over all batches of a bounded sample in one task; its bytes are the model."""

    def task(batches):
        yield pa.RecordBatch.from_pydict({"model": pa.array([fit(batches)], pa.binary())})

    row = sample.coalesce(1).mapInArrow(task, "model binary").first()
    return bytes(row["model"]) if row else fit(iter(()))  # Spark may run no task over no row
