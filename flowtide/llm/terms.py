"""Counts of terms by group, made in tasks before anything is shuffled."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, NOT_LETTER, Words, binary, slices, utf8

#: Distinct (group, term) pairs that a task holds before it hands them on.
MOST_HELD = 1 << 20


def _batch_counts(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """(lang, source, term, n, docs) of the terms of one batch: occurrences and documents."""
    data, offsets = utf8(batch.column("text"))
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    for i, j in slices(offsets, most_bytes=8 << 20):
        words = Words(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], NOT_LETTER)
        if not len(words):
            continue
        terms = binary(words.data, words.starts, words.ends - words.starts).dictionary_encode()
        size = len(terms.dictionary)
        term = terms.indices.to_numpy().astype(np.int64)
        # A term counts once in a document: (document, term) pairs first, (group, term) pairs of them after.
        pairs, n = np.unique(words.document() * size + term, return_counts=True)
        keys, at = np.unique(group[i:j][pairs // size] * size + pairs % size, return_inverse=True)
        langs, sources = np.divmod(keys // size, len(source.dictionary))
        yield pa.table(
            {
                "lang": lang.dictionary.take(pa.array(langs)),
                "source": source.dictionary.take(pa.array(sources)),
                "term": terms.dictionary.take(pa.array(keys % size)),
                "n": np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64),
                "docs": np.bincount(at, minlength=len(keys)),
            }
        )


def _summed(held: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of documents with text, lang and source; nulls count as empty strings.

    Terms are runs of ASCII letters and of characters beyond ASCII, with A to Z in lower case. A text of any
    length is read whole; a text without terms gives no row.
    """
    texts = docs.select("text", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")])

    def task(batches):
        held, rows = [], 0
        for batch in batches:
            for counted in _batch_counts(batch):
                held.append(counted)
                rows += len(counted)
                if rows > 2 * MOST_HELD:
                    held = [_summed(held)]
                    rows = len(held[0])
                    if rows > MOST_HELD:
                        yield from held[0].combine_chunks().to_batches(max_chunksize=1 << 16)
                        held, rows = [], 0
        if held:
            yield from _summed(held).combine_chunks().to_batches(max_chunksize=1 << 16)

    counted = texts.mapInArrow(task, "lang string, source string, term binary, n long, docs long")
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return summed.withColumn("term", F.col("term").cast("string"))
