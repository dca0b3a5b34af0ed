"""Places of segments in documents, and the intervals that come back to them.

A text that says the same over and over holds one segment at many places. They go as one row through the
join, which so makes no more rows than a document has different segments; only where the document is
cut do places and intervals become single intervals.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of a segment: its intervals, in one row.
OWN = "own array<struct<low: long, high: long>>"


def together(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, otherwise as it was, and where each run of equal ones begins; at last the end."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    return order, np.append(np.flatnonzero(new), len(order))


def lists(bounds: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def own_intervals(table: pa.Table, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """(anchor, hash, own): one row of each segment of a shard's table that has intervals."""
    order, bounds = together(of, low, high)
    of, pairs = of[order], pa.StructArray.from_arrays([pa.array(x[order].astype(np.int64)) for x in (low, high)], ["low", "high"])
    bounds = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
    take = pa.array(of[bounds[:-1]])
    return pa.RecordBatch.from_pydict({c: table.column(c).take(take).combine_chunks() for c in ("anchor", "hash")} | {"own": lists(bounds, pairs)})


def single(places: DataFrame) -> DataFrame:
    """(id, text_hash, low, high) of rows (id, text_hash, at, own)."""
    each = places.select("id", "text_hash", F.explode("at").alias("at"), "own").select("id", "text_hash", "at", F.inline("own"))
    return each.select("id", "text_hash", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high"))


def beside(docs: DataFrame, places: DataFrame) -> DataFrame:
    """docs, keyed by __id and __hash, with arrays __at, __low and __high: of each segment its places and intervals."""
    cut = F.collect_set(F.struct("at", F.col("own.low").alias("low"), F.col("own.high").alias("high"))).alias("__cut")
    found = places.groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(cut)
    names = [c for c in docs.columns if c not in ("__id", "__hash")]
    return docs.join(found, ["__id", "__hash"], "left").select(*names, *(F.col(f"__cut.{c}").alias(f"__{c}") for c in ("at", "low", "high")))


def _nested(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of lists: how many each row has, how long they are, and all values."""
    inner = column.flatten()
    counts, lengths = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (column, inner))
    return counts, lengths, inner.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def intervals(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, high), by rows: each interval at each place of its segment."""
    counts, n_places, at = _nested(batch.column("__at"))
    _, n_own, low = _nested(batch.column("__low"))
    _, _, high = _nested(batch.column("__high"))
    pairs = n_places * n_own
    of = np.repeat(np.arange(len(pairs)), pairs)
    k = np.arange(len(of)) - (np.cumsum(pairs) - pairs)[of]
    place = at[(np.cumsum(n_places) - n_places)[of] + k // n_own[of]]
    own = (np.cumsum(n_own) - n_own)[of] + k % n_own[of]
    return np.repeat(np.arange(len(counts)), counts)[of], place + low[own], place + high[own]
