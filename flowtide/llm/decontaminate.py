"""Benchmark decontamination by greedy string tiling over joined seeds.

Seeds are Karp-Rabin hashes of ``MIN_TILE`` consecutive terms (runs of ASCII letters and digits, A-Z
lower-cased, and of all characters beyond ASCII). Documents keep the seeds that the benchmark has too
(asked of a bitmap of fixed size, then joined). Pairs of document and item that share enough seeds to reach
``COVERAGE`` of the item get the places of both; consecutive seeds on a diagonal make maximal matches, and
the longest one that overlaps no earlier one is marked as a tile, again and again. A pair whose tiles cover
``COVERAGE`` of the item's terms is contaminated, in whatever order the passages stand.

A pair's row holds the places of the document and those of the item, never their product: a document that
repeats a phrase thousands of times is met with an item in chunks, and only runs are kept.

Defined results: null and empty texts have no terms; items under ``MIN_TILE`` terms match nothing;
repeated documents and items give a row for each distinct (doc_id, text) and (item_id, text); null ids
are kept as they are; very long texts are read whole, in slices of their own; other columns are ignored by
``contaminated`` and kept by ``decontaminate``.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import bitmap
from .storage import materialize
from .text import LOWER, NOT_TERM, Words, gather, grams, released, slices, utf8

MIN_TILE, COVERAGE = 5, 0.5
FILTER_BITS = 26
#: Places of equal seeds that a task holds at a time.
CHUNK_PLACES = 1_000_000
NO_ID = -(1 << 63)


def runs(doc_at: np.ndarray, item_at: np.ndarray) -> np.ndarray:
    """Maximal runs (document place, item place, seeds) of consecutive places of equal seeds on a diagonal."""
    order = np.lexsort((doc_at, doc_at - item_at))
    d, i = doc_at[order], item_at[order]
    begins = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1] + 1) | (i[1:] != i[:-1] + 1)])[: len(d)])
    return np.stack([d[begins], i[begins], np.diff(np.append(begins, len(d)))], axis=1)


def shared_runs(doc_at: np.ndarray, doc_seed: np.ndarray, item_at: np.ndarray, item_seed: np.ndarray) -> np.ndarray:
    """The runs of a document and an item, from places and seeds of both; at most ``CHUNK_PLACES`` places at a time."""
    by_seed, by_place = np.argsort(item_seed, kind="stable"), np.argsort(doc_at)
    doc_at, doc_seed, item_at, item_seed = doc_at[by_place], doc_seed[by_place], item_at[by_seed], item_seed[by_seed]
    low = np.searchsorted(item_seed, doc_seed)
    counts = np.searchsorted(item_seed, doc_seed, "right") - low
    ends, found, i = np.cumsum(counts), [np.zeros((0, 3), np.int64)], 0
    while i < len(doc_at):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK_PLACES, "right")))
        found.append(runs(np.repeat(doc_at[i:j], counts[i:j]), item_at[gather(low[i:j], counts[i:j])]))
        i = j
    whole = np.concatenate(found)
    d, y, n = whole[np.lexsort((whole[:, 0], whole[:, 0] - whole[:, 1]))].T  # runs cut at the end of a chunk go on
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1] + n[:-1]) | (y[1:] != y[:-1] + n[:-1])])[: len(d)])
    return np.stack([d[new], y[new], np.add.reduceat(n, new) if len(new) else n], axis=1)


def greedy(found: np.ndarray, k: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(document place, item place, length) of the tiles: always the longest match that no tile overlaps."""
    heap = [(-(n + k - 1), x, y) for x, y, n in found.tolist()]
    heapq.heapify(heap)
    first, last = (found[:, 0].min(), (found[:, 0] + found[:, 2]).max() + k) if len(found) else (0, 0)
    in_doc, in_item, out = np.zeros(last - first, bool), np.zeros(int((found[:, 1] + found[:, 2]).max()) + k if len(found) else 0, bool), []
    while heap:
        n, x, y = heapq.heappop(heap)
        at = x - first
        taken = in_doc[at : at - n] | in_item[y : y - n]
        if not taken.any():
            out.append((x, y, -n))
            in_doc[at : at - n] = in_item[y : y - n] = True
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):  # what earlier tiles left of it may make shorter ones
            if j - i >= k:
                heapq.heappush(heap, (i - j, x + i, y + i))
    return out


def tiles(doc_at: np.ndarray, item_at: np.ndarray, k: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """The tiles from all pairs of places of equal k-grams."""
    return greedy(runs(doc_at, item_at), k)


def seeds(rows: DataFrame, id_column: str, known: Broadcast | None) -> DataFrame:
    """id, text_hash, n (terms of the text), at and seed for all seeds, or for those that may be known."""

    @released
    def task(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                words = Words(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], NOT_TERM)
                seed = grams(words.hashes(), MIN_TILE)
                ok = words.left()[: len(seed)] >= MIN_TILE
                at = np.flatnonzero(ok if known is None else ok & known.value.holds(seed))
                document = np.searchsorted(words.first, at, "right") - 1
                row = pa.array(document + i)
                columns = {"id": batch.column("id").take(row), "text_hash": batch.column("text_hash").take(row), "n": pa.array(words.counts[document].astype(np.int32))}
                yield pa.RecordBatch.from_pydict(columns | {"at": pa.array((at - words.first[document]).astype(np.int32)), "seed": pa.array(seed[at].view(np.int64))})

    return rows.select(F.col(id_column).cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(task, "id long, text_hash long, n int, at int, seed long")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """A row for each contaminated pair: doc_id, text_hash, item_id, coverage, n_tiles, longest_tile, first_term, end_term."""
    known = materialize(seeds(benchmark, "item_id", None).distinct().withColumn("id", _known("id")), "seeds")
    mine = seeds(docs, "doc_id", docs.sparkSession.sparkContext.broadcast(bitmap(known, "seed", FILTER_BITS)))
    mine = materialize(mine.join(known.select("seed").distinct(), "seed", "left_semi").distinct().withColumn("id", _known("id")), "places")
    # Pairs whose shared seeds reach enough of the item; a pair holds places of the item, not places times places.
    item = known.select(F.col("id").alias("item_id"), F.col("text_hash").alias("item_hash"), F.col("n").alias("item_terms"), F.col("at").alias("item_at"), "seed")
    met = mine.select(F.col("id").alias("doc_id"), "text_hash", "seed").distinct().join(item, "seed")
    reach = F.size(F.array_distinct(F.flatten(F.transform(F.collect_set("item_at"), lambda x: F.sequence(x, x + (MIN_TILE - 1))))))
    pairs = met.groupBy("doc_id", "text_hash", "item_id", "item_hash", "item_terms").agg(reach.alias("reach")).filter(F.col("reach") >= coverage * F.col("item_terms"))
    pairs = materialize(pairs.drop("reach"), "pairs")
    listed = lambda rows: rows.groupBy("id", "text_hash").agg(F.collect_list(F.struct("at", "seed")).alias("places"))
    of_item = listed(known).select(F.col("id").alias("item_id"), F.col("text_hash").alias("item_hash"), F.col("places").alias("item_places"))
    chosen = pairs.select(F.col("doc_id").alias("id"), "text_hash").distinct()
    of_doc = listed(mine.join(chosen, ["id", "text_hash"], "left_semi")).withColumnRenamed("id", "doc_id")
    both = pairs.join(of_item, ["item_id", "item_hash"]).join(of_doc, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "item_id", "item_terms", "places", "item_places")

    @released
    def task(batches):
        for batch in batches:
            found = []
            for number, (terms, mine, other) in enumerate(zip(batch.column("item_terms").to_pylist(), batch.column("places"), batch.column("item_places"))):
                arrays = [x.values.field(c).to_numpy().astype(np.int64) for x in (mine, other) for c in ("at", "seed")]
                made = greedy(shared_runs(*arrays))
                share = sum(n for _, _, n in made) / terms
                if share >= coverage:
                    found.append((number, share, len(made), max(n for _, _, n in made), min(x for x, _, _ in made), max(x + n for x, _, n in made)))
            number, share, n_tiles, longest, first, end = map(list, zip(*found)) if found else ([],) * 6
            take = pa.array(number, pa.int32())
            columns = {c: batch.column(c).take(take) for c in ("doc_id", "text_hash", "item_id")}
            ints = {"n_tiles": n_tiles, "longest_tile": longest, "first_term": first, "end_term": end}
            yield pa.RecordBatch.from_pydict(columns | {"coverage": pa.array(share, pa.float64())} | {k: pa.array(v, pa.int32()) for k, v in ints.items()})

    found = both.mapInArrow(task, "doc_id long, text_hash long, item_id long, coverage double, n_tiles int, longest_tile int, first_term int, end_term int")
    return found.withColumns({c: F.nullif(c, F.lit(NO_ID)) for c in ("doc_id", "item_id")})


def _known(column: str):
    """Null ids as a number, so that they can be joined."""
    return F.coalesce(F.col(column), F.lit(NO_ID))


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that no item contaminates."""
    bad = contaminated(docs, benchmark, coverage).select(_known("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    bad = materialize(bad, "contaminated")  # written, so that Spark knows its size when it picks the join
    keyed = docs.withColumns({"__id": _known("doc_id"), "__hash": F.xxhash64("text")})
    return keyed.join(bad, ["__id", "__hash"], "left_anti").drop("__id", "__hash")
