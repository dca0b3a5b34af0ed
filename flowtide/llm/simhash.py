"""SimHash near-duplicates: 64-bit fingerprints, linked at a few differing bits by pigeonring filtering.

The 64 bits are a ring of distance + 1 segments. If two fingerprints differ in at most `distance` bits,
some start on the ring has every chain of l segments from it differing in at most l - 1 bits (the
proportional budget l * distance / (distance + 1), rounded down). So the first segment agrees, which is
the key that rows are dealt by; within a key, rows are met only across second segments that differ in
one bit or none; chains of three prune further before the full Hamming check.

Work is done on distinct fingerprints, so copies cost one row. A task gives the links it finds as a
spanning forest, not as pairs; links between all tasks' forests are joined into components. A key with
over ``BLOCK_ROWS`` fingerprints is dealt in blocks of two chunks each, which together meet all pairs.

Defined results: null, empty and blank texts have no words and fingerprint zero, linked like any other;
under `words` words the whole sequence is the one shingle; repeated rows are returned each; a null doc_id
is returned with the component of its fingerprint, and component ids are least non-null doc_ids (null if
there is none); only doc_id and text are read.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bitmap import flagged
from .components import stars
from .storage import materialize
from .text import LOWER, U, Words, gather, slices, utf8

WORDS, DISTANCE, SEED = 3, 3, 42
BLOCK_ROWS = 100_000
#: Fingerprints that a task works on at a time, and pairs that it holds at a time.
CHUNK_ROWS, CHUNK_PAIRS = 200_000, 1_000_000
#: Of the bitmap of rows that may have to go.
FILTER_BITS = 27


def simhashes(data: np.ndarray, offsets: np.ndarray, n_words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """One unsigned fingerprint for each document of a slice."""
    words = Words(LOWER[data], offsets)
    buffer, at = words.joined()
    buffer = buffer.tobytes()
    long = words.counts >= n_words
    per_document = np.where(long, words.counts - n_words + 1, np.minimum(words.counts, 1))
    first = gather(words.first[:-1], per_document)
    size = np.repeat(np.where(long, n_words, words.counts), per_document)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(buffer[i:j], seed) for i, j in zip(at[first].tolist(), (at[first + size] - 1).tolist())), np.uint64, len(first))
    out = np.zeros(len(offsets) - 1, np.uint64)
    some = np.flatnonzero(per_document)
    if len(some):
        begins = (np.cumsum(per_document) - per_document)[some]
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        majority = counts * 2 > per_document[some, None]
        out[some] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprints(docs: DataFrame, n_words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash and fp (the 64 bits as a signed long) of every row."""

    def task(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            parts = [simhashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n_words, seed) for i, j in slices(offsets)]
            fp = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": pa.array(fp)})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(task, "doc_id long, text_hash long, fp long")


def forest(block: np.ndarray, ring: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (sorted by block and ring) and the roots that they are linked to, by all links inside blocks."""
    bits = 64 // (distance + 1)
    second = (ring >> U(64 - 2 * bits)) & U((1 << bits) - 1)
    key = (block.astype(np.uint64) << U(bits)) | second
    keys, begins, sizes = np.unique(key, return_index=True, return_counts=True)
    of = np.repeat(np.arange(len(keys)), sizes)
    parent = np.arange(len(ring))
    row = np.arange(len(ring))
    for flip in [0, *(1 << b for b in range(bits))]:
        if flip:
            other = keys ^ U(flip)
            at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
            there = (keys[at] == other) & (other > keys)
            start, count = begins[at][of], np.where(there, sizes[at], 0)[of]
        else:
            start, count = row + 1, (begins + sizes)[of] - row - 1
        rows = np.flatnonzero(count)
        ends = np.cumsum(count[rows])
        i = 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK_PAIRS, "right")))
            part = rows[i:j]
            a, b = np.repeat(part, count[part]), gather(start[part], count[part])
            difference = ring[a] ^ ring[b]
            near = np.bitwise_count(difference >> U(64 - min(3, distance + 1) * bits)) <= min(2, distance)  # the chain of three segments
            near[near] = np.bitwise_count(difference[near]) <= distance
            a, b = a[near], b[near]
            while len(a):
                a, b = parent[a], parent[b]
                apart = a != b
                a, b = a[apart], b[apart]
                np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(parent, up := parent[parent]):
                    parent = up
            i = j
    linked = np.flatnonzero(parent != row)
    return linked, parent[linked]


def links(fps: DataFrame, distance: int = DISTANCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(u, v): links between distinct fingerprints fp whose closure is that of all links within the distance."""
    n_segments = distance + 1
    bits = 64 // n_segments
    fp = F.col("fp")
    turned = [fp if not i else F.shiftleft(fp, bits * i).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits * i)) for i in range(n_segments)]
    rings = fps.select(F.posexplode(F.array(*turned)).alias("turn", "ring"))
    rings = rings.withColumn("key", F.shiftleft(F.col("turn").cast("long"), bits).bitwiseOR(F.shiftrightunsigned("ring", 64 - bits)))
    # At most n_segments * 2**bits keys, and at most n_segments / block_rows of the rows: safe to broadcast.
    hot = rings.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows).select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("chunks"))
    dealt = rings.join(F.broadcast(hot), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("ring"), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("turn", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "ring")
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "ring")

    def work(table: pa.Table):
        turn, key, low, high, ring = (table.column(c).to_numpy() for c in ("turn", "key", "low", "high", "ring"))
        new = np.concatenate([[False], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        ring = ring.view(np.uint64)
        # rings are sorted as signed longs; what matters below is only that equal second segments can be found
        order = np.lexsort((ring, block := np.cumsum(new)))
        rows, roots = forest(block[order], ring[order], distance)
        back = (turn[order].astype(np.uint64) * U(bits)) % U(64)
        plain = (ring[order] >> back) | np.where(back > 0, ring[order] << ((U(64) - back) % U(64)), U(0))
        plain = plain.view(np.int64)
        return pa.RecordBatch.from_pydict({"u": pa.array(plain[rows]), "v": pa.array(plain[roots])})

    def task(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK_ROWS:
                table = pa.Table.from_batches(held)
                last = [table.column(c)[-1].as_py() for c in ("key", "low", "high")]
                same = np.logical_and.reduce([table.column(c).to_numpy() == x for c, x in zip(("key", "low", "high"), last)])
                cut = int(np.argmax(same))
                if cut:
                    yield work(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    return dealt.mapInArrow(task, "u long, v long")


def components(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp and root (a fingerprint) for the distinct fingerprints that have any link."""
    members = stars(links(fps.select("fp").distinct(), distance))
    return members.select(F.col("node").alias("fp"), "root").unionAll(members.select(F.col("root").alias("fp"), "root").distinct())


def near_duplicates(docs: DataFrame, n_words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    fps = materialize(fingerprints(docs, n_words).select("doc_id", "fp"), "fingerprints")
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("own_id"))
    linked = components(fps, distance).join(own, "fp")
    ids = linked.groupBy("root").agg(F.min("own_id").alias("component_id"))
    of_linked = linked.select("fp", "root").join(ids, "root").select("fp", "component_id")
    of_all = own.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "own_id").alias("component_id"))
    of_all = materialize(of_all, "components")  # so that the next join stands alone and AQE can split a hot fingerprint
    return fps.join(of_all, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, n_words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row of least (doc_id, text hash).

    Rows alike in doc_id and text are one document; null doc_ids come after all others.
    """
    fps = materialize(fingerprints(docs, n_words), "fingerprints")
    own = fps.groupBy("fp").agg(first_row().alias("kept"))
    roots = own.join(components(fps, distance), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "kept")
    return only_kept(docs, fps, roots.groupBy("root").agg(F.min("kept").alias("kept")))


def only_kept(docs: DataFrame, fps: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of docs for each of groups' kept (doc_id, text_hash); fps has those of all rows.

    Texts of rows that surely stay aren't shuffled: a bitmap of fixed size says which may have to go.
    """
    kept = groups.select(_key("kept.doc_id").alias("__id"), F.col("kept.text_hash").alias("__hash"), F.lit(True).alias("__kept"))
    rows = fps.select(_key("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).groupBy("__id", "__hash").agg(F.count("*").alias("__n"))
    doubtful = rows.join(kept, ["__id", "__hash"], "left").filter("__kept IS NULL OR __n > 1")
    doubtful = materialize(doubtful.select("__id", "__hash", F.col("__kept").isNotNull().alias("__stays")), "doubtful")
    keyed = docs.withColumns({"__id": _key("doc_id"), "__hash": F.xxhash64("text")}).withColumn("__mark", F.xxhash64("__id", "__hash"))
    marked = flagged(keyed, doubtful.select(F.xxhash64("__id", "__hash").alias("__mark")), "__mark", FILTER_BITS)
    unsure = marked.filter("__flag").join(doubtful, ["__id", "__hash"], "left").filter("coalesce(__stays, true)")
    once = Window.partitionBy("__id", "__hash").orderBy(F.col("doc_id").isNull())
    unsure = unsure.withColumn("__row", F.row_number().over(once)).filter("__row = 1")
    return marked.filter("NOT __flag").select(docs.columns).unionAll(unsure.select(docs.columns))


def first_row():
    """Of several rows the first that has an id, by id and text."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash"))

def _key(column: str):
    return F.coalesce(F.col(column), F.lit(-(1 << 63)))
