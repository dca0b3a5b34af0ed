"""Near-copies: documents of similar word shingles, by wide SimHash fingerprints and an exact check.

Two documents are near-copies if the sets of their ``WORDS``-word shingles have a Jaccard similarity of
``SIMILARITY`` or more. At 0.8 two random bits of SimHash differ with probability 0.15, so 64 bits and a
few differing ones don't do: a fingerprint has ``LANES`` * 64 bits, and two may differ in ``DISTANCE``.

Pigeonring filtering: the bits are laid around a ring anew for each turn. The first segment, the key that
rows are dealt by, must agree whole; from there on, chains of consecutive segments of 16 bits may differ in
their share of the distance; what is left meets the full Hamming check. A key has as many bits as number
the documents and ``SPARE`` more (so that strangers rarely meet), and there are as many turns as leave a pair whose distance is
the mean one at the similarity a chance of ``MISS`` to agree in no key; more similar pairs are missed more
rarely, and by the spread of distances some three in a hundred of the least similar ones. So turns
grow with the fourth root of the documents, about.

Before that, documents are left out that can't have a near-copy: of the ``LOW`` least shingle hashes of a
document some nine in ten stand in a near-copy at 0.8 too, so if under half of them stand in any other
document, there is none (a pair at 0.8 fails this once in some thousand times).

What these two steps miss is found by an exact pass over all distinct texts. Of two sets at the similarity each holds that
share of the other at least, so in any one order of hashes the first ones of both, a fifth and one, have a hash in common. Those are
the postings; hashes of many documents come last in the order (a sample says which: that saves work and decides nothing). Where
texts that aren't linked yet have one, their sizes and the parities of their sets in 256 bits are compared: sets differ in as
many shingles at least as parities do in bits; and what both can have in common is their common postings and what either has beside its own.
Pairs that are left are checked as the others.

Inside a key a task links documents by a minimal spanning forest over their distances (it emits no other
pairs), and keys of over ``BLOCK_ROWS`` documents are dealt in blocks of two chunks each, which together meet
all pairs. Links are then checked exactly on whole shingle sets, and components of those that hold are
near-copies. Documents with one fingerprint are near-copies without a check.

Defined results: null, empty and blank texts have no shingle and are near-copies of each other; a text
under ``WORDS`` words is one shingle; long texts are read whole; only doc_id and text are read.
"""

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import bitmap, flagged
from .components import stars
from .simhash import first_row, only_kept
from .storage import materialize
from .text import LOWER, SMALL_BYTES, U, Words, gather, grams, mix, released, slices, utf8

WORDS, SIMILARITY = 5, 0.8
LANES, DISTANCE, SEGMENT, CHAINS = 4, 52, 16, (1, 2, 4, 8)
TOO_FAR = 1 << 14
STEPS = np.arange(1, LANES + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
MISS, SPARE = 0.001, 2
LOW, FILTER_BITS = 8, 27
BLOCK_ROWS = 20_000
MOST_KEY_BITS = 48
PAIR_ROWS = 4096
HOT_SHARE, HOT_COUNT, HOT_BITS = 8, 32, 26


def shingles(data: np.ndarray, offsets: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of a slice's documents, and how many each document has."""
    words = Words(LOWER[data], offsets)
    hashes, counts, first = words.hashes(), words.counts, words.first[:-1]
    document = words.document()
    parts, owners = [], []
    for size in range(1, n_words + 1):
        chosen = np.flatnonzero(counts == size if size < n_words else counts >= n_words)
        at = gather(first[chosen], counts[chosen] - size + 1)
        parts.append(mix(grams(hashes, size)[at] + U(size)) if len(at) else np.zeros(0, np.uint64))
        owners.append(document[at])
    found, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])[: len(found)]
    return found[new], np.bincount(owner[new], minlength=len(counts))


def wide_simhashes(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of LANES unsigned 64-bit integers for each document, from its distinct shingles."""
    out = np.zeros((len(counts), LANES), np.uint64)
    some = np.flatnonzero(counts)
    begins = (np.cumsum(counts) - counts)[some]
    for lane in range(LANES if len(some) else 0):
        bits = np.unpackbits(mix(found + STEPS[lane]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        out[some, lane] = np.packbits(ones * 2 > counts[some, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(values.view(np.int64)))


FIELDS = [f"f{i}" for i in range(LANES)]


def fingerprints(docs: DataFrame, n_words: int) -> DataFrame:
    """doc_id, text_hash, the least shingle hashes and the fingerprint's lanes of every row."""

    @released
    def task(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets, SMALL_BYTES):
                found, counts = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n_words)
                prints = wide_simhashes(found, counts).view(np.int64)
                few = np.minimum(counts, LOW)
                columns = {c: batch.column(c).slice(i, j - i) for c in ("doc_id", "text_hash")} | {"low": lists(found[gather(np.cumsum(counts) - counts, few)], few)}
                yield pa.RecordBatch.from_pydict(columns | {f: pa.array(prints[:, k].copy()) for k, f in enumerate(FIELDS)})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(task, "doc_id long, text_hash long, low array<long>, " + ", ".join(f"{f} long" for f in FIELDS))


def with_company(distinct: DataFrame) -> DataFrame:
    """uid and lanes of the fingerprints half of whose least shingle hashes others have as well."""
    counts = distinct.select(F.explode("low").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
    marks = distinct.sparkSession.sparkContext.broadcast(bitmap(counts.filter("n > 1"), "hash", FILTER_BITS))

    @released
    def task(batches):
        for batch in batches:
            column = batch.column("low")
            counts = column.value_lengths().to_numpy()
            held = np.concatenate([[0], np.cumsum(marks.value.holds(column.flatten().to_numpy().view(np.uint64)))])
            ends = np.cumsum(counts)
            chosen = pa.array((2 * (held[ends] - held[ends - counts]) >= counts) & (counts > 0))
            yield batch.select(["uid", *FIELDS]).filter(chosen)

    return distinct.select("uid", "low", *FIELDS).mapInArrow(task, "uid long, " + ", ".join(f"{f} long" for f in FIELDS))


def lanes(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(f).to_numpy().view(np.uint64) for f in FIELDS], axis=1)


def key_plan(n_docs: int, similarity: float) -> tuple[int, int]:
    """Bits of a key, and turns."""
    bits = min(MOST_KEY_BITS, max(8, int(np.ceil(np.log2(max(2, n_docs)))) + SPARE))
    agree = (1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi) ** bits
    return bits, int(np.ceil(np.log(MISS) / np.log(1 - agree)))


def ring(turn: int) -> np.ndarray:
    """The order of bits around the ring in a turn."""
    return np.random.default_rng(turn).permutation(LANES * 64)


def keys(distinct: DataFrame, bits: int, turns: int) -> DataFrame:
    """(key, uid): the first segment of every turn."""

    @released
    def task(batches):
        orders = [ring(t)[:bits] for t in range(turns)]
        weights = U(1) << np.arange(bits, dtype=np.uint64)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                ones = np.unpackbits(lanes(part).view(np.uint8).reshape(part.num_rows, -1), axis=1, bitorder="little")
                found = np.stack([ones[:, order] @ weights | U(t << bits) for t, order in enumerate(orders)], axis=1)
                row = pa.array(np.repeat(np.arange(part.num_rows), turns))
                yield pa.RecordBatch.from_pydict({"key": pa.array(found.reshape(-1).view(np.int64)), "uid": part.column("uid").take(row)})

    return distinct.mapInArrow(task, "key long, uid long")


def shared(keyed: DataFrame) -> DataFrame:
    """Only rows whose key another row has."""

    @released
    def task(batches):
        pending = None  # the last row so far, and whether the one before it has its key
        for batch in batches:
            if not batch.num_rows:
                continue
            key, uid = batch.column("key").to_numpy(), batch.column("uid").to_numpy()
            before = False
            if pending is not None:
                key, uid, before = np.append(pending[0], key), np.append(pending[1], uid), pending[2]
            same = key[1:] == key[:-1]
            chosen = np.flatnonzero(np.concatenate([[before], same[:-1]]) | same) if len(same) else np.zeros(0, np.int64)
            pending = key[-1], uid[-1], bool(same[-1]) if len(same) else before
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[chosen]), "uid": pa.array(uid[chosen])})
        if pending is not None and pending[2]:
            yield pa.RecordBatch.from_pydict({"key": pa.array(pending[0:1]), "uid": pa.array(pending[1:2])})

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(task, "key long, uid long")


def within(difference: np.ndarray, chain: np.ndarray, bits: int) -> np.ndarray:
    """How many bits of each row are set, or TOO_FAR where a chain or the whole is over its budget."""
    out = np.full(len(difference), TOO_FAR)
    left = np.arange(len(difference))
    for n, mask in zip(CHAINS, chain):
        budget = DISTANCE * (bits + SEGMENT * n) // (LANES * 64)
        left = left[np.bitwise_count(difference[left] & mask).sum(1, dtype=np.int64) <= budget]
    count = np.bitwise_count(difference[left]).sum(1, dtype=np.int64)
    out[left] = np.where(count <= DISTANCE, count, TOO_FAR)
    return out


def chain_masks(turn: int, bits: int) -> np.ndarray:
    """Lane masks of the key and the next segments of a turn's ring, for each length of a chain."""
    order, out = ring(turn), []
    for n in CHAINS:
        ones = np.zeros(LANES * 64, np.uint8)
        ones[order[: bits + SEGMENT * n]] = 1
        out.append(np.packbits(ones, bitorder="little").view(np.uint64))
    return np.stack(out)


def spanning(prints: np.ndarray, chain: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A minimal spanning forest of a key's fingerprints, as (row, row) links within the distance."""
    n = len(prints)
    left, least, parent = np.arange(1, n), np.full(n - 1, TOO_FAR), np.zeros(n - 1, np.int64)
    new, links = 0, []
    while len(left):
        away = within(prints[left] ^ prints[new], chain, bits)
        closer = away < least
        least[closer], parent[closer] = away[closer], new
        at = int(np.argmin(least))
        new = int(left[at])
        if least[at] < TOO_FAR:
            links.append((int(parent[at]), new))
        left, least, parent = np.delete(left, at), np.delete(least, at), np.delete(parent, at)
    a, b = zip(*links) if links else ((), ())
    return np.array(a, np.int64), np.array(b, np.int64)


def in_blocks(some: DataFrame, block_rows: int) -> DataFrame:
    """(uid, key, low, high) of (key, uid): keys of over block_rows rows in blocks of two chunks each, that together meet all pairs."""
    counts = some.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows)
    hot = materialize(counts.select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("chunks")), "hot")
    dealt = some.join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.select("uid", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def candidates(distinct: DataFrame, similarity: float, block_rows: int) -> DataFrame:
    """(u, v): links between uids within the distance, by spanning forests of all keys."""
    bits, turns = key_plan(distinct.count(), similarity)
    some = materialize(shared(keys(distinct, bits, turns)), "keys")
    dealt = in_blocks(some, block_rows)
    dealt = dealt.join(distinct.select("uid", *FIELDS), "uid").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "uid")

    @released
    def task(batches):
        masks = {}
        group, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, low, high = (batch.column(c).to_numpy() for c in ("key", "low", "high"))
            uid, prints = batch.column("uid").to_numpy(), lanes(batch)
            new = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            for i, j in zip([0, *new], [*new, batch.num_rows]):
                if (key[i], low[i], high[i]) != group:
                    if group is not None:
                        for part, values in zip(out, _linked(group[0] >> bits, held, masks, bits)):
                            part.append(values)
                    group, held = (key[i], low[i], high[i]), []
                held.append((uid[i:j], prints[i:j]))
            yield pa.RecordBatch.from_pydict({name: pa.array(np.concatenate(part)) for name, part in zip(("u", "v"), out)})
        if group is not None:
            u, v = _linked(group[0] >> bits, held, masks, bits)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

    found = dealt.mapInArrow(task, "u long, v long")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _linked(turn: int, held: list, masks: dict, bits: int) -> tuple[np.ndarray, np.ndarray]:
    turn = int(turn)
    if turn not in masks:
        masks[turn] = chain_masks(turn, bits)
    uid, prints = np.concatenate([u for u, _ in held]), np.concatenate([p for _, p in held])
    if len(uid) == 2:
        good = within(prints[:1] ^ prints[1:], masks[turn], bits) < TOO_FAR
        return uid[:1][good], uid[1:][good]
    a, b = spanning(prints, masks[turn], bits)
    return uid[a], uid[b]


def shingle_sets(docs: DataFrame, n_words: int) -> DataFrame:
    """uid and the hashes of the distinct shingles of each text."""

    @released
    def task(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets, SMALL_BYTES):
                found, counts = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n_words)
                yield pa.RecordBatch.from_pydict({"uid": batch.column("uid").slice(i, j - i), "hashes": lists(found, counts)})

    return docs.select("uid", "text").mapInArrow(task, "uid long, hashes array<long>")


def frequent(docs: DataFrame, n_words: int) -> Broadcast:
    """A bitmap of the shingle hashes of over HOT_COUNT documents of a HOT_SHARE-th of them."""
    some = docs.select("text", F.xxhash64("text").alias("uid")).filter(F.pmod("uid", F.lit(HOT_SHARE)) == 0)
    counts = shingle_sets(some, n_words).select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
    return docs.sparkSession.sparkContext.broadcast(bitmap(counts.filter(F.col("n") > HOT_COUNT), "hash", HOT_BITS))


def first_hashes(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """How many first hashes of a set of each size have one in common with any similar set's."""
    return np.minimum(sizes, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1)


def prefixes(docs: DataFrame, n_words: int, similarity: float, hot: Broadcast) -> DataFrame:
    """uid, size, first hashes and the parities' lanes of the shingle set of each text that has shingles."""

    @released
    def task(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets, SMALL_BYTES):
                found, counts = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n_words)
                owner = np.repeat(np.arange(j - i), counts)
                bit = (mix(found) & U(LANES * 64 - 1)).astype(np.int64)
                odd = np.bincount(owner * (LANES * 64) + bit, minlength=(j - i) * LANES * 64).reshape(j - i, -1) & 1
                odd = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.int64)
                found = found[np.lexsort((found, hot.value.holds(found), owner))]
                few = first_hashes(counts, similarity)
                columns = {"uid": batch.column("uid").slice(i, j - i), "size": pa.array(counts.astype(np.int64)), "first": lists(found[gather(np.cumsum(counts) - counts, few)], few)}
                yield pa.RecordBatch.from_pydict(columns | {f: pa.array(odd[:, k].copy()) for k, f in enumerate(FIELDS)})

    return docs.select("text", F.xxhash64("text").alias("uid")).mapInArrow(task, "uid long, size long, first array<long>, " + ", ".join(f"{f} long" for f in FIELDS)).filter("size > 0")


def _apart(held: list, similarity: float) -> pa.RecordBatch:
    """(u, v, wanted): pairs of texts of different roots that may be similar, of one hash; and how many first hashes such ones share."""
    uid, size, root, odd = (np.concatenate(x) for x in zip(*held))
    out = [(uid[:0],) * 3]
    for i in range(len(uid) - 1 if root.min() < root.max() else 0):
        left = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        left = left[np.minimum(size[left], size[i]) >= similarity * np.maximum(size[left], size[i]) - 1e-9]
        differing = np.bitwise_count(odd[left] ^ odd[i]).sum(1, dtype=np.int64)
        left = left[differing <= (1 - similarity) / (1 + similarity) * (size[left] + size[i]) + 1e-9]
        common = np.ceil(similarity / (1 + similarity) * (size[left] + size[i]) - 1e-9).astype(np.int64)
        rest = np.maximum(size[left] - first_hashes(size[left], similarity), size[i] - first_hashes(size[i], similarity))
        out.append((np.full(len(left), uid[i]), uid[left], common - rest))
    return pa.RecordBatch.from_pydict({name: pa.array(np.concatenate(x)) for name, x in zip(("u", "v", "wanted"), zip(*out))})


def missed(docs: DataFrame, texts: DataFrame, n_words: int, similarity: float, block_rows: int) -> DataFrame:
    """(u, v): pairs of texts (uid, root: distinct) of different roots that may be similar, and all that are."""
    firsts = prefixes(docs, n_words, similarity, frequent(docs, n_words)).dropDuplicates(["uid"]).join(texts, "uid")
    firsts = materialize(firsts, "prefixes")
    roots = firsts.select(F.explode("first").alias("hash"), "root").groupBy("hash").agg(F.min("root").alias("a"), F.max("root").alias("b"))
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(roots.filter("a < b"), "hash", FILTER_BITS))

    @released
    def chosen(batches):
        for batch in batches:
            column = batch.column("first")
            row = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy())
            hashes = column.flatten().to_numpy()
            held = np.flatnonzero(marks.value.holds(hashes.view(np.uint64)))
            yield pa.RecordBatch.from_pydict({"key": pa.array(hashes[held]), "uid": batch.column("uid").take(pa.array(row[held]))})

    some = materialize(firsts.select("uid", "first").mapInArrow(chosen, "key long, uid long"), "shared")
    dealt = in_blocks(some, block_rows).join(firsts.select("uid", "size", "root", *FIELDS), "uid")
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "uid")

    @released
    def task(batches):
        group, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, low, high, uid, size, root = (batch.column(c).to_numpy() for c in ("key", "low", "high", "uid", "size", "root"))
            odd = lanes(batch)
            new = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            for i, j in zip([0, *new], [*new, batch.num_rows]):
                if (key[i], low[i], high[i]) != group:
                    if held:
                        yield _apart(held, similarity)
                    group, held = (key[i], low[i], high[i]), []
                held.append((uid[i:j], size[i:j], root[i:j], odd[i:j]))
        if held:
            yield _apart(held, similarity)

    found = dealt.mapInArrow(task, "u long, v long, wanted long")
    met = found.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("n"), F.max("wanted").alias("wanted"))
    return met.filter("n >= wanted").select("u", "v")  # blocks may count a hash again, which loses nothing


def similar(found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of found whose sets (uid, hashes) have the similarity."""
    both = found.join(sets.select(F.col("uid").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("uid").alias("v"), F.col("hashes").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    held = both.withColumn("common", common).filter(F.col("common") >= similarity * (F.size("a") + F.size("b") - F.col("common")))
    return held.select("u", "v")


def near_copies(docs: DataFrame, n_words: int = WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """All rows' doc_id, text_hash and uid (of their fingerprint); and (uid, root) of the uids with near-copies but roots."""
    uid = F.xxhash64(*FIELDS).alias("uid")
    rows = materialize(fingerprints(docs, n_words).select("doc_id", "text_hash", uid, "low", *FIELDS), "fingerprints")
    distinct = materialize(rows.groupBy("uid", *FIELDS).agg(first_row().alias("row"), F.any_value("low").alias("low")), "prints")
    found = materialize(candidates(materialize(with_company(distinct), "company"), similarity, BLOCK_ROWS), "candidates")
    # Exactly, on the shingles of one document of each fingerprint.
    linked = found.select(F.explode(F.array("u", "v")).alias("uid")).distinct()
    texts = distinct.join(linked, "uid").select("uid", F.coalesce("row.doc_id", F.lit(-(1 << 63))).alias("id"), F.col("row.text_hash").alias("hash"))
    texts = materialize(texts, "linked")
    mark = F.xxhash64("id", "hash").alias("mark")
    keyed = docs.select("text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("hash")).select("*", mark)
    keyed = flagged(keyed, texts.select(mark), "mark", FILTER_BITS).filter("__flag")  # other texts aren't shuffled
    sets = shingle_sets(keyed.join(texts, ["id", "hash"]).dropDuplicates(["uid"]), n_words)
    members = stars(similar(found, materialize(sets, "sets"), similarity)).select(F.col("node").alias("uid"), "root")
    # What has been missed, among all distinct texts.
    hashes = rows.groupBy(F.col("text_hash")).agg(F.min("uid").alias("uid")).join(members, "uid", "left")
    hashes = materialize(hashes.select(F.col("text_hash").alias("uid"), F.coalesce("root", "uid").alias("root")), "texts")
    more = materialize(missed(docs, hashes, n_words, similarity, PAIR_ROWS), "missed")
    ends = more.select(F.explode(F.array("u", "v")).alias("uid")).distinct()
    keyed = flagged(docs.select("text", F.xxhash64("text").alias("uid")), ends, "uid", FILTER_BITS).filter("__flag")
    sets = materialize(shingle_sets(keyed.join(ends, "uid").dropDuplicates(["uid"]), n_words), "sets")
    held = similar(more, sets, similarity)
    for end in ("u", "v"):
        held = held.join(hashes.select(F.col("uid").alias(end), F.col("root").alias(f"{end}_root")), end)
    edges = members.select(F.col("uid").alias("u"), F.col("root").alias("v")).unionAll(held.select(F.col("u_root").alias("u"), F.col("v_root").alias("v")).distinct())
    return rows, stars(edges).select(F.col("node").alias("uid"), "root")


def keep_one(docs: DataFrame, n_words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without near-copies: of each component the row of least (doc_id, text hash), null ids last."""
    rows, members = near_copies(docs, n_words, similarity)
    own = rows.groupBy("uid").agg(first_row().alias("kept"))
    roots = own.join(members, "uid", "left").select(F.coalesce("root", "uid").alias("root"), "kept")
    return only_kept(docs, rows, roots.groupBy("root").agg(F.min("kept").alias("kept")))
