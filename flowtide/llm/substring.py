"""Substring dedup: words covered by a window of `min_words` words that starts anywhere else, removed.

The corpus is dealt into shards, each with a compressed FM-index; documents are streamed against the
index of the shards they share content with, and backward search over its wavelet tree gives their matching
statistics: the longest match that ends at a word. Matches of min_words or more are reported as intervals.
What makes this linear is how content is dealt:

1. A window's anchor is the least hash among its ``ANCHOR``-word grams, so equal windows have equal
   anchors. Runs of windows with one anchor form a segment. Anchors are counted over all documents.
2. Segments whose anchor occurs at least twice go to the shard of the anchor; what can't repeat stays
   where it is. Equal segments travel once, with their number. Which anchors repeat is broadcast as a
   bitmap of fixed size: false positives only send a segment in vain. Where an anchor is hot (in over
   ``HOT_COUNT`` segments), all grams of its windows are counted, its windows take their least gram that
   isn't hot as anchor, and anchors are counted again, so such an anchor is in 2 * ``HOT_COUNT`` segments
   at most. Windows of hot grams alone take the least of their grams of all but ``ANCHOR`` - 1 words. Equal
   segments count once there, and what differs at either end lies in a hot gram with the words beside it:
   n copies of a line have n / ``HOT_COUNT`` different ends of a length at most, on each side.
3. In each shard an FM-index over the words of the segments gives the longest match at every end that no
   longer match covers. Intervals go back to the places of their segments, and from there to the documents:
   in one row for each segment and document. A task takes shard after shard and holds one at a time.

Defined results: a null text has no words; repeated rows count as further documents, so all their windows
repeat; a null doc_id is a row like any other; texts under min_words words lose nothing; a very long text
is a slice of its own; the operator's columns replace input columns of the same names. Equality of words and grams is by 64-bit hashes.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import Bitmap, bitmap
from .fmindex import FMIndex
from .places import OWN, beside, intervals, lists, own_intervals, single, together
from .storage import extended, materialize
from .text import SMALL_BYTES, U, Words, binary, grams, released, slices, utf8

MIN_WORDS, ANCHOR = 35, 8
FILTER_BITS, HOT_BITS = 28, 24
HOT_COUNT, SHARD_SEGMENTS = 10_000, 10_000


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of its first least one."""
    at, covered = np.arange(len(values), dtype=np.int64), 1
    while covered < width:
        shift = min(covered, width - covered)
        a, b = at[:-shift], at[shift:]
        at = np.where(values[b] < values[a], b, a)
        covered += shift
    return at


def anchored(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of grams, the first words of all windows, and the place of each window's least gram."""
    gram = grams(words.hashes(), ANCHOR)
    windows = np.flatnonzero(words.left() >= min_words)
    return gram, windows, sliding_least(gram, min_words - ANCHOR + 1)[windows] if len(windows) else windows


class Segments:
    """The segments of a slice: first word (in the slice), number of words, and anchor hash.

    Hot are the anchors that windows may not keep, and all grams that they may not take instead.
    """

    def __init__(self, words: Words, min_words: int, hot: tuple[Bitmap, Bitmap] | None = None):
        gram, windows, place = anchored(words, min_words)
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.anchors = np.zeros(0, np.uint64)
        if not len(windows):
            return
        anchors, width = gram[place], min_words - ANCHOR + 1
        if hot is not None and len(frequent := np.flatnonzero(hot[0].holds(anchors))):
            long = grams(words.hashes(), width)
            least = sliding_least(long, ANCHOR)
            for i in range(0, len(frequent), 1 << 15):
                own = frequent[i : i + (1 << 15)]
                some = windows[own]
                choice = gram[some[:, None] + np.arange(width)]
                held = hot[1].holds(choice)
                rank = (choice >> U(1)) | (held.astype(np.uint64) << U(63))
                place[own] = some + np.argmin(rank, axis=1)
                anchors[own] = gram[place[own]]
                alone = own[held.all(axis=1)]
                at = least[windows[alone]]
                place[alone], anchors[alone] = -1 - at, long[at]
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)]))
        n_windows = np.diff(np.append(new, len(windows)))
        self.starts, self.lengths = windows[new], n_windows + min_words - 1
        self.anchors = anchors[new]


def grams_beside(words: Words, min_words: int, hot: Bitmap) -> np.ndarray:
    """All grams of a slice that stand in windows whose least gram is hot, each place once."""
    gram, windows, place = anchored(words, min_words)
    if not len(windows):
        return np.zeros(0, np.uint64)
    some = windows[hot.holds(gram[place])]
    change = np.zeros(len(gram) + 1, np.int64)
    change[some] += 1
    change[some + min_words - ANCHOR + 1] -= 1
    return gram[np.cumsum(change)[:-1] > 0]


def _slices(batch: pa.RecordBatch):
    data, offsets = utf8(batch.column("text"))
    for i, j in slices(offsets, SMALL_BYTES):
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _counts(docs: DataFrame, hashes) -> DataFrame:
    """(anchor, n) of the hashes that a function gives for the words of each slice."""

    @released
    def task(batches):
        for batch in batches:
            found = [hashes(words) for _, _, words in _slices(batch)]
            anchors, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchors.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return docs.select("text").mapInArrow(task, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def anchor_counts(docs: DataFrame, min_words: int, hot: Broadcast | None = None) -> DataFrame:
    return _counts(docs, lambda words: Segments(words, min_words, hot and hot.value).anchors)


def gram_counts(docs: DataFrame, min_words: int, hot: Broadcast) -> DataFrame:
    return _counts(docs, lambda words: grams_beside(words, min_words, hot.value))


def final_anchors(docs: DataFrame, min_words: int) -> tuple[DataFrame, Broadcast | None]:
    """Counts of the anchors that repeat, and the bitmaps of hot anchors and grams if there are any."""
    counts = materialize(anchor_counts(docs, min_words).filter("n > 1"), "anchors")
    frequent = counts.filter(F.col("n") > HOT_COUNT).select("anchor")
    first = bitmap(frequent, "anchor", HOT_BITS)
    if not first.bytes.any():
        return counts, None
    send = docs.sparkSession.sparkContext.broadcast
    beside = gram_counts(docs, min_words, send(first)).filter(F.col("n") > HOT_COUNT).select("anchor")
    hot = send((first, bitmap(frequent.unionAll(beside), "anchor", HOT_BITS)))
    return materialize(anchor_counts(docs, min_words, hot).filter("n > 1"), "anchors"), hot


def segments(docs: DataFrame, min_words: int, repeated: Broadcast, hot: Broadcast | None, content: bool) -> DataFrame:
    """Segments that may repeat: with their content, or else with the hash of it and where they are in a document."""

    @released
    def task(batches):
        for batch in batches:
            for i, j, words in _slices(batch):
                found = Segments(words, min_words, hot and hot.value)
                chosen = np.flatnonzero(repeated.value.holds(found.anchors))
                starts, lengths = found.starts[chosen], found.lengths[chosen]
                buffer, at = words.joined()
                begins, ends = at[starts], at[starts + lengths] - 1
                out = {"anchor": pa.array(found.anchors[chosen].view(np.int64))}
                if content:
                    out["content"] = binary(buffer, begins, ends - begins)
                else:
                    whole = buffer.tobytes()
                    digest = xxhash.xxh64_intdigest
                    hashes = np.fromiter((digest(whole[a:b], 42) for a, b in zip(begins.tolist(), ends.tolist())), np.uint64, len(starts))
                    document = np.searchsorted(words.first, starts, "right") - 1
                    order, bounds = together(document, found.anchors[chosen], hashes)
                    some, row = order[bounds[:-1]], pa.array(document[order[bounds[:-1]]] + i)
                    out = {"anchor": out["anchor"].take(pa.array(some)), "hash": pa.array(hashes[some].view(np.int64)), "id": batch.column("id").take(row), "text_hash": batch.column("text_hash").take(row)}
                    out["at"] = lists(bounds, pa.array((starts - words.first[document])[order].astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)

    if content:
        return docs.select("text").mapInArrow(task, "anchor long, content binary")
    return docs.select("text", "id", "text_hash").mapInArrow(task, "anchor long, hash long, id long, text_hash long, at array<long>")


def matches(index: FMIndex, symbols: np.ndarray, first: np.ndarray, lanes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, low, high): matches of min_words or more that together cover all such matches of these segments.

    Segments stream by their ends, from the last one on. Where the longest match that ends at a place is
    long enough, it is reported, and the next end asked is the last one of a window that begins before it.
    """
    ends, found = first[1:].copy(), []
    lanes = lanes[first[lanes + 1] - first[lanes] >= min_words]
    while len(lanes):
        begins, end = first[lanes], ends[lanes]
        start = index.longest(symbols, begins, end)
        good = end - start >= min_words
        found.append((lanes[good], start[good], end[good]))
        ends[lanes] = np.where(good, start + min_words - 1, end - 1)
        lanes = lanes[(ends[lanes] - begins >= min_words) & ~(good & (start == begins))]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def repeated_intervals(table: pa.Table, min_words: int) -> pa.RecordBatch:
    """Of one shard: word intervals of each distinct segment whose windows occur twice or more in the shard."""
    column = table.column("content").combine_chunks().cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    words = Words(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])
    _, symbols = np.unique(words.hashes(), return_inverse=True)
    index = FMIndex(symbols, words.left())
    # Equal segments came as one with their number: all of such a one is a match. The others are searched.
    several = table.column("n").to_numpy() > 1
    whole = np.flatnonzero(several & (words.counts >= min_words))
    of, low, high = matches(index, symbols, words.first, np.flatnonzero(~several), min_words)
    of, low, high = (np.concatenate(x) for x in ((of, whole), (low, words.first[whole]), (high, words.first[whole + 1])))
    return own_intervals(table, of, low - words.first[of], high - words.first[of])


def repeated_places(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, text_hash, at, own): of each segment of a document its places and the word intervals to remove there."""
    counts, hot = final_anchors(docs, min_words)
    repeated = docs.sparkSession.sparkContext.broadcast(bitmap(counts, "anchor", FILTER_BITS))
    most = F.least("n", F.lit(2 * HOT_COUNT))  # counted more often are only segments of hot grams, mostly equal
    n_shards = max(1, -(-(counts.agg(F.sum(most)).first()[0] or 0) // SHARD_SEGMENTS))
    distinct = segments(docs, min_words, repeated, hot, True).groupBy("anchor", "content").agg(F.count("*").alias("n"))
    sharded = distinct.select("anchor", "content", "n", F.xxhash64("content").alias("hash"), F.pmod("anchor", F.lit(n_shards)).alias("shard"))
    # A task takes many shards, one after the other: as many tasks as the session shuffles into.
    sharded = sharded.repartition("shard").sortWithinPartitions("shard")

    @released
    def shards(batches):
        held, last = [], None
        for batch in batches:
            number = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    if held and number[i] != last:
                        yield repeated_intervals(pa.Table.from_batches(held), min_words)
                        held = []
                    last = number[i]
                    held.append(batch.slice(i, j - i))
        if held:
            yield repeated_intervals(pa.Table.from_batches(held), min_words)

    found = sharded.mapInArrow(shards, f"anchor long, hash long, {OWN}")
    return segments(docs, min_words, repeated, hot, False).join(found, ["anchor", "hash"]).select("id", "text_hash", "at", "own")


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, text_hash, low, high): word intervals to remove, in documents with columns text, id and text_hash."""
    return single(repeated_places(docs, min_words))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows: the columns of docs with what is kept as text, and n_words, n_removed and kept_sha256.

    Texts that lose a word become their kept words joined by single spaces; others stay as they are.
    kept_sha256 is of the kept words joined by spaces in either case.
    """
    docs, schema = extended(docs, "n_words long, n_removed long, kept_sha256 string")
    names = docs.columns
    keyed = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(-(1 << 63))), "__hash": F.xxhash64("text")})
    found = repeated_places(keyed.select("text", F.col("__id").alias("id"), F.col("__hash").alias("text_hash")), min_words)
    joined = beside(keyed, found)

    @released
    def task(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            row, low, high = intervals(batch)
            texts, parts = [], {"n_words": [], "n_removed": [], "kept_sha256": []}
            for i, j in slices(offsets, SMALL_BYTES):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = np.flatnonzero((row >= i) & (row < j))
                change = np.zeros(len(words) + 1, np.int64)
                first = words.first[row[own] - i]
                np.add.at(change, first + low[own], 1)
                np.add.at(change, first + high[own], -1)
                kept = np.cumsum(change)[:-1] == 0
                buffer, at = words.joined()
                lengths = np.where(kept, np.diff(at), 0)
                if not kept.all():
                    buffer = buffer[np.repeat(kept, np.diff(at))]
                ends = np.concatenate([[0], np.cumsum(lengths)])[words.first]
                kept_before = np.concatenate([[0], np.cumsum(kept)])[words.first]
                n_removed = words.counts - np.diff(kept_before)
                size = np.maximum(np.diff(ends) - 1, 0)  # without the last space
                whole = buffer.tobytes()
                parts["n_words"].append(words.counts)
                parts["n_removed"].append(n_removed)
                parts["kept_sha256"] += [hashlib.sha256(whole[a : a + n]).hexdigest() for a, n in zip(ends.tolist(), size.tolist())]
                texts.append(_choose(n_removed > 0, binary(buffer, ends[:-1], np.where(n_removed > 0, size, 0), pa.string()), batch.column("text").slice(i, j - i)))
            columns = {c: batch.column(c) for c in names} | {"text": pa.concat_arrays(texts) if texts else batch.column("text")}
            for name in ("n_words", "n_removed"):
                columns[name] = pa.array(np.concatenate([*parts[name], np.zeros(0, np.int64)]).astype(np.int64))
            columns["kept_sha256"] = pa.array(parts["kept_sha256"], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(task, schema)


def _choose(mask: np.ndarray, a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.if_else(pa.array(mask), a, b.cast(pa.string()))
