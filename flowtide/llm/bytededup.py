"""Byte dedup: bytes covered by a string of `min_bytes` bytes that also starts anywhere else, removed.

Suffixes are sorted by the difference-cover algorithm, and neighbours in their order are compared over
min_bytes bytes. The sort is distributed by content: equal strings have equal anchors, so all suffixes that can
share min_bytes bytes lie in one shard, and shards are sorted apart, in parallel.

1. A window's anchor is the least hash among its grams of ``anchor_bytes``. Runs of windows with one anchor form
   a segment. Anchors are counted over all documents.
2. Segments whose anchor occurs at least twice go to the shard of the anchor; what can't repeat stays where
   it is. Equal segments travel once, with their number. Which anchors repeat is broadcast as a bitmap of
   fixed size: false positives only send a segment in vain. Where an anchor is hot (in over ``HOT_COUNT``
   segments), all grams of its windows are counted, its windows take their least gram that isn't hot, and
   anchors are counted again. Windows of hot grams alone take the least of their grams that
   are as long as a window less a gram and a byte more, so only bytes at either end tell such segments apart.
3. In a shard, a window repeats if the segments of its run of equal neighbours stand for two places or more.
   Intervals go back to the places of their segments, and from there to the documents: in one row for each
   segment and piece of a document. A task takes shard after shard and holds one at a time.

Defined results: a null text is empty; repeated rows count as further documents, so all their windows repeat;
a null doc_id is a row like any other; texts under min_bytes bytes lose nothing; a text of any length is read
whole, in pieces that overlap; the operator's columns replace input columns of the same names; spans may cut
characters, so what is kept is binary. An empty table gives an empty one. Ties of hashes are told apart by
comparing bytes, but for equality of whole segments, which is by a 64-bit hash of them and their anchor.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import Bitmap, bitmap
from .places import OWN, beside, intervals, lists, own_intervals, single, together
from .storage import extended, materialize
from .suffixes import repeated_windows
from .text import BYTE, U, gather, powers, slices, utf8

MIN_BYTES = 400
FILTER_BITS, HOT_BITS = 28, 24
#: Small shards are sorted near the processor: one has some 2,500 places of segments, and fewer distinct ones.
HOT_COUNT, SHARD_SEGMENTS = 4_000, 2_500
#: Bytes of a piece, few enough for a processor's cache; places in it are PLACE bits of a sort key.
PIECE_BYTES = (1 << 17) - 1
PLACE = U((1 << 20) - 1)
TOP = U(63)


def anchor_bytes(min_bytes: int) -> int:
    """Bytes of a gram: of 400 bytes 128."""
    return max(1, min_bytes * 8 // 25)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width bytes from each place on; equal to span_hashes of all these spans."""
    n = max(0, len(data) - width + 1)
    up, down = powers(20)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
    out = total[width : width + n] - total[:n]
    out *= down[:n]
    out += U(width)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        out ^= out >> U(shift)
        if factor > 1:
            out *= U(factor)
    return out


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width keys: of a block's end and the next one's beginning."""
    n = len(keys) - width + 1
    blocks = np.full(-(-len(keys) // width) * width, ~U(0))
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def _ranked(hashes: np.ndarray) -> np.ndarray:
    """Sort keys: a hash's high bits, and behind them its place."""
    return (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)


class Segments:
    """The segments of a piece: first byte (in the piece), number of bytes, and anchor hash.

    Hot are the anchors that windows may not keep, and all grams that they may not take instead.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_bytes: int, hot: tuple[Bitmap, Bitmap] | None = None):
        self.min_bytes, self.width = min_bytes, min_bytes - anchor_bytes(min_bytes) + 1
        self.gram = np.zeros(0, np.uint64)
        self.starts = self.counts = np.zeros(0, np.int64)
        self.anchors = self.gram
        long = np.diff(offsets) >= min_bytes
        if not long.any():
            return
        self.gram = gram_hashes(data, anchor_bytes(min_bytes))
        least = sliding_least(_ranked(self.gram), self.width)
        # A segment ends where the least gram changes, or the windows of a document end.
        first, end = offsets[:-1][long], offsets[1:][long] - min_bytes + 1
        cuts = np.unique(np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, first, end]))
        inside = np.searchsorted(first, cuts, "right") > np.searchsorted(end, cuts, "right")
        at = np.flatnonzero(inside)
        self.starts, self.counts = cuts[at], cuts[at + 1] - cuts[at]
        self.anchors = self.gram[(least[self.starts] & PLACE).astype(np.int64)]
        if hot is not None and len(frequent := np.flatnonzero(hot[0].holds(self.anchors))):
            self._anchor_again(data, frequent, hot[1])

    @property
    def lengths(self) -> np.ndarray:
        return self.counts + self.min_bytes - 1

    def _anchor_again(self, data: np.ndarray, frequent: np.ndarray, hot: Bitmap) -> None:
        windows = gather(self.starts[frequent], self.counts[frequent])
        held = hot.holds(self.gram)
        least = sliding_least(_ranked((self.gram >> U(1)) | (held.astype(np.uint64) << TOP)), self.width)[windows]
        place = (least & PLACE).astype(np.int64)
        anchors = self.gram[place]
        alone = np.flatnonzero((least >> TOP) == 1)
        if len(alone):
            long = gram_hashes(data, self.width)
            at = (sliding_least(_ranked(long), anchor_bytes(self.min_bytes))[windows[alone]] & PLACE).astype(np.int64)
            place[alone], anchors[alone] = -1 - at, long[at]
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)]))
        plain = np.ones(len(self.starts), bool)
        plain[frequent] = False
        self.starts = np.concatenate([self.starts[plain], windows[new]])
        self.counts = np.concatenate([self.counts[plain], np.diff(np.append(new, len(windows)))])
        self.anchors = np.concatenate([self.anchors[plain], anchors[new]])


def grams_beside(data: np.ndarray, offsets: np.ndarray, min_bytes: int, hot: Bitmap) -> np.ndarray:
    """All grams of a piece that stand in windows whose least gram is hot, each place once."""
    found = Segments(data, offsets, min_bytes)
    some = np.flatnonzero(hot.holds(found.anchors))
    change = np.zeros(len(found.gram) + 1, np.int64)
    np.add.at(change, found.starts[some], 1)
    np.add.at(change, found.starts[some] + found.counts[some] + found.width - 1, -1)
    return found.gram[np.cumsum(change)[:-1] > 0]


def pieces(batch: pa.RecordBatch, min_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, base, data, offsets): runs of whole documents from row on, or a part of a long one from byte base on.

    Every window lies in exactly one piece.
    """
    data, offsets = utf8(batch.column("text"))
    for i, j in slices(offsets, PIECE_BYTES):
        low, high = int(offsets[i]), int(offsets[j])
        step = PIECE_BYTES - min_bytes + 1
        for at in range(low, max(low + 1, high - min_bytes + 1), step) if high - low > PIECE_BYTES else [low]:
            end = min(high, at + PIECE_BYTES) if high - low > PIECE_BYTES else high
            yield i, at - low, data[at:end], offsets[i : j + 1] - low if j > i + 1 else np.array([0, end - at])


def _counts(docs: DataFrame, min_bytes: int, hashes) -> DataFrame:
    """(anchor, n) of the hashes that a function gives for each piece."""

    def task(batches):
        for batch in batches:
            found = [hashes(data, offsets) for _, _, data, offsets in pieces(batch, min_bytes)]
            anchors, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchors.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return docs.select("text").mapInArrow(task, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def anchor_counts(docs: DataFrame, min_bytes: int, hot: Broadcast | None = None) -> DataFrame:
    return _counts(docs, min_bytes, lambda data, offsets: Segments(data, offsets, min_bytes, hot and hot.value).anchors)


def gram_counts(docs: DataFrame, min_bytes: int, hot: Broadcast) -> DataFrame:
    return _counts(docs, min_bytes, lambda data, offsets: grams_beside(data, offsets, min_bytes, hot.value))


def final_anchors(docs: DataFrame, min_bytes: int) -> tuple[DataFrame, Broadcast | None]:
    """Counts of the anchors that repeat, and the bitmaps of hot anchors and grams if there are any."""
    counts = materialize(anchor_counts(docs, min_bytes).filter("n > 1"), "anchors")
    frequent = counts.filter(F.col("n") > HOT_COUNT).select("anchor")
    first = bitmap(frequent, "anchor", HOT_BITS)
    if not first.bytes.any():
        return counts, None
    send = docs.sparkSession.sparkContext.broadcast
    beside = gram_counts(docs, min_bytes, send(first)).filter(F.col("n") > HOT_COUNT).select("anchor")
    hot = send((first, bitmap(frequent.unionAll(beside), "anchor", HOT_BITS)))
    return materialize(anchor_counts(docs, min_bytes, hot).filter("n > 1"), "anchors"), hot


def segments(docs: DataFrame, min_bytes: int, repeated: Broadcast, hot: Broadcast | None, content: bool) -> DataFrame:
    """Segments that may repeat: with their content, or else with the hash of it and where they are in a document."""

    def task(batches):
        for batch in batches:
            for i, base, data, offsets in pieces(batch, min_bytes):
                found = Segments(data, offsets, min_bytes, hot and hot.value)
                chosen = np.flatnonzero(repeated.value.holds(found.anchors))
                starts, lengths = found.starts[chosen], found.lengths[chosen]
                out = {"anchor": pa.array(found.anchors[chosen].view(np.int64))}
                whole = data.tobytes()
                texts = (whole[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist()))
                if content:
                    out["content"] = pa.array(list(texts), pa.binary())
                else:
                    hashes = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts), np.uint64, len(starts))
                    document = np.searchsorted(offsets, starts, "right") - 1
                    order, bounds = together(document, found.anchors[chosen], hashes)
                    some, row = order[bounds[:-1]], pa.array(document[order[bounds[:-1]]] + i)
                    out = {"anchor": out["anchor"].take(pa.array(some)), "hash": pa.array(hashes[some].view(np.int64)), "id": batch.column("id").take(row), "text_hash": batch.column("text_hash").take(row)}
                    out["at"] = lists(bounds, pa.array((starts - offsets[document] + base)[order].astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)

    if content:
        return docs.select("text").mapInArrow(task, "anchor long, content binary")
    return docs.select("text", "id", "text_hash").mapInArrow(task, "anchor long, hash long, id long, text_hash long, at array<long>")


def repeated_intervals(table: pa.Table, min_bytes: int) -> pa.RecordBatch:
    """Of one shard: byte intervals of each distinct segment whose windows stand at two places or more."""
    column = table.column("content").combine_chunks().cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data, offsets = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
    starts = repeated_windows(data, offsets, table.column("n").to_numpy(), min_bytes)
    of = np.searchsorted(offsets, starts, "right") - 1
    opens = np.ones(len(starts), bool)
    opens[1:] = (starts[1:] != starts[:-1] + 1) | (of[1:] != of[:-1])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(starts))[: len(first)] - 1
    of, low, high = of[first], starts[first], starts[last] + min_bytes
    return own_intervals(table, of, low - offsets[of], high - offsets[of])


def repeated_places(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, text_hash, at, own): of each segment of a document its places and the byte intervals to remove there."""
    counts, hot = final_anchors(docs, min_bytes)
    repeated = docs.sparkSession.sparkContext.broadcast(bitmap(counts, "anchor", FILTER_BITS))
    most = F.least("n", F.lit(2 * HOT_COUNT))  # counted more often are only segments of hot grams, mostly equal
    n_shards = max(1, -(-(counts.agg(F.sum(most)).first()[0] or 0) // SHARD_SEGMENTS))
    distinct = segments(docs, min_bytes, repeated, hot, True).groupBy("anchor", "content").agg(F.count("*").alias("n"))
    sharded = distinct.select("anchor", "content", "n", F.xxhash64("content").alias("hash"), F.pmod("anchor", F.lit(n_shards)).alias("shard"))
    sharded = sharded.repartition("shard").sortWithinPartitions("shard")

    def shards(batches):
        held, last = [], None
        for batch in batches:
            number = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    if held and number[i] != last:
                        yield repeated_intervals(pa.Table.from_batches(held), min_bytes)
                        held = []
                    last = number[i]
                    held.append(batch.slice(i, j - i))
        if held:
            yield repeated_intervals(pa.Table.from_batches(held), min_bytes)

    found = sharded.mapInArrow(shards, f"anchor long, hash long, {OWN}")
    return segments(docs, min_bytes, repeated, hot, False).join(found, ["anchor", "hash"]).select("id", "text_hash", "at", "own")


def find_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, text_hash, low, high): byte intervals to remove, in documents with columns text, id and text_hash."""
    return single(repeated_places(docs, min_bytes))


def _runs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by these intervals, which may overlap or touch."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    first = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]])) if len(low) else np.zeros(0, np.int64)
    return low[first], reach[np.append(first[1:], len(low)) - 1] if len(low) else reach


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """All rows with n_bytes, n_removed, n_spans, spans (maximal removed runs), kept (binary) and kept_sha256.

    docs needs doc_id and text; its other columns come along, text as it was.
    """
    docs, schema = extended(docs, "n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary, kept_sha256 string")
    names = docs.columns
    keyed = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(-(1 << 63))), "__hash": F.xxhash64("text")})
    found = repeated_places(keyed.select("text", F.col("__id").alias("id"), F.col("__hash").alias("text_hash")), min_bytes)
    joined = beside(keyed, found)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def task(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows, lows, highs = intervals(batch)
            edge = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            whole, out = data.tobytes(), {k: [] for k in ("n_removed", "n_spans", "spans", "kept")}
            for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), edge[:-1].tolist(), edge[1:].tolist()):
                low, high = _runs(lows[i:j], highs[i:j])
                edges = [0, *np.stack([low, high], axis=1).ravel().tolist(), b - a]
                out["kept"].append(b"".join(whole[a + i : a + j] for i, j in zip(edges[::2], edges[1::2])))
                out["spans"].append([{"start": i, "end": j} for i, j in zip(low.tolist(), high.tolist())])
                out["n_removed"].append(int((high - low).sum()))
                out["n_spans"].append(len(low))
            columns = {c: batch.column(c) for c in names}
            columns["n_bytes"] = pa.array(np.diff(offsets))
            columns |= {c: pa.array(out[c], pa.int64()) for c in ("n_removed", "n_spans")}
            columns |= {"spans": pa.array(out["spans"], span), "kept": pa.array(out["kept"], pa.binary()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out["kept"]], pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(task, schema)
