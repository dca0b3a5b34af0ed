"""Numpy on the UTF-8 buffers of Arrow columns: words, their hashes, and n-grams of words.

A slice is a run of whole documents of one Arrow batch, so work arrays stay bounded however large a
batch is; a longer document is a slice by itself.
"""

from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Arrow's own pool keeps what tasks have freed; plain allocation gives it back.
pa.set_memory_pool(pa.system_memory_pool())

SLICE_BYTES = (1 << 20) - 1
SLICE_DOCS = 4096
#: Bytes of a slice where work arrays are many times its size, so that they stay small and in a processor's cache.
SMALL_BYTES = (1 << 17) - 1

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_STEP = U(0xD6E8FEB86659FD93)


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


#: Between words stand only these: space and tab to carriage return.
SPACES = _table(b" \t\n\x0b\x0c\r")
#: Between terms stand all ASCII characters but letters and digits.
NOT_TERM = _table(bytes(c for c in range(128) if not chr(c).isalnum()))
#: Between terms of letters alone stand all ASCII characters but letters.
NOT_LETTER = _table(bytes(c for c in range(128) if not chr(c).isalpha()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and the n + 1 offsets of the values in them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most_bytes: int = SLICE_BYTES, most_docs: int = SLICE_DOCS) -> Iterator[tuple[int, int]]:
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1
        j = min(n, i + most_docs, max(j, i + 1))
        yield i, j
        i = j


def released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task for mapInArrow that gives freed memory back at its end: Spark keeps its process for other tasks."""

    @wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each bit depends on all (the splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=1)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = U(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = U(1)
    return np.cumprod(up), np.cumprod(down)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of these spans of bytes, from differences of one running sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(max(20, len(data).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a slice: where they are, whose they are, and a 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACES):
        self.data, self.offsets = data, offsets
        self.inside = inside = ~between[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins = offsets[:-1][offsets[:-1] < len(data)]
        first[begins] = inside[begins]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = inside[ends]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Of each document its first word's number, and at the end the number of words.
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def document(self) -> np.ndarray:
        """The number of each word's document in the slice."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def left(self) -> np.ndarray:
        """How many words of its document begin at each word, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with one space behind each, and where each begins there (one more: the end)."""
        lengths = self.ends - self.starts
        at = np.concatenate([[0], np.cumsum(lengths + 1)])
        out = np.full(int(at[-1]), 32, np.uint8)
        kept = self.data[self.inside]
        out[np.arange(len(kept)) + np.repeat(np.arange(len(self)), lengths)] = kept
        return out, at


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive items from each position on, as far as there are k."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _STEP + hashes[i : i + n]
    return mix(out)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    at = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - at, lengths)


def binary(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow array of these runs of bytes, which may overlap."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    values = data[gather(starts, lengths)] if len(starts) else np.zeros(0, np.uint8)
    large = pa.large_binary() if kind in (None, pa.binary()) else pa.large_string()
    return pa.Array.from_buffers(large, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(kind or pa.binary())
