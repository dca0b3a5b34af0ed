"""Byte-level BPE by monoid tree reduction: spans are encoded apart and joined at their boundary.

A text is halved until spans are short; each is encoded by itself. Two neighbours are joined by encoding
a window around their boundary anew and keeping all tokens outside of it. The window grows until what is
outside provably can't change:

* Between a character that is no white space and a white space after it, the split pattern always cuts.
  So the window reaches from the last such cut of the left side to the first one of the right side.
* Inside one very long match of the pattern there is no cut. There, tokens are a correct encoding if and
  only if every two neighbours are one by themselves, so the window grows by tokens until the pairs at
  both its edges are.

Decoding concatenates the bytes of the two halves of the ids, down to short runs.

Defined results: null counts as empty, which has no tokens; special tokens' strings are ordinary text;
repeated rows are encoded each; the operator's columns replace input columns of the same names.
"""

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .storage import extended
from .text import released

LEAF_CHARACTERS, LEAF_BYTES, LEAF_IDS = 256, 96, 256
#: A run of this many characters without a cut is encoded match by match.
LONG_RUN = 256
NONE = 1 << 62

_LAST_CUT = regex.compile(r"(?r)[\p{L}\p{N}\p{P}\p{S}][ \n]")
_FIRST_CUT = regex.compile(r"[\p{L}\p{N}\p{P}\p{S}][ \n]")
_RUN = regex.compile(r"\P{White_Space}{%d}|\p{White_Space}{%d}" % (LONG_RUN, LONG_RUN))


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))

    def encode(self, text: str) -> list[int]:
        if len(text) <= LEAF_CHARACTERS:
            return self._leaf(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self._join(left, self.encode(left), right, self.encode(right))

    def _leaf(self, text: str) -> list[int]:
        if not _RUN.search(text):
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for piece in self.split.findall(text):
            out += self.encode_piece(piece.encode())
        return out

    def _join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        width, cut = 64, None
        while cut is None:
            cut = _LAST_CUT.search(left, pos=max(0, len(left) - width))
            if width >= len(left):
                break
            width *= 4
        begin = cut.start() + 1 if cut else 0
        width, cut = 64, None
        while cut is None:
            cut = _FIRST_CUT.search(right, endpos=min(len(right), width))
            if width >= len(right):
                break
            width *= 4
        end = cut.start() + 1 if cut else len(right)
        kept_left = len(left_ids) - self._covering(reversed(left_ids), len(left[begin:].encode()))
        kept_right = self._covering(right_ids, len(right[:end].encode()))
        return left_ids[:kept_left] + self._leaf(left[begin:] + right[:end]) + right_ids[kept_right:]

    def _covering(self, ids, n_bytes: int) -> int:
        """How many of the ids make up exactly so many bytes."""
        n = 0
        for i in ids:
            if n_bytes <= 0:
                break
            n_bytes -= len(self.tokens[i])
            n += 1
        assert n_bytes == 0, "a cut lies between tokens"
        return n

    def encode_piece(self, piece: bytes) -> list[int]:
        """Of one match of the pattern."""
        if len(piece) <= LEAF_BYTES:
            return self._short(piece)
        middle = len(piece) // 2
        return self._join_piece(self.encode_piece(piece[:middle]), self.encode_piece(piece[middle:]))

    def _short(self, piece: bytes) -> list[int]:
        """By the merge rule itself: of all neighbours that make a token, those of least rank first."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [self.ranks.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            ranks[i : i + 1] = []
            for k in (i - 1, i):
                if 0 <= k < len(ranks):
                    ranks[k] = self.ranks.get(parts[k] + parts[k + 1], NONE)
        return [self.ranks[x] for x in parts]

    def _join_piece(self, left: list[int], right: list[int]) -> list[int]:
        i, j, tokens = 1, 1, self.tokens
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self._short(b"".join(tokens[x] for x in left[len(left) - i :] + right[:j]))
            left_stays = i == len(left) or self._stay(left[-i - 1], window[0])
            right_stays = j == len(right) or self._stay(window[-1], right[j])
            if left_stays and right_stays:
                return left[: len(left) - i] + window + right[j:]
            i, j = i * (1 if left_stays else 2), j * (1 if right_stays else 2)

    def _stay(self, a: int, b: int) -> bool:
        return self._short(self.tokens[a] + self.tokens[b]) == [a, b]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return self.encoding.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """The columns of docs and ids (little-endian unsigned 32-bit integers); with decoded, also what they decode to."""
    docs, schema = extended(docs, "ids binary" + ", decoded binary" * decoded)
    names = docs.columns

    @released
    def task(batches):
        coder = codec(path, pattern)
        for batch in batches:
            ids = [coder.encode(text or "") for text in map(pa.StringScalar.as_py, batch.column("text"))]
            columns = {c: batch.column(c) for c in names} | {"ids": pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary())}
            if decoded:
                columns["decoded"] = pa.array(map(coder.decode, ids), pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(task, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of encoded and decoded: the bytes that ids stand for."""
    encoded, schema = extended(encoded, "decoded binary")

    @released
    def task(batches):
        decoder = codec(path, pattern)
        for batch in batches:
            out = [decoder.decode(np.frombuffer(ids.as_py(), "<u4").tolist()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in schema.names[:-1]} | {"decoded": pa.array(out, pa.binary())})

    return encoded.mapInArrow(task, schema)
