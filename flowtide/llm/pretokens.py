"""Encoding with a byte-level BPE of the tokenizers library, each distinct piece of text once.

A byte-level BPE splits a text by a fixed pattern and merges inside each piece, so equal pieces have
equal ids. The split is done in numpy over the code points of many texts; pieces not met before go
through the library's model, and ids of all texts are gathered from those of the pieces.
"""

from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

from .text import gather, span_hashes

SPACE, LETTER, NUMBER, OTHER = range(4)
MOST_PIECES = 500_000


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point: white space, letter, number or other."""
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, points):
            first = ord(points[m.start()])
            out[first : first + m.end() - m.start()] = kind
    return out


#: Fixed endings after an apostrophe that the pattern splits off.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of these texts begin; offsets as of Arrow, in code points."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds()[points]
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    new = text_start[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    starts = new.copy()
    # A run that follows white space takes one space of it along; any other white space there is a piece.
    after = np.flatnonzero(new[1:] & ~text_start[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    starts[after - 1] = True
    starts[after[points[after - 1] == 32]] = False
    # An apostrophe that begins a piece takes a fixed ending along.
    padded = np.concatenate([points, np.zeros(3, points.dtype)])
    for ending in ENDINGS:
        at = np.flatnonzero(starts & new & (points == 39))
        for k, c in enumerate(ending, 1):
            at = at[(at + k < n)]
            at = at[(padded[at + k] == ord(c)) & ~text_start[at + k]]
        starts[at + 1] = False
        end = at + 1 + len(ending)
        starts[end[end < n]] |= (kind[end[end < n]] == LETTER) | new[end[end < n]]
    return np.flatnonzero(starts)


def _byte_characters() -> dict[int, str]:
    """The library's characters for bytes: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class PieceEncoder:
    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        split = repr(tokenizer.pre_tokenizer)
        if tokenizer.normalizer is not None or not split.startswith("ByteLevel") or "add_prefix_space=False" not in split or "use_regex=True" not in split:
            raise ValueError(f"not a plain byte-level tokenizer with the split that is built in here: {split}")
        self.model, self.characters = tokenizer.model, _byte_characters()
        self.n_ids = tokenizer.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.starts, self.lengths, self.ids, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def _learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        tokenize, characters = self.model.tokenize, self.characters
        new = [[t.id for t in tokenize(p.decode("latin-1").translate(characters))] for p in pieces]
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter((i for ids in new for i in ids), np.uint32, int(lengths.sum()))
        first, end = len(self.known), len(self.known) + len(new)
        while len(self.starts) < end:
            self.starts, self.lengths = np.concatenate([self.starts, self.starts]), np.concatenate([self.lengths, self.lengths])
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, self.ids])
        self.starts[first:end], self.lengths[first:end] = self.used + np.cumsum(lengths) - lengths, lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.update(zip(hashes, range(first, end)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice, and how many each has."""
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        starts = heads[piece_starts(points, np.searchsorted(heads, offsets))] if len(points) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        hashes, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > MOST_PIECES:
            self._forget()
        keys = hashes.tolist()
        missing = [k for k, h in enumerate(keys) if h not in self.known]
        whole = data.tobytes()
        self._learn([keys[k] for k in missing], [whole[starts[first[k]] : ends[first[k]]] for k in missing])
        number = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[inverse]
        lengths = self.lengths[number]
        total = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offsets)]
        return self.ids[gather(self.starts[number], lengths)], np.diff(total)


@lru_cache(maxsize=1)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
