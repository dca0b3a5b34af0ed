"""A HAT-trie of word-id sequences in numpy: burstable hash containers under a shallow trie.

A key is four word ids from 1 on (0: no word), two to a 64-bit number. A node of the trie stands for a prefix of
word ids and divides the ids that follow it into ranges; each range has a hash container of its own or a node.
A container that fills up bursts: its range is cut in two where that halves its keys, or, once it holds one
id alone, a node for that id takes its place. Subtrees leave whole, as sorted runs.
"""

from collections.abc import Iterator

import numpy as np

U = np.uint64
WORD_BITS = U(32)
#: Keys of a container before it bursts.
BURST = 1 << 16
WORDS = 4


def word_at(keys: np.ndarray, depth: int) -> np.ndarray:
    """The word id at a depth of keys of shape (n, 2)."""
    half = keys[:, depth // 2]
    return half >> WORD_BITS if depth % 2 == 0 else half & U(0xFFFFFFFF)


def _slots(keys: np.ndarray, n: int) -> np.ndarray:
    x = keys[:, 0] * U(0x9E3779B97F4A7C15) ^ (keys[:, 1] + U(0x632BE59BD9B4E019)) * U(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> U(32))) & U(n - 1)).astype(np.int64)


class Container:
    """Counts of keys by open addressing; the keys of a batch are placed together, round by round."""

    def __init__(self, slots: int = 1 << 10):
        self.keys, self.counts, self.size = np.zeros((slots, 2), U), np.zeros(slots, np.int64), 0
        self.last = np.zeros(slots, np.int32)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        used = np.flatnonzero(self.counts)
        return self.keys[used], self.counts[used]

    def _grow(self, slots: int) -> None:
        keys, counts = self.items()
        self.__init__(slots)
        self._place(keys, counts)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Counts of keys, which may repeat; a part at a time, so that half of the slots stay free."""
        while len(keys):
            room = len(self.counts) // 2 - self.size
            if room < min(len(keys), len(self.counts) // 4):
                self._grow(max(2 * len(self.counts), min(4 * BURST, 1 << (2 * len(keys)).bit_length())))
                continue
            self._place(keys[:room], counts[:room])
            keys, counts = keys[room:], counts[room:]

    def _place(self, keys: np.ndarray, counts: np.ndarray) -> None:
        n, at = len(self.counts), _slots(keys, len(self.counts))
        while len(at):
            free = np.flatnonzero(self.counts[at] == 0)
            if len(free):  # of keys that ask for one free slot the last has it
                slots = at[free]
                self.last[slots] = free
                won = free[self.last[slots] == free]
                self.keys[at[won]] = keys[won]
                self.size += len(won)
            held = (self.keys[at] == keys).all(axis=1)
            np.add.at(self.counts, at[held], counts[held])
            rest = np.flatnonzero(~held)
            keys, counts, at = keys[rest], counts[rest], (at[rest] + 1) & (n - 1)


class Node:
    """Ranges of the word ids at a depth, by their least ids, each with a container or a node."""

    def __init__(self, depth: int):
        self.depth = depth
        self.lows, self.children = np.zeros(1, U), [Container()]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        child = np.searchsorted(self.lows, word_at(keys, self.depth), "right") - 1
        order = np.argsort(child, kind="stable")
        bounds = np.searchsorted(child[order], np.arange(len(self.children) + 1))
        full = []
        for i, node in enumerate(self.children):
            if bounds[i] < bounds[i + 1]:
                own = order[bounds[i] : bounds[i + 1]]
                node.add(keys[own], counts[own])
                if isinstance(node, Container) and node.size > BURST:
                    full.append(i)
        for i in reversed(full):
            self._burst(i)

    def _burst(self, i: int) -> None:
        keys, counts = self.children[i].items()
        word = word_at(keys, self.depth)
        low, high = word.min(), word.max()
        if low == high:
            if self.depth + 1 == WORDS:
                return
            child, start = Node(self.depth + 1), self.lows[i]
            child.add(keys, counts)
            end = self.lows[i + 1] if i + 1 < len(self.lows) else None
            self.children[i], self.lows[i] = child, low
            if end is None or low + U(1) < end:
                self._insert(i + 1, low + U(1), Container())
            if start < low:
                self._insert(i, start, Container())
            return
        cut = np.partition(word, len(word) // 2)[len(word) // 2]
        cut = word[word > low].min() if cut == low else cut
        below = word < cut
        self.children[i] = Container()
        self.children[i].add(keys[below], counts[below])
        self._insert(i + 1, cut, Container())
        self.children[i + 1].add(keys[~below], counts[~below])
        for k in (i + 1, i):
            if self.children[k].size > BURST:
                self._burst(k)

    def _insert(self, i: int, low, child) -> None:
        self.lows = np.insert(self.lows, i, low)
        self.children.insert(i, child)

    def size(self) -> int:
        return sum(c.size if isinstance(c, Container) else c.size() for c in self.children)

    def items(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs, in their order."""
        for child in self.children:
            if isinstance(child, Node):
                yield from child.items()
            elif child.size:
                keys, counts = child.items()
                order = np.lexsort((keys[:, 1], keys[:, 0]))
                yield keys[order], counts[order]


class HatTrie:
    """Counts of word-id sequences, of which at most about `most` distinct ones are held."""

    def __init__(self, most: int):
        self.most, self.root = most, Node(0)

    def add(self, keys: np.ndarray) -> None:
        for i in range(0, len(keys), 1 << 18):
            part = keys[i : i + (1 << 18)]
            self.root.add(part, np.ones(len(part), np.int64))

    def spill(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Where too much is held, the largest subtrees under the root leave whole, as sorted runs, until half is left."""
        sizes = [c.size if isinstance(c, Container) else c.size() for c in self.root.children]
        held = sum(sizes)
        if held <= self.most:
            return
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            if held <= self.most // 2:
                return
            yield from self._leave(i)
            held -= sizes[i]

    def _leave(self, i: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        child = self.root.children[i]
        one = Node(0)
        one.lows, one.children = self.root.lows[i : i + 1], [child]
        self.root.children[i] = Container()
        yield from one.items()

    def flush(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        root, self.root = self.root, Node(0)
        yield from root.items()
