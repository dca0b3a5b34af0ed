"""A compressed FM-index over many integer strings, asked for matching statistics of many places at once.

The Burrows-Wheeler transform is held as a wavelet matrix: one bit vector for each bit of a symbol, with the
ones before each 64 bits counted, so n symbols out of m take 1.5 * n * log2(m) bits, whatever the length
of the words that they stand for. Suffixes are sorted in full (to the end of their string) by doubling.
"""

import numpy as np

U = np.uint64


class Bits:
    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.uint32)
        self.zeros = len(bits) - int(counts.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        word = at >> 6
        mask = (U(1) << (at & 63).astype(np.uint64)) - U(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.n_levels = max(1, int(n_symbols - 1).bit_length())
        self.levels = []
        for level in range(self.n_levels):
            bit = (symbols >> (self.n_levels - 1 - level)) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.begin = np.zeros(n_symbols, np.int64)
        self.begin = self.rank(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        for level, bits in enumerate(self.levels):
            one = (symbols >> (self.n_levels - 1 - level)) & 1 == 1
            ones = bits.ones(at)
            at = np.where(one, bits.zeros + ones, at - ones)
        return at - self.begin[symbols]


class FMIndex:
    def __init__(self, symbols: np.ndarray, left: np.ndarray):
        """symbols: ids from 0 of all places of all strings; left: places of its string from each on, itself included."""
        n = len(symbols)
        self.n_symbols = int(symbols.max()) + 2  # 0 stands where a string begins
        symbols = symbols + 1
        rank, reach, longest = symbols, 1, int(left.max())
        while True:
            later = np.zeros(n, np.int64)
            some = np.flatnonzero(left > reach)
            later[some] = rank[some + reach]
            key = rank * (int(rank.max()) + 1) + later
            reach *= 2
            if reach >= longest:
                break
            _, rank = np.unique(key, return_inverse=True)
            rank = rank + 1
        order = np.argsort(key, kind="stable")
        before = np.zeros(n, np.int64)
        some = np.flatnonzero(left > 1) + 1
        before[some] = symbols[some - 1]
        last = left == 1
        transform = np.concatenate([symbols[last], before[order]])  # empty suffixes, one a string, come first
        counts = np.bincount(symbols, minlength=self.n_symbols)
        counts[0] = int(last.sum())
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        self.wavelet = WaveletMatrix(transform, self.n_symbols)

    def longest(self, symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int = 2) -> np.ndarray:
        """Matching statistics: where the longest match that ends at each end begins, not before its begin.

        A match is a run of symbols that the index holds `least` times or more. All ends go backward in
        lockstep; those whose match is over drop out.
        """
        out = ends.copy()
        lanes = np.flatnonzero(ends > begins)
        c = symbols[ends[lanes] - 1] + 1
        low, high = self.smaller[c], self.smaller[c + 1]
        while len(lanes):
            found = high - low >= least
            lanes, low, high = lanes[found], low[found], high[found]
            out[lanes] -= 1
            on = out[lanes] > begins[lanes]
            lanes, low, high = lanes[on], low[on], high[on]
            c = symbols[out[lanes] - 1] + 1
            ranks = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([low, high]))
            low, high = self.smaller[c] + ranks[: len(c)], self.smaller[c] + ranks[len(c) :]
        return out
