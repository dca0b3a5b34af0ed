"""Suffix arrays by difference cover modulo 3, in numpy.

Positions i with i % 3 in (1, 2) are the sample. Their triples are sorted and named; where two share a name,
the string of names is sorted the same way. The remaining suffixes are ordered by their first symbol and the
rank of the sampled suffix behind it, and merged into the sampled ones. Symbols past the end count as 0.
"""

import numpy as np


def _order(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the keys in their order, and the keys in it; keys are at most `bound`.

    Where a key and its place fit into a word, words are sorted, which is cheaper than to sort places by their keys.
    """
    bits = len(keys).bit_length()
    if bound < 1 << (63 - bits):
        words = (keys << bits) | np.arange(len(keys))
        words.sort()
        return words & ((1 << bits) - 1), words >> bits
    order = np.argsort(keys)
    return order, keys[order]


def _named(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The order of the keys, names from 1 on that are equal where keys are, and how many names there are."""
    order, ranked = _order(keys, bound)
    steps = np.empty(len(keys), np.int32)
    steps[:1], steps[1:] = 1, ranked[1:] != ranked[:-1]
    np.cumsum(steps, out=steps)
    names = np.empty(len(keys), np.int32)
    names[order] = steps
    return order, names, int(steps[-1]) if len(steps) else 0


def _keys(high: np.ndarray, top: int, low: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Numbers that are ordered as the pairs are, and a bound of them; high is at most `top` and low at most `most`."""
    if (top + 1) * (most + 1) >= 1 << 62:
        _, high, top = _named(high, top)
    return high.astype(np.int64) * (most + 1) + low, (top + 1) * (most + 1) - 1


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The places of all suffixes in their order; symbols are integers from 1 on."""
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    most = int(symbols.max())
    s = np.zeros(n + 5, np.int32 if most < 1 << 31 else np.int64)
    s[:n] = symbols
    # One more place of class 1 where n % 3 is 1, so that every class 0 suffix has a sampled one behind it.
    n_zeros, n_ones, n_twos = (n + 2) // 3, (n + 1) // 3 + (n % 3 == 1), n // 3
    of = lambda at, count: s[at : at + 3 * count : 3]
    sample = lambda ahead: np.concatenate([of(1 + ahead, n_ones), of(2 + ahead, n_twos)])
    pairs, bound = _keys(sample(0), most, sample(1), most)
    order, names, n_names = _named(*_keys(pairs, bound, sample(2), most))
    if n_names < n_ones + n_twos:
        order = suffix_array(names)
    ranks = n_ones + n_twos
    rank = np.empty(ranks, np.int32)
    rank[order] = np.arange(1, ranks + 1, dtype=np.int32)
    # Ranks of the suffixes of class 1 and 2; 0 stands past the end.
    ones, twos = np.zeros((2, n_ones + 1), np.int32)
    ones[:n_ones], twos[:n_twos] = rank[:n_ones], rank[n_ones:]
    zeros, bound = _keys(of(0, n_zeros), most, ones[:n_zeros], ranks)
    rest, _ = _order(zeros, bound)
    # How many sampled suffixes of either class come before each of the rest.
    first, second = order[order < n_ones], order[order >= n_ones] - n_ones
    first = first[3 * first + 1 < n]
    beside = lambda at, places, behind: of(at, n_ones)[places].astype(np.int64) * (ranks + 1) + behind[places]
    before = np.searchsorted(beside(1, first, twos), beside(0, rest, ones))
    both = lambda ahead: np.concatenate([of(2 + ahead, n_twos)[second], of(ahead, n_zeros)[rest]])
    pairs, bound = _keys(both(0), most, both(1), most)
    wide, _ = _keys(pairs, bound, np.concatenate([ones[second + 1], twos[rest]]), ranks)
    before += np.searchsorted(wide[:n_twos], wide[n_twos:])
    out = np.empty(n, np.int64)
    at = before + np.arange(n_zeros)
    free = np.ones(n, bool)
    free[at] = False
    sampled = np.where(order < n_ones, 3 * order + 1, 3 * (order - n_ones) + 2)
    out[at], out[free] = 3 * rest, sampled[sampled < n]
    return out


def equal_neighbours(data: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Whether the width bytes from each place on are those from the place before it in the list."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,)).copy()
    a, b, alive = places[:-1], places[1:], np.arange(max(0, len(places) - 1))
    # Neighbours agree at their beginning, so what lies behind is looked at first; every byte is.
    for at in sorted({*range(0, width - 7, 8), max(0, width - 8)}, reverse=True):
        alive = alive[words[a[alive] + at] == words[b[alive] + at]]
    out = np.zeros(len(places), bool)
    out[alive + 1] = True
    return out


def repeated_windows(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Places where a window of width bytes begins that begins elsewhere too, inside these strings, sorted.

    A string i, from offsets[i] on, stands counts[i] times: the suffixes of a run of equal windows in suffix
    order are counted with what their strings stand for. width is 8 or more.
    """
    lengths = np.diff(offsets)
    gaps = np.arange(len(lengths))  # a symbol 1 behind each string
    spaced = np.ones(len(data) + len(lengths), np.int64)
    own = np.arange(len(data)) + np.repeat(gaps, lengths)
    spaced[own] = data.astype(np.int64) + 2
    order = suffix_array(spaced)
    del spaced
    place = np.full(len(data) + len(lengths), -1, np.int64)
    whole = np.arange(len(data)) + width <= np.repeat(offsets[1:], lengths)
    place[own[whole]] = np.flatnonzero(whole)
    places = place[order]
    places = places[places >= 0]
    if not len(places):
        return places
    run = np.cumsum(~equal_neighbours(data, places, width)) - 1
    string = np.searchsorted(offsets, places, "right") - 1
    times = np.bincount(run, weights=counts[string].astype(np.float64))
    return np.sort(places[times[run] > 1])
