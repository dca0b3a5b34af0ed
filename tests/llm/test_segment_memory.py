"""What a Python worker takes beside a batch of texts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from flowtide.llm import substring
from flowtide.llm.text import binary


def test_segments_of_a_batch_take_little_memory():
    """Segments overlap, so their places as numbers are many times the text: 3 MB of texts took 150 MB."""
    r = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(vocabulary[r.integers(0, 5000, 600)]) for _ in range(1000)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    for words in (w for _, _, w in substring._slices(batch)):  # powers are made once
        words.hashes()
        break
    tracemalloc.start()
    n = 0
    for _, _, words in substring._slices(batch):
        found = substring.Segments(words, substring.MIN_WORDS)
        buffer, at = words.joined()
        begins, ends = at[found.starts], at[found.starts + found.lengths] - 1
        n += len(binary(buffer, begins, ends - begins))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 10_000 and peak < 40 << 20
