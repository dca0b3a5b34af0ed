"""Texts that say the same over and over: one segment at many places of a document."""

import random

import numpy as np
import pyarrow as pa
import pytest

from flowtide.llm import bytededup, places, substring

from . import test_bytes, test_hot_lines


def pairs_of_words(seed, n=40):
    r = random.Random(seed)
    draw = lambda k: " ".join(r.choice([f"w{i}" for i in range(900)]) for _ in range(k))
    return [f"{draw(20)} {'onhe. Is ' * r.randrange(60, 90)}{draw(20)} {'onhe. Is ' * r.randrange(0, 40)}" for _ in range(n)]


@pytest.mark.parametrize(("module", "check"), [(substring, test_hot_lines.check), (bytededup, lambda spark, rows: test_bytes.check(spark, rows, 100))])
def test_a_segment_is_one_row_of_a_document(spark, monkeypatch, module, check):
    """What goes into the join doesn't grow with the places that a segment has in a document."""
    rows, segments = [], module.segments

    def seen(docs, least, repeated, hot, content):
        found = segments(docs, least, repeated, hot, content)
        if not content:
            rows.append((found.count(), found.select("anchor", "hash", "id", "text_hash").distinct().count()))
        return found

    monkeypatch.setattr(module, "segments", seen)
    texts = pairs_of_words(1)
    check(spark, [*texts, texts[0], texts[0], None])
    assert len(rows) == 1 and rows[0][0] <= rows[0][1] + 2 * rows[0][1] // len(texts) and rows[0][0] < 12 * len(texts)


def test_intervals_at_places():
    """Each interval of a segment at each of its places, by rows; rows without any among them."""
    cut = {"__at": [None, [[0, 10], [5]], [[]], [], [[1]]], "__low": [None, [[1], [0, 2]], [[3]], [], [[]]], "__high": [None, [[4], [1, 6]], [[4]], [], [[]]]}
    got = places.intervals(pa.RecordBatch.from_pydict({k: pa.array(v, pa.list_(pa.list_(pa.int64()))) for k, v in cut.items()}))
    assert list(zip(*(x.tolist() for x in got))) == [(1, 1, 4), (1, 11, 14), (1, 5, 6), (1, 7, 11)]


def test_together():
    order, bounds = places.together(np.array([2, 1, 2, 1]), np.array([5, 5, 5, 4]))
    assert order.tolist() == [3, 1, 0, 2] and bounds.tolist() == [0, 1, 2, 4]
