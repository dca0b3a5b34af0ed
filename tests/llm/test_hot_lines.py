"""Substring dedup where lines are frequent, against brute force."""

import random

import pytest

from flowtide.llm import substring

from .test_dedup import SCHEMA, brute_repeats


def beside_a_line(seed, line_words, pairs=40):
    """Pairs of texts that share few words and a line that stands in all texts, with different words around."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    draw = lambda n: [r.choice(words) for _ in range(n)]
    line, out = draw(line_words), []
    for k in range(pairs):
        shared = draw(35 - line_words + k % 3)
        both = shared + line if k % 2 else line + shared
        out += [" ".join(draw(r.randrange(20, 50)) + both + draw(r.randrange(20, 50))) for _ in range(2)]
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "en", 0.0) for i, t in enumerate(rows)], SCHEMA)
    got = substring.remove_repeats(df).orderBy("doc_id").collect()
    assert [(x.n_words, x.n_removed, x.kept_sha256) for x in got] == brute_repeats(rows)


@pytest.mark.parametrize("line_words", [8, 9, 12, 20, 26])
def test_repeats_beside_a_hot_line(spark, monkeypatch, line_words):
    monkeypatch.setattr(substring, "HOT_COUNT", 10)
    check(spark, beside_a_line(line_words, line_words))


@pytest.mark.parametrize("line_words", [20, 30, 60])
def test_segments_of_an_anchor_are_bounded(spark, monkeypatch, line_words):
    monkeypatch.setattr(substring, "HOT_COUNT", 10)
    most, segments = [], substring.segments

    def seen(docs, min_words, repeated, hot, content):
        found = segments(docs, min_words, repeated, hot, content)
        if content:
            most.append(found.distinct().groupBy("anchor").count().agg({"count": "max"}).first()[0])
        return found

    monkeypatch.setattr(substring, "segments", seen)
    r = random.Random(line_words)
    words = [f"w{i}" for i in range(3000)]
    draw = lambda n: [r.choice(words) for _ in range(n)]
    line, shared = draw(line_words), draw(10)
    check(spark, [" ".join(draw(40) + (shared if k % 5 == 0 else []) + line + draw(40)) for k in range(150)])
    assert most and most[0] <= 20
