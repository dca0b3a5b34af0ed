"""Suffix order by difference cover, and byte dedup, against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowtide.llm import bytededup, queries, suffixes
from flowtide.llm.suffixes import suffix_array

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_bytes double, spans string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols, np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_suffixes_of_long_runs():
    symbols = np.array([1] * 4000 + [2, 300_000] + [1] * 3000, np.int64)
    order = suffix_array(symbols)
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for x in data:
        for i in range(len(x) - width + 1):
            seen[x[i : i + width]] = seen.get(x[i : i + width], 0) + 1
    out = []
    for x in data:
        cut = [False] * len(x)
        for i in range(len(x) - width + 1):
            if seen[x[i : i + width]] > 1:
                cut[i : i + width] = [True] * width
        spans = [i for i, c in enumerate(cut) if c and not (i and cut[i - 1])]
        out.append((len(x), sum(cut), len(spans), hashlib.sha256(bytes(b for b, c in zip(x, cut) if not c)).hexdigest()))
    return out


def check(spark, texts, width):
    df = spark.createDataFrame([(i, t, 0.5, "mine") for i, t in enumerate(texts)], SCHEMA)
    got = bytededup.remove_repeats(df, width).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute(texts, width)
    for r, text in zip(got, texts):
        whole, at, kept = (text or "").encode(), 0, b""
        for s in r.spans:
            kept, at = kept + whole[at : s.start], s.end
        assert bytes(r.kept) == kept + whole[at:] and r.text == text


def mixed(seed, n=60):
    r = random.Random(seed)
    draw = lambda k: "".join(r.choice("abcdé ü") for _ in range(k))
    shared = [draw(r.randrange(20, 90)) for _ in range(6)]
    texts = [draw(r.randrange(0, 80)) + r.choice(shared) + draw(r.randrange(0, 80)) for _ in range(n)]
    return [*texts, texts[0], texts[0], None, "", "a", "ab" * 200, "x" * 300, draw(31)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, monkeypatch, seed):
    monkeypatch.setattr(bytededup, "SHARD_SEGMENTS", 40)
    check(spark, mixed(seed), 32)


@pytest.mark.parametrize("line", [20, 30, 60])
def test_repeats_beside_a_hot_line(spark, monkeypatch, line):
    """A line in all texts with other bytes around, beside which some texts share a few more."""
    monkeypatch.setattr(bytededup, "HOT_COUNT", 10)
    r = random.Random(line)
    draw = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    common, beside = draw(line), draw(max(4, 34 - line))
    check(spark, [draw(40) + (beside if k % 5 == 0 else "") + common + (beside if k % 7 == 0 else "") + draw(40) for k in range(120)], 32)


def test_a_long_text_is_read_in_pieces(spark):
    r = random.Random(5)
    draw = lambda k: "".join(r.choices("abcdefgh", k=k))
    long, end = draw(1_200_000), bytededup.PIECE_BYTES
    check(spark, [long, draw(50) + long[333:480] + draw(20), long[-950:], draw(90), draw(500) + long[end - 40 : end + 40], long[end - 300 : end - 200]], 32)


def test_no_rows(spark):
    assert bytededup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_op13(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_byte_dedup(spark, SF).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == {r[0]: r[1:] for r in con.sql(queries.ORACLE_SQL["op13_byte_dedup"]).fetchall()}
    assert any(r[1] for r in got.values())


@pytest.mark.parametrize("bound", [(1 << 40) - 1, (1 << 62) - 1])
def test_keys_in_order(bound):
    """Keys that leave room for their places are sorted as words with them, others by their places."""
    keys = np.random.default_rng(5).integers(0, bound, 3000)
    keys[1000:2000] = keys[:1000]
    order, ranked = suffixes._order(keys, bound)
    assert (ranked == np.sort(keys)).all() and (keys[order] == ranked).all() and sorted(order.tolist()) == list(range(3000))


def test_suffixes_of_large_symbols():
    """Triples that pass 62 bits are named in two steps."""
    r = random.Random(6)
    symbols = [r.choice([1, 2, 1 << 33, (1 << 33) + 1]) for _ in range(500)]
    assert suffix_array(np.array(symbols, np.int64)).tolist() == sorted(range(500), key=lambda i: symbols[i:])
