"""Source divergence and phrase collocations against plain Python and their SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from flowtide.llm import divergence, hattrie, phrases, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n double, term string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=3, n=120):
    r = random.Random(seed)
    words = ["The", "ÉTÉ", "été", "of", "x1y", "don't", "naïve", "a", "deep", "sea", "b2b", "über", "z"]
    rows = []
    for i in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "! "]) for _ in range(r.randrange(0, 40)))
        rows.append((i, text, r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", None, "é"]), 1.0, "mine"))
    rows += [rows[0], rows[0], (900, None, "en", "s9", 1.0, None), (901, "", "xx", "s1", 1.0, None), (902, "", "xx", "s2", None, None), (903, "deep sea " * 5000, "en", "s1", 1.0, None)]
    return rows


def audited(rows, min_docs, top):
    tokens = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for _, t, l, s, *_ in rows]
    in_docs, counts, out = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, w in tokens:
        in_docs[lang].update(set(w))
        counts[lang, source].update(w)
    for lang in in_docs:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole, each = p(sum(groups.values(), Counter())), {s: p(c) for s, c in groups.items()}
        for s, mine in each.items():
            pairs = sorted((-sum(abs(mine[t] - q[t]) for t in kept), o.encode(), o) for o, q in each.items() if o != s)
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            terms = sorted((whole[t] - mine[t], t.encode(), t) for t in kept if groups[s][t] and mine[t] > whole[t])
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:top])}
    return out


@pytest.mark.parametrize("block, cells, held", [(1 << 18, 1 << 22, 1 << 18), (4, 6, 5)])
def test_divergence(spark, monkeypatch, block, cells, held):
    """Also with blocks of few terms and chunks of few rows."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CELLS", cells)
    rows = corpus()
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), 8, top_terms=4).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == audited(rows, 8, 4)
    assert any(r.part == "pair" and r.lang == "xx" and r.value == 0 for r in got)


def test_slices_of_a_unit():
    """A unit gives the same sums however its postings are cut."""
    import pyarrow as pa

    r = np.random.default_rng(2)
    term = np.sort(r.integers(0, 40, 200))
    code = np.concatenate([np.sort(r.choice(12, n, replace=False)) for n in np.bincount(term, minlength=40) if n <= 12])
    term = np.concatenate([np.full(n, t) for t, n in enumerate(np.bincount(term, minlength=40)) if n <= 12])
    p, z = r.integers(50, 90, len(code)), r.integers(1, 50, 12)

    def sums(step):
        unit = divergence.Unit("en", 1, 0)
        unit.header(np.arange(12), z, 40, 12)
        for i in range(0, len(code), step):
            unit.add(pa.array(term[i : i + step].astype(str)), code[i : i + step], p[i : i + step])
            unit.scatter(False)
        return sorted(map(tuple, pa.Table.from_batches(list(unit.finish())).group_by(["low", "high"]).aggregate([("value", "sum")]).to_pandas().values.tolist()))

    assert sums(len(code)) == sums(1) == sums(7)


def mined(rows, min_count, top):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        kept, longer = [], {p: a for p, a in c.items() if a >= min_count and len(p) > 2}
        for p, a in c.items():
            if a >= min_count and len(p) > 1:
                inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in longer.items())
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                if not inside:
                    kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def test_collocations(spark):
    rows = corpus(seed=5, n=400)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, phrases.collocations(docs, 4, top=30).collect())) == mined(rows, 4, 30)
    assert sorted(map(tuple, phrases.collocations(docs, 9).collect())) == mined(rows, 9, 2000)


def test_long_words(spark, monkeypatch):
    """Words of any length, in a task that holds few bytes of them."""
    counter = phrases.Counter((1, 2))
    monkeypatch.setattr(phrases, "MOST_BYTES", 2000)
    import pyarrow as pa

    words = [b"x" * 900, b"y", b"z" * 1500] * 7
    ids = counter.vocabulary.number(pa.array(words, pa.binary()))
    found = Counter()
    every = np.ones(len(ids), bool)
    joins = np.append(every[1:], False)
    for batch in [*counter.add("en", ids, joins, every), *counter.relieve(), *counter.flush()]:
        assert sum(len(p) for p in batch.column("phrase").to_pylist()) <= 2500
        for p, n in zip(batch.column("phrase").to_pylist(), batch.column("n").to_pylist()):
            found[p] += n
    assert found == Counter(words) + Counter(a + b" " + b for a, b in zip(words, words[1:]))


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(empty).collect() == [] and phrases.collocations(empty).collect() == []


@pytest.mark.parametrize("most", [300, 10**9])
def test_hat_trie(monkeypatch, most):
    monkeypatch.setattr(hattrie, "BURST", 32)
    r, trie, want, got = np.random.default_rng(1), hattrie.HatTrie(most), Counter(), Counter()

    def take(runs):
        for keys, counts in runs:
            rows = [tuple(k) for k in keys.tolist()]
            assert rows == sorted(set(rows))
            for k, n in zip(rows, counts.tolist()):
                got[k] += n

    for _ in range(10):
        words = (r.zipf(1.3, (300, 4)) % 50 + 1).astype(np.uint64)
        for k in range(1, 4):
            words[r.integers(1, 5, 300) <= k, k:] = 0
        keys = np.stack([words[:, 0] << np.uint64(32) | words[:, 1], words[:, 2] << np.uint64(32) | words[:, 3]], axis=1)
        want.update(map(tuple, keys.tolist()))
        trie.add(keys)
        take(trie.spill())
        assert trie.root.size() <= most
    take(trie.flush())
    assert got == want


@pytest.mark.parametrize("name", ["op11_divergence", "op12_collocations"])
def test_queries(spark, name):
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
