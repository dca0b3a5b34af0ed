"""Substring dedup and SimHash against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowtide.llm import nearcopies, simhash, substring
from flowtide.llm.fmindex import FMIndex

SCHEMA = "doc_id long, text string, lang string, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    draw = lambda n: [r.choice(words) for _ in range(n)]
    passage, opening = draw(60), draw(9)
    out = [None, "", "  \n\t", "one two", " ".join(draw(34)), " ".join(draw(35))]
    out += [" ".join(opening + draw(r.randrange(20, 90))) for _ in range(30)]
    out += [" ".join(draw(r.randrange(30)) + passage[: r.randrange(30, 60)] + draw(r.randrange(30))) for _ in range(15)]
    out += ["\n".join(passage), "  ".join(passage), "a " * 100, " ".join(draw(40) * 3), " ".join(draw(3000))]
    out += [out[6], out[6] + " more", " ".join(passage[5:45] + draw(5) + passage[:40])]
    return out


def brute_repeats(rows, n=35):
    lists = [WORD.findall(t or "") for t in rows]
    seen = Counter(tuple(w[i : i + n]) for w in lists for i in range(len(w) - n + 1))
    out = []
    for w in lists:
        cut = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                cut.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in cut)
        out.append((len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_brute_force(spark, monkeypatch):
    rows = texts()
    for hot in (10_000, 5):  # with 5, the opening line and the passage have frequent anchors
        monkeypatch.setattr(substring, "HOT_COUNT", hot)
        monkeypatch.setattr(substring, "SHARD_SEGMENTS", 20)
        df = spark.createDataFrame([(i, t, "en", 0.0) for i, t in enumerate(rows)], SCHEMA)
        got = substring.remove_repeats(df).orderBy("doc_id").collect()
        assert [(x.n_words, x.n_removed, x.kept_sha256) for x in got] == brute_repeats(rows)
        assert all(x.text == rows[x.doc_id] for x in got if not x.n_removed)
        assert any(x.n_removed for x in got)


def test_matching_statistics_brute_force():
    """The longest match that ends at each word, within its string, of all matches that occur twice."""
    r = random.Random(8)
    strings = [[r.randrange(4) for _ in range(r.randrange(1, 40))] for _ in range(30)]
    strings += [strings[3] + strings[4], strings[5][:12]]
    symbols = np.array([x for s in strings for x in s])
    first = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    left = np.concatenate([np.arange(len(s), 0, -1) for s in strings])
    seen = Counter(tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1))
    of = np.repeat(np.arange(len(strings)), np.diff(first))
    ends = np.arange(1, len(symbols) + 1)
    got = FMIndex(symbols, left).longest(symbols, first[of], ends)
    for end, begin, s in zip(ends.tolist(), got.tolist(), of.tolist()):
        own = strings[s][: end - first[s]]
        assert end - begin == max((n for n in range(len(own) + 1) if n == 0 or seen[tuple(own[-n:])] > 1))


def test_substring_rows(spark):
    rows = [(None, "x " * 40, "en", 0.0), (1, " ".join(map(str, range(50))), None, None), (1, " ".join(map(str, range(50))), None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit("clash"))
    got = substring.remove_repeats(df).collect()
    assert sorted((x.n_words, x.n_removed) for x in got) == [(40, 40), (50, 50), (50, 50)]
    assert substring.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_simhash(text, n=3):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_brute_force(spark):
    rows = texts() + ["Ünï CODE Wörds É", "ünï code wörds É"]
    df = spark.createDataFrame([(i, t, "en", 0.0) for i, t in enumerate(rows)], SCHEMA)
    got = simhash.near_duplicates(df).orderBy("doc_id").collect()
    fps = [brute_simhash(t) for t in rows]
    assert [x.fingerprint for x in got] == [f"{f:016x}" for f in fps]
    assert [x.component_id for x in got] == brute_components(fps)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(brute_components(fps)))


def test_links_in_blocks(spark):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(150)]
    for _ in range(450):
        x = r.choice(fps)
        for _ in range(r.randrange(1, 5)):
            x ^= 1 << r.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    for block in (100_000, 7):
        found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block_rows=block).collect()
        parent = {x: x for x in signed}

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for u, v in found:
            assert bin((u ^ v) & (2**64 - 1)).count("1")
            a, b = find(u), find(v)
            parent[a] = b
        groups = brute_components(fps)
        assert len({find(x) for x in signed}) == len(set(groups))
        assert len({(find(x), g) for x, g in zip(signed, groups)}) == len(set(groups))


def test_simhash_rows(spark):
    rows = [(None, "a b c d e f", "en", 0.0), (7, "a b c d e f", None, None), (7, "a b c d e f", None, None), (None, "other words here", "en", 0.0)]
    got = {(x.doc_id, x.component_id) for x in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(None, 7), (7, 7), (None, None)}
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(x.text for x in kept) == ["a b c d e f", "other words here"] and [x.doc_id for x in kept if x.text[0] == "a"] == [7]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_shingles(text, n=5):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_near(texts, similarity=0.8):
    """Components of texts by Jaccard similarity of their shingle sets."""
    sets, parent = [brute_shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle, common = {}, Counter()
    for i, s in enumerate(sets):
        for x in s or {()}:
            by_shingle.setdefault(x, []).append(i)
    for members in by_shingle.values():
        common.update((i, j) for k, i in enumerate(members) for j in members[k + 1 :])
    for (i, j), n in common.items():
        if not sets[i] or n >= similarity * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(texts))]


def near_texts(seed=6):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    out = [None, "", " \n", "One two", "one TWO", "one two three", " ".join(r.choices(words, k=9000))]
    for _ in range(25):
        base = r.choices(words, k=r.randrange(60, 400))
        out.append(" ".join(base))
        for share in (0.002, 0.01, 0.018, 0.05, 0.3):
            out.append(" ".join(r.choice(words) if r.random() < share else w for w in base))
    return out + out[10:14]


@pytest.mark.parametrize("block_rows", [20_000, 3])
def test_near_copies_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", block_rows)
    rows = near_texts()
    df = spark.createDataFrame([(i, t, "en", 0.0) for i, t in enumerate(rows)], SCHEMA).withColumn("uid", F.lit("clash"))
    kept = nearcopies.keep_one(df)
    assert kept.columns == df.columns
    got, want = {x.doc_id for x in kept.collect()}, set(brute_near(rows))
    assert len(got ^ want) <= 2 and len(want) < len(rows) - 40  # a pair at the very threshold may be missed
    assert nearcopies.keep_one(df.limit(0)).count() == 0


def test_near_copies_of_documents(spark):
    """Recall on the given documents: links of pairs of 0.8 and more, between different texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    got, want = nearcopies.keep_one(docs).count(), len(set(brute_near(texts)))
    assert want <= got <= want + 0.1 * (len(set(texts)) - want)


def test_near_copies_rows(spark):
    rows = [(None, "a b c d e f", "en", 0.0), (7, "a b c d e f", None, None), (7, "a b c d e f", None, None), (None, "other words here", "en", 0.0), (None, "other words here", "en", 0.0)]
    kept = nearcopies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(x.doc_id), x.text) for x in kept) == [("7", "a b c d e f"), ("None", "other words here")]
