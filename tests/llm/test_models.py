"""Classifiers, URL rules, sharding, neighbours and decontamination on small tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.llm import ann, decontaminate, quality, sharding, toxicity, training, urlfilter

DOCS = "doc_id long, text string, score string, shard string"
R = random.Random(9)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randrange(2, 8))) for _ in range(500)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n)).capitalize() + "."


def test_sharding(spark):
    rows = [(i, prose(5), "x", "y") for i in range(103)] + [(None, None, None, None)] + [(7, "same", "", "")] * 60
    df = spark.createDataFrame(rows, DOCS)
    got = sharding.shuffle_into_shards(df, 10, bucket_bytes=500).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert set(by_shard) == set(range(10)) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = [len(s) for s in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] != [r[0] for r in rows]
    assert sharding.shuffle_into_shards(df.limit(0), 10).count() == 0
    assert sharding.shuffle_into_shards(df.limit(3), 10).agg(F.max("slot")).first()[0] == 0


def test_shards_depend_on_rows_alone(spark):
    """Equal shards whatever the input's cut; copies that would fill buckets are spread."""
    rows = [(i, prose(5), "x", "y") for i in range(300)] + [(7, "same " * 9, "", "")] * 500 + [(None, None, None, None)] * 3
    R.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS)
    shards = []
    for parts in (1, 7):
        got = sharding.shuffle_into_shards(df.repartition(parts), 4, bucket_bytes=2000).collect()
        assert len(got) == len(rows) and sorted(str(r[:3]) for r in got) == sorted(str(r[:3]) for r in rows)
        shards.append(sorted((r.shard, r.slot, str(r.doc_id), r.text or "") for r in got))
    assert shards[0] == shards[1]
    per_shard = [sum(r[2] == "7" for r in shards[0] if r[0] == s) for s in range(4)]
    assert min(per_shard) > 80


def test_repetitive_documents():
    """A phrase that a document repeats thousands of times: the same tiles, in bounded chunks."""
    phrase = np.arange(6)
    doc, item = np.tile(phrase, 700), np.concatenate([np.tile(phrase, 12), np.arange(100, 140)])
    seed = lambda x: np.array([hash(tuple(x[i : i + 5])) for i in range(len(x) - 4)])
    a, b = seed(doc), seed(item)
    pairs = np.array([(x, y) for x in range(len(a)) for y in range(len(b)) if a[x] == b[y]])
    want = sorted(map(tuple, decontaminate.runs(pairs[:, 0], pairs[:, 1]).tolist()))
    before, decontaminate.CHUNK_PLACES = decontaminate.CHUNK_PLACES, 1000
    found = decontaminate.shared_runs(np.arange(len(a)), a, np.arange(len(b)), b)
    decontaminate.CHUNK_PLACES = before
    assert sorted(map(tuple, found.tolist())) == want and len(pairs) > 40_000
    assert sum(n for *_, n in decontaminate.greedy(found)) == 72


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    pos = order[np.array(labels) == 1]
    n1, n0 = len(pos), len(labels) - len(pos)
    return (pos.sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def corpus(spark, column, bad):
    rows, labels = [], []
    for i in range(900):
        wrong = i % 4 == 0
        rows.append((i, bad(prose(60)) if wrong else prose(60), "s", "t"))
        if i % 3 < 2:
            labels.append((i, int(wrong) if column == "toxic" else int(not wrong)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, f"doc_id long, {column} int"), dict(labels)


def test_quality_held_out(spark):
    docs, labels, truth = corpus(spark, "quality", lambda t: t.replace(" ", "*** "))
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels))
    assert scored.columns == ["doc_id", "text", "shard", "score", "predicted"]
    got = {r.doc_id: r.score for r in scored.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert auc([got[i] for i in held], [truth[i] for i in held]) > 0.95
    odd = spark.createDataFrame([(None, None, "", ""), (1, "", "", ""), (1, "", "", "")], DOCS)
    model = quality.fit_quality(docs.limit(0), labels)
    assert [r.score for r in quality.score_quality(odd, model).collect()] == [0.5] * 3


def test_class_prior():
    r = np.random.default_rng(0)
    positive, unlabelled = r.normal(3, 1, 4000), np.concatenate([r.normal(3, 1, 2800), r.normal(-3, 1, 1200)])
    assert abs(quality.class_prior(positive, unlabelled) - 0.7) < 0.05


def test_toxicity_held_out(spark):
    docs, labels, truth = corpus(spark, "toxic", lambda t: t.replace(" ", " Moron, ", 2))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert auc([got[i] for i in held], [truth[i] for i in held]) > 0.95
    odd = spark.createDataFrame([(None, None, "", ""), (1, "", "", "")], DOCS)
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd, toxicity.fit_toxicity(docs, labels)).collect())
    assert [r.score for r in toxicity.score_toxicity(odd, toxicity.fit_toxicity(docs, labels.limit(0))).collect()] == [0.5] * 2


def test_url_rules(spark):
    urls = {
        "http://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://m.www.example.com/en/": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "x://b.net/es/1": ("b.net", "/es/1", "net/es/", "block"),
        "x://com/": ("com", "/", "com/", "allow"),
        "x://a.com?x=/": ("a.com", "", None, None),
        "x://a.com#/": ("a.com", "", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        "http://a.org/p://q": ("a.org", "/p://q", None, None),
    }
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(None, None, None), (0, "no scheme", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    for r in urlfilter.judge_urls(df).collect():
        host, path, rule, verdict = urls[r.url or ""]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


def test_samples_of_distinct_keys(spark):
    """Neither a url nor an id that fills the table takes more than one place of a sample."""
    urls = ["http://a.com/x"] * 500 + [f"http://b{i}.com/x" for i in range(20)] + ["http://A.com/x?q", None, "http://n.net/fr/", "http://n.net/fr/?a", "http://m.net/other"]
    parted = urlfilter.with_parts(spark.createDataFrame([(1, u) for u in urls], "page_id long, url string"))
    got = sorted((r.host, r.path, r.blocked) for r in urlfilter.labelled_urls(parted, 100).collect())
    assert got == sorted([("a.com", "/x", False), ("n.net", "/fr/", True)] + [(f"b{i}.com", "/x", False) for i in range(20)])
    assert urlfilter.labelled_urls(parted, 10).count() == 6
    docs = spark.createDataFrame([(1, f"t{i:03}") for i in range(300)] + [(2, None), (2, "b"), (3, ""), (None, "x")], "doc_id long, text string")
    ids = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, label int")
    assert sorted(tuple(r) for r in training.labelled_texts(docs, ids, 3).select("doc_id", "label", "text").collect()) == [(1, 0, "t000"), (2, 1, "b"), (3, 1, "")]


def test_neighbours_brute_force(spark):
    r = np.random.default_rng(3)
    vectors = [v.tolist() for v in r.normal(size=(600, 16)).astype(np.float32)]
    for i in range(40, 90):
        vectors[i] = vectors[40]
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    odd = [(1001, None, 0), (1050, [0.0] * 16, 0), (1100, [float("nan")] * 16, 0), (1150, [None] + [1.0] * 15, 0), (1200, [1.0], 0), (None, vectors[3], 0), (7, vectors[7], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {}
    for x in ann.search(df, F.col("id") % 50 == 0).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.id, x.score)
    m = np.array(vectors, np.float64)
    hits = 0
    for q in range(0, 600, 50):
        cosine = m @ m[q] / np.linalg.norm(m, axis=1) / np.linalg.norm(m[q])
        want = [i for i in np.lexsort((np.arange(600), -np.round(cosine, 12))) if i != q][:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        assert all(abs(cosine[i] - s) < 1e-12 for i, s in got[q].values())
        hits += len(set(want) & {i for i, _ in got[q].values()})
        if q == 50:
            assert [got[q][k][0] for k in range(1, 6)] == [40, 41, 42, 43, 44]
    assert set(got) == set(range(0, 600, 50)) and hits >= 0.9 * 60
    assert ann.search(df.limit(0), F.col("id") % 50 == 0).count() == 0
    few = ann.search(df.filter("vec_id in (0, 1, 2)"), F.col("id") % 50 == 0).collect()
    assert [(x.rank, {1, 2} >= {x.id}) for x in sorted(few, key=lambda x: x.rank)] == [(1, True), (2, True)]


def recall(found, m):
    hits, queries = 0, sorted({x.query_id for x in found})
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in queries:
        cosine = unit @ unit[q]
        cosine[q] = -2
        hits += len({x.id for x in found if x.query_id == q} & set(np.argsort(-cosine)[:5].tolist()))
    return hits / 5 / len(queries)


def test_neighbours_in_cells(spark):
    """Many small cells and chunks of them: the exact way finds what brute force finds."""
    m = np.random.default_rng(4).normal(size=(1001, 6))
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(m)], "vec_id long, embedding array<double>, rank string")
    assert recall(ann.search(df, F.col("id") % 50 == 0, cell_rows=40, exact=True).collect(), m) == 1
    assert recall(ann.search(df, F.col("id") % 50 == 0, cell_rows=40).collect(), m) > 0.8
    hot = df.select("vec_id", F.when(F.col("vec_id") < 600, F.transform("embedding", lambda x: x * 1e-4 + 1.0)).otherwise(F.col("embedding")).alias("embedding"))
    near = np.where(np.arange(1001)[:, None] < 600, m * 1e-4 + 1, m)
    assert recall(ann.search(hot, F.col("id") % 50 == 0, cell_rows=100, exact=True).collect(), near) > 0.97  # cosines of the near ones are all but equal


@pytest.mark.parametrize("spread", [None, 0.25])
def test_neighbours_of_many_vectors(spread):
    """Recall and the share of vectors met at 32,768 vectors in a cell, without structure and in clusters."""
    r = np.random.default_rng(1)
    n = ann.CELL_ROWS
    m = r.normal(size=(n, 64)) if spread is None else r.normal(size=(300, 64))[r.integers(300, size=n)] + spread * r.normal(size=(n, 64))
    cell, hits, queries = ann.Cell(np.arange(n), m), 0, range(0, n, 500)
    for q in queries:
        cosine = cell.unit @ cell.unit[q]
        cosine[q] = -2
        hits += len(set(np.argsort(-cosine)[:5].tolist()) & set(cell.nearest(m[q], 6, ann.REACH, 2.0)[0].tolist()))
    share = cell.n_cosines / len(queries) / n
    assert hits / 5 / len(queries) >= 0.9 and share <= (0.25 if spread is None else 0.12)


def brute_tiles(doc, item, k):
    marked_d, marked_i, out = set(), set(), []
    while True:
        best = None
        for x in range(len(doc)):
            for y in range(len(item)):
                n = 0
                while x + n < len(doc) and y + n < len(item) and doc[x + n] == item[y + n] and x + n not in marked_d and y + n not in marked_i:
                    n += 1
                if n >= k and (best is None or n > best[2]):
                    best = (x, y, n)
        if best is None:
            return out
        out.append(best)
        marked_d.update(range(best[0], best[0] + best[2]))
        marked_i.update(range(best[1], best[1] + best[2]))


def test_tiles_brute_force():
    r = random.Random(2)
    for _ in range(60):
        item = [r.randrange(6) for _ in range(14)]
        doc = [r.randrange(6) for _ in range(10)] + item[7:] + item[:7] + [r.randrange(6) for _ in range(5)]
        k = 3
        pairs = [(x, y) for x in range(len(doc) - k + 1) for y in range(len(item) - k + 1) if doc[x : x + k] == item[y : y + k]]
        x, y = map(np.array, zip(*pairs))
        assert sum(n for *_, n in decontaminate.tiles(x, y, k)) == sum(n for *_, n in brute_tiles(doc, item, k))


def test_decontaminate(spark):
    item, other = prose(30), prose(4)
    words = item[:-1].split()
    moved = " ".join(words[15:] + ["zz"] + words[:15])
    texts = [prose(80), prose(40) + " " + item.upper() + " " + prose(40), "q " + moved, " ".join(words[:10]) + prose(50), None, "", other, item]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)] + [(None, item, None, None), (1, texts[1], "a", "b")], DOCS)
    bench = spark.createDataFrame([(0, item), (1, other), (2, None), (0, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 0), (2, 0), (7, 0), (None, 0)}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 6]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0
