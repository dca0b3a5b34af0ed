"""Each registered query of the operators on the given small tables, against brute force or a round trip."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from flowtide.llm import bpe, queries

from .test_dedup import brute_components, brute_repeats, brute_simhash
from .test_models import auc
from .test_pipeline import contaminated, terms

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1(spark, texts):
    got = rows(spark, "op1_sharding")
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)} and len(got) == len(texts)
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(40)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1


@pytest.mark.parametrize("name, column, folds, held, cut", [("op2_quality", "quality", 5, 0, 0.3), ("op9_toxicity", "toxic", 3, 1, 0.7)])
def test_classifiers(spark, name, column, folds, held, cut):
    """On a larger table than the others: fifty labelled rows would be too few to learn from."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % folds == held) and r.predicted == (r.score >= cut) and 0 <= r.score <= 1 for i, r in got.items())
    labels = [(r.doc_id, r[column]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out and r[column] is not None]
    assert auc([got[i].score for i, _ in labels], [y for _, y in labels]) > 0.8


def test_op3(spark, texts):
    items = {r.item_id: terms(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {r.doc_id for r in rows(spark, "op3_decontaminate")}
    assert got == {i for i, t in texts.items() if contaminated(t, items.values())} and got


def test_op4(spark):
    rules = {("com", "/"): "allow", ("example.com", "/en/"): "block", ("www.example.com", "/en/"): "allow", ("net", "/es/"): "block", ("net", "/fr/"): "block"}
    urls = {r.page_id: r.url or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = rows(spark, "op4_url_filter")
    assert len(got) == len(urls)
    for r in got:
        rest = urls[r.page_id].partition("://")[2]
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
        path = rest[len(host) :]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = host.lower()
        fits = [(h, p) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r.host, r.path, r.rule) == (host, path, "".join(best) if best else None)
        assert r.verdict == rules[best] if best else r.verdict == ("block" if r.block_score >= 0.5 else "allow")


def test_op5(spark, texts):
    plain, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    plain.encode_special_tokens = True
    for r in sorted(rows(spark, "op5_token_files"), key=lambda r: r.doc_id):
        ids = np.array([*plain.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op6(spark):
    table = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding and np.isfinite(np.array(r.embedding, float)).all() and any(r.embedding)}
    ids = np.array(sorted(table))
    m = np.array([table[i] for i in ids])
    unit, got, hits = m / np.linalg.norm(m, axis=1, keepdims=True), {}, 0
    for r in rows(spark, "op6_nearest"):
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    for q, found in got.items():
        cosine = unit @ unit[np.searchsorted(ids, q)]
        assert sorted(found) == [1, 2, 3, 4, 5] and all(i != q and abs(cosine[np.searchsorted(ids, i)] - s) < 1e-12 for i, s in found.values())
        assert [found[k] for k in range(1, 6)] == sorted(found.values(), key=lambda x: (-x[1], x[0]))
        cosine[np.searchsorted(ids, q)] = -2
        hits += len({i for i, _ in found.values()} & set(ids[np.argsort(-cosine)[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(got)


def test_op7(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows(spark, "op7_substring_dedup")}
    assert got == dict(zip(texts, brute_repeats(list(texts.values()))))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == {r[0]: r[1:] for r in con.sql(queries.ORACLE_SQL["op7_substring_dedup"]).fetchall()}


def test_op8(spark, texts):
    order = sorted(texts)
    fps = [brute_simhash(texts[i]) for i in order]
    want = {i: (f"{f:016x}", order[c]) for i, f, c in zip(order, fps, brute_components(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op8_simhash")} == want


def test_op10(spark, texts):
    codec = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for r in rows(spark, "op10_bpe"):
        ids = np.array(codec.encoding.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
