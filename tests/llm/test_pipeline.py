"""The corpus pipeline, each stage against brute force on what the stage before kept."""

import hashlib
import re

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from flowtide.llm import bpe, quality, storage

from .test_dedup import WORD, brute_near, brute_repeats
from .test_models import brute_tiles

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def terms(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text))


def contaminated(text, items):
    mine = terms(text)
    seen = {tuple(mine[i : i + 5]) for i in range(len(mine) - 4)}
    for item in items:
        if len(item) >= 5 and any(tuple(item[i : i + 5]) in seen for i in range(len(item) - 4)):
            if sum(n for *_, n in brute_tiles(mine, item, 5)) >= 0.5 * len(item):
                return True
    return False


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "substring_dedup", "decontamination", "encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10_001, None, None, None, None), (10_002, "", "en", "s", 0), (None, "Nothing of note here at all.", "en", "s", 28), (None, "Nothing of note here at all.", "en", "s", 28)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    model = quality.fit_quality(docs, labels)
    want = quality.score_quality(docs, model).filter(F.col("score") >= 0.3)
    kept = storage.materialize(stages["quality"](spark, docs, SF), "t")
    assert kept.columns == COLUMNS
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, want.select("doc_id", "text").collect()))

    rows = kept.collect()
    order = sorted(range(len(rows)), key=lambda i: (rows[i].doc_id is None, rows[i].doc_id or 0))
    single = sorted({(str(rows[order[c]].doc_id), rows[order[c]].text or "") for c in brute_near([rows[i].text for i in order])})
    kept = storage.materialize(stages["near_dedup"](spark, kept, SF), "t")
    assert kept.columns == COLUMNS
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == single

    rows = kept.collect()
    want = {}
    for r, (n, cut, digest) in zip(rows, brute_repeats([r.text for r in rows])):
        want[(r.doc_id, digest)] = cut
    kept = storage.materialize(stages["substring_dedup"](spark, kept, SF), "t")
    assert kept.columns == COLUMNS
    got = kept.collect()
    digest = lambda t: hashlib.sha256(" ".join(WORD.findall(t or "")).encode()).hexdigest()
    assert {(r.doc_id, digest(r.text)) for r in got} == set(want) and len(got) == len(rows)
    assert all(r.n_chars == len(r.text or "") for r in got if want[(r.doc_id, digest(r.text))])

    items = [terms(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = sorted((str(r.doc_id), r.text or "") for r in got if not contaminated(r.text or "", items))
    kept = storage.materialize(stages["decontamination"](spark, kept, SF), "t")
    assert kept.columns == COLUMNS
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == clean and len(clean) < len(got)

    codec = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = {}
    for r in kept.collect():
        ids = codec.encoding.encode_ordinary(r.text or "")
        texts[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages["encoding"](spark, kept, SF).collect()} == texts


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    done = corpus_pipeline.run(spark, SF)
    assert done.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < done.count() < 200


def test_stages_keep_callers_columns(spark):
    """Columns named like the operators' own come out as they went in, with or without n_chars."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").drop("n_chars").limit(60)
    clashing = ["score", "predicted", "n_words", "n_removed", "kept_sha256", "uid", "text_hash", "ids", "fp"]
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in clashing})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in clashing), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 60


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
