"""Near-copies against brute force, where fingerprints and least hashes find nothing."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowtide.llm import nearcopies
from flowtide.llm.text import utf8

from .test_dedup import SCHEMA, brute_near, near_texts


def without_company():
    """A pair at the similarity of whose least hashes, of one of them, the other has under half."""
    r = random.Random(1)
    words = [f"w{i}" for i in range(2000)]
    while True:
        texts = []
        for _ in range(500):
            base = r.choices(words, k=95)
            other = list(base)
            other[40], other[70] = "x", "y"
            texts += [" ".join(base), " ".join(other)]
        found, counts = nearcopies.shingles(*utf8(pa.array(texts)), nearcopies.WORDS)
        sets = np.split(found, np.cumsum(counts)[:-1])
        for i in range(0, len(texts), 2):
            a, b = (np.sort(s)[: nearcopies.LOW] for s in sets[i : i + 2])
            if 2 * np.isin(a, sets[i + 1]).sum() < nearcopies.LOW or 2 * np.isin(b, sets[i]).sum() < nearcopies.LOW:
                return texts[i : i + 2]


def test_pair_without_company(spark):
    rows = [*without_company(), "some other text of more words than five"]
    assert brute_near(rows) == [0, 0, 2]
    df = spark.createDataFrame([(i, t, "en", 0.0) for i, t in enumerate(rows)], SCHEMA)
    assert sorted(x.doc_id for x in nearcopies.keep_one(df).collect()) == [0, 2]


@pytest.mark.parametrize("pair_rows", [4096, 3])
def test_exact_pass_alone(spark, monkeypatch, pair_rows):
    monkeypatch.setattr(nearcopies, "PAIR_ROWS", pair_rows)
    monkeypatch.setattr(nearcopies, "HOT_COUNT", 0)
    monkeypatch.setattr(nearcopies, "candidates", lambda distinct, *_: distinct.select(F.col("uid").alias("u"), F.col("uid").alias("v")).limit(0))
    rows = near_texts()
    df = spark.createDataFrame([(i, t, "en", 0.0) for i, t in enumerate(rows)], SCHEMA)
    assert {x.doc_id for x in nearcopies.keep_one(df).collect()} == set(brute_near(rows))
