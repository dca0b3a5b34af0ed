"""BPE and token files against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowtide.llm import bpe, pretokens, tokenfiles

MULTI, BYTE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
CODEC = bpe.codec(MULTI, P.PATTERN)
PLAIN = Tokenizer.from_file(BYTE)
PLAIN.encode_special_tokens = True
TRICKY = st.text(st.sampled_from(list("ab'stremvldé1٣ \n\t\u00a0\u3000.,-!中🙂\u0301")), max_size=60)
SCHEMA = "doc_id long, text string, ids string, start double"


def long_texts():
    r = random.Random(1)
    yield "a" * 5000
    yield "".join(r.choice("abcdefgh") for _ in range(9000))
    yield " " * 3000 + "x" + "\n" * 2000
    yield "".join(r.choice("中文字語本") for _ in range(3000)) + "!?" * 700
    yield " ".join("".join(r.choice("etaoin'st") for _ in range(r.randrange(1, 12))) for _ in range(4000))
    yield "don't we'll I'm " * 900 + "'" * 400 + "s" * 900 + "1234567890" * 300


def test_every_token_encodes_to_itself():
    assert all(CODEC._short(t) == [r] for r, t in list(CODEC.tokens.items())[::37])


@pytest.mark.parametrize("leaf", [7, 33, 256, 4096])
def test_tree_is_the_library(monkeypatch, leaf):
    monkeypatch.setattr(bpe, "LEAF_CHARACTERS", leaf)
    for text in long_texts():
        text = text[:2500] if leaf == 7 else text
        ids = CODEC.encode(text)
        assert ids == CODEC.encoding.encode_ordinary(text)
        assert CODEC.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(TRICKY, st.integers(1, 9))
def test_tree_on_small_texts(text, leaf):
    before, bpe.LEAF_CHARACTERS = bpe.LEAF_CHARACTERS, leaf
    try:
        assert CODEC.encode(text) == CODEC.encoding.encode_ordinary(text)
    finally:
        bpe.LEAF_CHARACTERS = before


@settings(max_examples=300, deadline=None)
@given(st.lists(TRICKY, max_size=5))
def test_pieces_are_the_library(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    ids, counts = pretokens.piece_encoder(BYTE).encode(data, offsets)
    want = [e.ids for e in PLAIN.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_files_round_trip(spark):
    texts = ["", None, "Hello don't  stop\n\n now", "é" * 3000, "<|endoftext|> x", *long_texts()]
    rows = [(i * 7 % 100, t, "clash", 0.0) for i, t in enumerate(texts)] + [(None, "no id", None, None), (3, "twice", "", 1.0), (3, "twice", "", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    manifest = tokenfiles.write_token_files(df, BYTE, 2, file_bytes=20_000)
    assert manifest.count() > 1
    got = tokenfiles.read_token_files(manifest).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [x.doc_id for x in got] == [r[0] for r in order]
    start, want = 0, {}
    for x in got:
        assert x.start == start
        start += len(x.ids) // 4
    for r in rows:
        want.setdefault(r[0], []).append(np.array([*PLAIN.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    for x in got:
        want[x.doc_id].remove(bytes(x.ids))
    # one document alone is read from its file
    row = manifest.orderBy("part", "file").first()
    with tokenfiles.open_file(row.path) as file:
        reader = tokenfiles.TokenReader(file)
        one = next(reader.ids(len(reader) - 1))
        assert one[-1] == 2 and len(reader) == row.n_docs
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(df.limit(0), BYTE, 2)).count() == 0


def test_rows_alike_spread_over_files(spark):
    same = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text in every row " * 4).alias("text"))
    manifest = tokenfiles.write_token_files(same, BYTE, 2, file_bytes=500_000)
    sizes = [r.n_docs for r in manifest.collect()]
    assert len(sizes) >= 4 and sum(sizes) == 20_000 and max(sizes) < 12_000
    assert tokenfiles.read_token_files(manifest).select("start").distinct().count() == 20_000


def test_other_splits_are_refused(tmp_path):
    from tokenizers import pre_tokenizers

    other = Tokenizer.from_file(BYTE)
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    other.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        pretokens.PieceEncoder(str(tmp_path / "t.json"))


def test_damage_is_found(spark, tmp_path):
    path = f"file://{tmp_path}/x.zst"
    writer = tokenfiles.TokenWriter(path, 2)
    for k in range(3):
        writer.add(k, bytes(range(200)) * (k + 1))
    assert writer.finish() == (path, 3, 600)
    raw = bytearray((tmp_path / "x.zst").read_bytes())
    with tokenfiles.open_file(path) as file:
        assert len(next(tokenfiles.TokenReader(file).ids(1))) == 200
    raw[len(raw) - 9 - 12 * 2 - 2] ^= 1  # in the checksum of the first frame
    (tmp_path / "x.zst").write_bytes(raw)
    with tokenfiles.open_file(path) as file, pytest.raises(ValueError):
        next(tokenfiles.TokenReader(file).ids(0))


def test_bpe_rows(spark):
    df = spark.createDataFrame([(None, None, "a", 0.0), (1, "", "a", 0.0), (2, "Straße 中 " * 10, "a", 0.0), (2, "Straße 中 " * 10, "a", 0.0)], SCHEMA)
    coded = bpe.decode(bpe.encode(df, MULTI, P.PATTERN), MULTI, P.PATTERN)
    both = bpe.encode(df, MULTI, P.PATTERN, decoded=True)
    assert sorted(map(str, both.collect())) == sorted(map(str, coded.collect()))
    assert coded.columns == ["doc_id", "text", "start", "ids", "decoded"]
    for x in coded.collect():
        assert bytes(x.decoded) == (x.text or "").encode()
        assert np.frombuffer(bytes(x.ids), "<u4").tolist() == CODEC.encoding.encode_ordinary(x.text or "")
    assert bpe.encode(df.limit(0), MULTI, P.PATTERN).count() == 0


def test_most_documents_pass_the_tree(spark):
    n_long = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.char_length("text") > bpe.LEAF_CHARACTERS).count()
    assert n_long > 900  # of 1000


def test_crc_is_unsigned(spark):
    assert spark.range(1).select(F.crc32(F.lit(b"abc"))).first()[0] == zlib.crc32(b"abc")


assert tiktoken
