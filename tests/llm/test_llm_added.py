"""Strings of added tokens in texts: the queries give the ids of the plain library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import texts

import corpus_pipeline
from lexspark.llm import tokens
from lexspark.llm.queries import REGISTERED

PATH = public_tokenizers.path("byte_bpe_50k.json")
MORE = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "\n<|endoftext|><|endoftext|> x", "<|endoftext", "plain words"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH)
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_plain_library(plain):
    code = tokens.Encoder(PATH, added=True)
    for text in [*MORE, *texts(seed=7, n=200)]:
        assert np.frombuffer(code.encode(text), "<u4").tolist() == plain(text), repr(text[:80])
    assert plain(MORE[1]) == [64, 220, 50256, 275, 50256]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("added"))
    rows = list(enumerate([*MORE, None, *texts(seed=8, n=20)]))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_queries_equal_plain_library(spark, plain, table):
    path, rows = table
    ids = {d: [*plain(t), 0] for d, t in rows}
    start, want = 0, {}
    for d, x in ids.items():
        want[d] = start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())
        start += len(x)
    got = REGISTERED["op1_wavelet"](spark, path).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    got = REGISTERED["op3_tiers"](spark, path).collect()
    assert {(r.doc_id, r.doc_tokens) for r in got} == {(d, len(x)) for d, x in ids.items()}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())
    packed = corpus_pipeline.packing(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()
    for r in packed:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start:r.start + r.length]
    assert sum(r.length for r in packed) == start
