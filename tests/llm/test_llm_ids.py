"""Token ids: exact words, wavelet shards, packing."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import documents, empty, multiset, texts

from lexspark.llm import tiers, tokens, wavelet
from lexspark.llm.common import folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library):
    code = tokens.Encoder(PATH)
    for text in texts(seed=5, n=400):
        assert np.frombuffer(code.encode(text), "<u4").tolist() == library(text), repr(text[:80])


def test_encoder_with_a_small_memory(library, monkeypatch):
    monkeypatch.setattr(tokens, "PARTS", 3)
    monkeypatch.setattr(tokens, "WORDS", 2)
    code = tokens.Encoder(PATH)
    for text in texts(seed=6, n=60):
        assert np.frombuffer(code.encode(text), "<u4").tolist() == library(text)


@pytest.mark.parametrize("n", [0, 1, 8, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 300, n).astype("<u4")
    built = wavelet.WaveletMatrix.build(ids, 9)
    m = wavelet.WaveletMatrix(n, built.zeros, *built.rows())
    assert (m.decode() == ids).all()
    assert [m.access(i) for i in range(0, n, 7)] == ids[::7].tolist()
    for t in (0, 3, 299, 511, 512):
        at = np.flatnonzero(ids == t)
        assert m.count(t) == len(at)
        assert m.count(t, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
        assert [m.select(t, k) for k in range(len(at))] == at.tolist()
        with pytest.raises(IndexError):
            m.select(t, len(at))


def test_shards(spark, library):
    docs, rows = documents(spark)
    path = folder(spark, "wavelet")
    wavelet.write_shards(docs, path, PATH, segment=2000)
    got = wavelet.read_documents(spark, path).orderBy("start").collect()
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    start, all_ids = 0, []
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert (r.start, r.n_tokens) == (start, len(ids))
        start += len(ids)
        all_ids += ids
    assert multiset((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == multiset(
        (d, [*library(t), 0]) for d, t in rows)
    wanted = [0, 198, all_ids[5], 50256]
    found = defaultdict(list)
    for r in wavelet.occurrences(spark, path, wanted).collect():
        found[r.token].append(r.position)
    for t in wanted:
        assert sorted(found[t]) == [i for i, x in enumerate(all_ids) if x == t]
    asked = [0, 1, 777, len(all_ids) - 1, len(all_ids), -1]
    got = {r.position: r.token for r in wavelet.tokens_at(spark, path, asked).collect()}
    assert got == {p: all_ids[p] for p in asked if 0 <= p < len(all_ids)}


def test_shards_of_nothing(spark):
    path = folder(spark, "wavelet")
    wavelet.write_shards(empty(spark), path, PATH)
    assert wavelet.read_documents(spark, path).collect() == []
    assert wavelet.tokens_at(spark, path, []).collect() == []


def check_pieces(rows, library, pieces):
    cover, windows, groups = defaultdict(list), defaultdict(list), defaultdict(int)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        cover[p.doc_id, p.doc_tokens].append((p.start, p.length, p.ids))
        windows[p.sequence_id].append((p.offset, p.length, p.window, p.step_group))
        groups[p.step_group] += p.length
    for window in windows.values():
        at, sizes = 0, {(w, g) for _, _, w, g in window}
        assert len(sizes) == 1
        for offset, length, size, _ in sorted(window):
            assert offset == at
            at += length
        # A window is full, and its size a power of two: no padding at all.
        assert at == size and size & (size - 1) == 0 and size <= 1024
    assert max(groups.values(), default=0) <= tiers.STEP + 1024
    assert sum(p.length for p in pieces) == sum(len(library(t)) + 1 for _, t in rows)
    return cover, groups


def test_packing(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(3))] + [(1000, None), (None, "null id")]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, window string, length int").repartition(3)
    pieces = tiers.pack(docs, PATH).collect()
    cover, _ = check_pieces(rows, library, pieces)
    for doc, text in rows:
        ids = np.array([*library(text), 0], "<u4").tobytes()
        parts = sorted(cover[doc, len(ids) // 4])
        assert b"".join(p[2] for p in parts) == ids
        at = 0
        for start, length, _ in parts:
            assert start == at
            at += length


def test_packing_repeated_ids_and_nothing(spark, library):
    docs, rows = documents(spark)
    check_pieces(rows, library, tiers.pack(docs, PATH).collect())
    assert tiers.pack(empty(spark), PATH).collect() == []


def test_packer_tiers_and_balance():
    rng = np.random.default_rng(1)
    packer, lengths = tiers.Packer(tiers.TIERS, tiers.STEP, 0, pool=500), rng.integers(1, 2500, 4000)
    for i, n in enumerate(lengths):
        packer.add(i, bytes(4 * int(n)))
    packer.close()
    done = packer.drain()
    groups, sizes = defaultdict(int), defaultdict(set)
    for doc, start, length, ids, total, seq, offset, size, group in done:
        groups[group] += length
        sizes[size].add(seq)
    assert sum(groups.values()) == lengths.sum()
    assert {1024, 512, 256, 128} <= set(sizes)
    # All groups but the last few hold exactly one step.
    assert sum(v != tiers.STEP for v in groups.values()) <= 5
    assert sum(len(s) for w, s in sizes.items() if w < 128) <= 7


def test_same_rows_same_numbers(spark):
    docs = spark.createDataFrame(list(enumerate(texts(4))), "doc_id long, text string").coalesce(2)
    one, two = (sorted(map(tuple, tiers.pack(docs, PATH).collect()), key=repr) for _ in range(2))
    assert one == two and len({zlib.crc32(repr(x).encode()) for x in one}) > 1


def test_all_tiers_come_out_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = [r.window for r in tiers.pack(docs, PATH).select("sequence_id", "window").distinct().collect()]
    assert all(sizes.count(t) >= 10 for t in tiers.TIERS), {t: sizes.count(t) for t in tiers.TIERS}
