"""Spelling variants against brute force."""

import collections
import re
import zlib

import numpy as np
import pytest
from cases import documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspark.llm import variants

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(rows, min_chars=5, min_count=3):
    out = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= min_chars and n >= min_count}


def apart(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(words):
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and apart(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), form[w] and words[form[w]]) for w in words}


def result(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def invented(spark, seed=0, n=700):
    rng = np.random.default_rng(seed)
    words = {}
    while len(words) < n:
        w = "".join(rng.choice(list("abcéñz"), int(rng.integers(5, 9))))
        words[w] = int(rng.integers(3, 400))
        for _ in range(int(rng.integers(0, 4))):
            i = int(rng.integers(0, len(w)))
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + "k" + w[i:], w[:i] + "q" + w[i + 1:]])
            if len(w) >= 5:
                words[str(w)] = int(rng.integers(3, 50))
    words |= {"aaaaaa": 9, "aaaaa": 30, "a" * 3000: 5, "a" * 3001: 11, "ÿÿÿÿÿ": 3, "ÿÿÿÿÿa": 6}
    return words, spark.createDataFrame(list(words.items()), "word string, n long")


@pytest.mark.parametrize("shard, room", [(1 << 20, 32 << 20), (40, 200), (7, 1)])
def test_groups_against_brute_force(spark, monkeypatch, shard, room):
    monkeypatch.setattr(variants, "SHARD", shard)
    monkeypatch.setattr(variants, "ROUND", room)
    words, df = invented(spark, n=700 if room > 1000 else 120)
    want = grouped(words)
    assert result(variants.grouped(df)) == want
    assert any(r[2] not in (r[0], r[1]) for r in want)


@given(st.sets(st.text("abcxyz", min_size=1, max_size=7), max_size=30), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_filters_lose_no_word(words, scale):
    for own in variants._by_length(sorted(words)):
        h = variants._mixed(variants._hashes(variants._codes(own)))
        made = variants.Blocks.for_words(max(1, len(own) // scale))
        made.add(h)
        assert made.probe(h).tolist() == list(range(len(own)))


def test_filters_let_few_through():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 400_000, np.uint64) * np.uint64(2)
    made = variants.Blocks.for_words(200_000)
    made.add(h[:200_000])
    assert len(made.probe(h[200_000:])) < 1000


@given(st.lists(st.text("abé", min_size=1, max_size=6), min_size=1, max_size=6, unique=True))
@settings(max_examples=200, deadline=None)
def test_edits_are_hashed_as_the_words_they_make(words):
    alphabet = np.array(sorted(map(ord, "abéx")), np.uint64)
    seen = []

    def probe(length, hashes):
        seen.append((length, hashes.tolist()))
        return np.arange(len(hashes))

    got = list(variants.edits(words, alphabet, probe))
    made = iter(got)
    for length, hashes in seen:
        for h in hashes:
            e = next(made)[1]
            assert len(e) == length
            if e:
                assert int(variants._mixed(variants._hashes(variants._codes([e])))[0]) == h
    want = {(w, w[:i] + w[i + 1:]) for w in words for i in range(len(w))} | {
        (w, w[:i] + c + w[i + 1:]) for w in words for i in range(len(w)) for c in "abéx" if c > w[i]}
    assert len(got) == len(set(got)) and set(got) == want


def test_odd_tables(spark):
    assert variants.vocabulary(empty(spark)).collect() == []
    assert variants.grouped(variants.vocabulary(empty(spark))).collect() == []
    docs, rows = documents(spark)
    want = vocabulary(rows)
    assert {r.word: r.n for r in variants.vocabulary(docs).collect()} == want
    assert result(variants.grouped(variants.vocabulary(docs))) == grouped(want)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = vocabulary([(r.doc_id, r.text) for r in docs.collect()])
    assert result(variants.grouped(variants.vocabulary(docs))) == grouped(want)
