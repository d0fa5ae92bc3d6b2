"""Pieces, languages and quality."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cases import documents, empty, multiset, texts

from lexspark.llm import langmix, linefirst, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


ODD = [" ", " ", "  ", "\n", "a", "the", "ing", "é", "漢", "\t", ".", "▁", "ﬁ", "\0", "😀", "x" * 70, "①", "̈", "﷽", "\r\n", "ｶﾞ", "­"]


def test_ids_spans_and_decoding(library):
    made, rng = pieces.codec(MODEL), random.Random(1)
    assert made.by_word
    for text in texts(seed=8, n=200) + ["".join(rng.choices(ODD, k=rng.randint(0, 14))) for _ in range(1500)]:
        ids, begins, ends = made.encode(text)
        assert ids.tolist() == library.encode(text), repr(text[:80])
        whole = made._encode(text, True)
        assert all((a == b).all() for a, b in zip(whole, (ids, begins, ends), strict=True))
        data = text.encode()
        at = 0
        for i, b, e in zip(ids.tolist(), begins.tolist(), ends.tolist()):
            name = library.id_to_piece(i)
            if library.is_byte(i):
                assert int(name[1:-1], 16) in data[b:e]
            else:
                # The piece is what its bytes say, but for the blank put in front.
                assert name.replace("▁", " ").lstrip(" ") == data[b:e].decode().replace("▁", " ").lstrip(" ")
            assert b <= at <= e or b == at
            at = e
        assert not data or at == len(data)


def test_normaliser_with_a_character_map():
    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    rules = dict(pieces.fields(next(v for n, v in pieces.fields(norm.serialized_model_proto()) if n == 3)))
    made = object.__new__(pieces.Codec)
    made.map, made._own, made.suffix = pieces.CharacterMap(rules[2]), None, False
    made.dummy, made.trim, made.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choices(ODD, k=rng.randint(0, 10)))
        known, begins, ends = made.normalise(text)
        assert known.decode() == norm.normalize(text), repr(text)
        assert len(begins) == len(ends) == len(known)
        assert (np.diff(begins) >= 0).all() and (np.diff(ends) >= 0).all() and (ends >= begins).all()
    known, begins, ends = made.normalise("ﬁx  ①")
    assert known.decode() == "▁fix▁1"
    assert list(zip(begins.tolist(), ends.tolist()))[3:6] == [(0, 3), (0, 3), (3, 4)]


def test_pieces_of_a_table(spark, library):
    docs, rows = documents(spark)
    got = pieces.encode(docs, MODEL).collect()
    want = [(d, library.encode(t or ""), library.decode(library.encode(t or ""))) for d, t in rows]
    assert multiset((r.doc_id, list(r.ids), r.decoded) for r in got) == multiset(want)
    assert all(len(r.ids) == len(r.begins) == len(r.ends) for r in got)
    assert pieces.encode(empty(spark), MODEL).collect() == []


# -- languages --------------------------------------------------------------

def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langmix.train(docs.where(~langmix.held_out()))
    got = langmix.predict(docs, model).where(langmix.held_out()).collect()
    assert len(got) == sum(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs.select("doc_id").collect())
    right = sum(r.lang == r.lang_pred for r in got) / len(got)
    assert right >= 0.98
    assert all(0 <= r.score <= 1 and len(r.languages) == len(r.shares) for r in got)


def test_mixtures_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 1000")
    by = {}
    for r in docs.select("lang", "text").collect():
        by.setdefault(r.lang, []).append(r.text[:1000])
    model = langmix.train(docs)
    two = [(i, a + "\n" + b) for i, (a, b) in enumerate(zip(by["en"], by["fr"]))]
    got = langmix.predict(spark.createDataFrame(two, "doc_id long, text string"), model).collect()
    assert np.mean([set(r.languages) == {"en", "fr"} for r in got]) > 0.9
    assert np.mean([abs(r.shares[0] - 0.5) < 0.15 for r in got]) > 0.9


def test_language_of_hard_cases(spark):
    docs, rows = documents(spark)
    taught = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "de"), ("x", None), ("12", "es")],
                                   "text string, lang string")
    model = langmix.train(taught)
    assert model.languages == ["en", "fr"]
    got = langmix.predict(docs, model)
    assert set(docs.columns) <= set(got.columns)
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        none = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == none and (not none or (r.score == 0 and r.languages == []))
    nothing = langmix.train(taught.limit(0))
    assert {r.lang_pred for r in langmix.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert langmix.predict(empty(spark), model).collect() == []


def test_proportions_maximise_the_likelihood():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(50), 2).T
    c = rng.multinomial(4000, p @ [0.3, 0.7]).astype(float)
    best, share = langmix._expect(c, p)
    grid = [(c @ np.log(p @ [a, 1 - a]), a) for a in np.linspace(0.001, 0.999, 999)]
    assert best >= max(grid)[0] - 0.5 and abs(share[0] - max(grid)[1]) < 0.02


# -- quality ----------------------------------------------------------------

def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i:i + 3])] > 1}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(inside), failed


def test_counts_against_brute_force(spark):
    docs, rows = documents(spark)
    got = linefirst.clean(docs).collect()
    assert multiset((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == \
        multiset((d, *counts(t)) for d, t in rows)
    assert all(not (r.kept and r.base_failed) and r.lang == "en" for r in got)
    assert linefirst.clean(empty(spark)).collect() == []


PROSE = [
    "Every morning the miller walks down to the river, and comes back home when bells ring.",
    "His daughter keeps two goats; nobody in our village has ever counted more than that.",
    "When snow covers these hills, an old road between both farms disappears for weeks.",
    "She reads letters aloud, slowly, because grandfather lost his glasses near Lisbon.",
    "Some say it was raining. Others remember only wind, dust and a broken umbrella.",
    "We bought bread, cheese, three pears and one bottle of cider before leaving town.",
    "A train passed at noon without stopping, though several people waved their hats.",
    "By evening all lamps were lit, music started, and strangers danced until midnight.",
]


@pytest.mark.parametrize("lines,left,kept", [
    (PROSE, PROSE, True),
    ([*PROSE, "All rights reserved."], PROSE, True),
    ([*PROSE, "Home | News | Sports | About"], PROSE, True),
    ([*PROSE, "", "###$$$ buy%%% now&&&"], [*PROSE, ""], True),
    ([*PROSE, "His licence is licensed under a law that " + "nobody reads any more, as he says " * 5], None, True),
    (["Home | News | Sports | About"] * 3 + PROSE[:1] + ["A | B | C | D | E | F | G | H | I | J | K"] * 4, PROSE[:1], False),
    ([" ".join(f"w{i}" for i in range(80))], [], False),
])
def test_lines(lines, left, kept):
    text, *_, failed, ok = linefirst.examine("\n".join(lines))
    assert text == "\n".join(lines if left is None else left) and ok == kept


def test_many_different_words():
    words = [f"w{i}".encode() for i in range(3000)] + [b"w5", b"w6", b"w7"]
    assert linefirst.repeated_words(words) == 6


def test_too_many_languages_are_told(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a text", f"l{i}") for i in range(6)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langmix, "MOST_LANGUAGES", 6)
    assert len(langmix.train(docs).languages) == 6
    monkeypatch.setattr(langmix, "MOST_LANGUAGES", 5)
    with pytest.raises(ValueError, match="more than 5"):
        langmix.train(docs)
