"""The pipeline's stages, each against a brute-force version on its own input."""

import collections

import numpy as np
import public_tokenizers
import pytest
from cases import BLANKS, empty

import corpus_pipeline
from lexspark.llm import linefirst
from lexspark.llm.common import stored

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, SF), name)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(steps):
    want = steps["input"].dtypes
    assert all(steps[name].dtypes == want for name, _ in corpus_pipeline.STAGES[:-1])


def test_language(steps):
    before, after = rows(steps["input"]), rows(steps["language"])
    assert set(after) <= set(before)
    assert all(r == before[d] for d, r in after.items())
    assert {d for d, r in before.items() if d not in after} >= {d for d, r in before.items() if not any(c.isalpha() for c in r.text or "")}
    assert len(after) >= 0.99 * len(before)


def test_quality(steps):
    want = {d: e[0] for d, r in rows(steps["language"]).items() if (e := linefirst.examine(r.text))[-1]}
    got = rows(steps["quality"])
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_line_dedup(steps):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(BLANKS).translate(low)
    before = rows(steps["quality"])
    seen = collections.Counter(k for r in before.values() for k in {key(x) for x in r.text.split("\n")} if k)
    want = {d: "\n".join(x for x in r.text.split("\n") if not key(x) or seen[key(x)] < 10) for d, r in before.items()}
    assert {d: r.text for d, r in rows(steps["line_dedup"]).items()} == want
    assert any(want[d] != before[d].text for d in want)


def test_near_dedup(steps):
    before, after = rows(steps["line_dedup"]), rows(steps["near_dedup"])
    assert all(before[d] == r for d, r in after.items())
    shingles = {}
    for d, r in before.items():
        w = r.text.encode().lower().split()
        shingles[d] = {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    by = collections.defaultdict(list)
    for d, s in shingles.items():
        for x in s:
            by[x].append(d)
    common = collections.Counter((a, b) for ds in by.values() for i, a in enumerate(sorted(ds)) for b in sorted(ds)[i + 1:])
    similar = {p: n / len(shingles[p[0]] | shingles[p[1]]) for p, n in common.items()}
    exact = [(a, b) for a, b in similar if before[a].text == before[b].text]
    assert exact and not any(a in after and b in after for a, b in exact)
    near = [p for p, s in similar.items() if s >= 0.8]
    caught = [p for p in near if not (p[0] in after and p[1] in after)]
    assert len(caught) >= 0.95 * len(near)
    # What has no similar text stays.
    alike = {d for p, s in similar.items() if s >= 0.5 for d in p}
    assert set(before) - alike <= set(after)


def test_packing(steps):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: np.array([*made.encode(r.text, add_special_tokens=False).ids, 0], "<u4").tobytes()
            for d, r in rows(steps["near_dedup"]).items()}
    parts = collections.defaultdict(list)
    for r in steps["packing"].collect():
        parts[r.doc_id].append((r.start, bytes(r.ids)))
    assert {d: b"".join(x for _, x in sorted(p)) for d, p in parts.items()} == want


def test_run_equals_its_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert got.drop("sequence_id", "step_group").columns == steps["packing"].drop("sequence_id", "step_group").columns
    assert got.select("doc_id").distinct().count() == steps["near_dedup"].count()


def test_empty_and_odd_tables(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
    prose = [" ".join(f"{w}{i * k % 97}x{k}" for k, w in enumerate(["river", "house", "morning", "letter"] * 20)) + "." for i in range(3)]
    prose = ["\n".join(" ".join(p.split()[at:at + 10]) + "." for at in range(0, 80, 10)) for p in prose]
    rows = [(1, None, None, None, None, 1.0, "a"), (2, "", "en", "s", 0, 2.0, "b"), (None, "the words of a text. " * 30, "en", "s", 1, 3.0, "c"),
            (3, prose[0], None, "s", 1, 4.0, "d"), (4, prose[1], "en", "s", 1, 5.0, "e"), (None, prose[2], None, "s", 1, 6.0, "f"),
            (9, prose[1] + "\nHome | News | Sports | About", "en", "s", 1, 7.0, "g")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, node string"
    odd = spark.createDataFrame(rows * 2, kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = stored(stage(spark, odd, SF), name)
        assert odd.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "node"]
    left = sorted(((r.doc_id, r.score, r.node, r.lang) for r in odd.collect()), key=repr)
    assert left == [(3, 4.0, "d", "en"), (4, 5.0, "e", "en"), (None, 6.0, "f", "en")]
    with pytest.raises(ValueError, match="to learn languages from"):
        corpus_pipeline.language(spark, spark.createDataFrame([(1, "some words", None, "s", 1, 1.0, "a")], kind), SF)
