"""Near copies by exact similarity of shingles, against brute force."""

import numpy as np
import pytest

from lexspark.llm import jaccard, neardup


def shingles(words):
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(rng, kind, words, much):
    """The words with one kind of edit; `much` is about the share of them it touches."""
    n = max(1, round(much * len(words)))
    new = [f"n{x}" for x in rng.integers(0, 10 ** 9, n)]
    at = int(rng.integers(0, len(words) - n + 1))
    if kind == "appended":
        return words + new
    if kind == "truncated":
        return words[:-n]
    if kind == "block":
        return words[:at] + new + words[at + n:]
    out = list(words)
    for i, w in zip(rng.choice(len(words), max(1, n // 5), replace=False), new):
        out[i] = w
    return out


def pairs(seed, low, high, each):
    """(kind, words, their copy) with a similarity of low to high."""
    rng, out = np.random.default_rng(seed), []
    for kind in ("scattered", "appended", "truncated", "block"):
        made = 0
        while made < each:
            # A fifth of the words is common, as in running text.
            words = [f"c{x % 50}" if x % 5 == 0 else f"w{x}" for x in rng.integers(0, 10 ** 8, rng.integers(100, 600))]
            copy = edited(rng, kind, words, rng.uniform(0.02, 0.35))
            if low <= similarity(words, copy) < high:
                out.append((kind, words, copy))
                made += 1
    return out


def kept(spark, found):
    rows = [(2 * i + k, " ".join(w)) for i, (_, *both) in enumerate(found) for k, w in enumerate(both)]
    return {r.doc_id for r in neardup.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_copies_are_found_whatever_was_edited(spark):
    found = pairs(1, 0.8, 0.85, 100)
    stay = kept(spark, found)
    assert stay >= {2 * i for i in range(len(found))}
    missed = [kind for i, (kind, *_) in enumerate(found) if 2 * i + 1 in stay]
    assert not missed


def test_texts_below_the_similarity_stay(spark):
    found = pairs(2, 0.6, 0.8, 60)
    assert kept(spark, found) == set(range(2 * len(found)))


@pytest.mark.parametrize("most", [1 << 17, 900])
def test_crowded_groups_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "MOST", most)
    rng = np.random.default_rng(3)
    docs = []
    for _ in range(4):
        base = [f"w{x}" for x in rng.integers(0, 10 ** 8, 120)]
        docs += [edited(rng, kind, base, rng.uniform(0.02, 0.3)) for kind in ("scattered", "appended", "truncated", "block") * 6]
    sets = [shingles(d) for d in docs]
    root = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) / len(a | sets[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = neardup.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(set(root)) > 4 and {r.doc_id for r in got} == set(root)


def test_near_copies_of_the_pipeline_are_exact(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    stay = {r.doc_id for r in neardup.representatives(docs).collect()}
    by = {}
    for d, w in words.items():
        for s in shingles(w):
            by.setdefault(s, []).append(d)
    near = set()
    for pair in {(a, b) for ds in by.values() if len(ds) > 1 for i, a in enumerate(ds) for b in ds[i + 1:]}:
        if similarity(words[pair[0]], words[pair[1]]) >= 0.8:
            near.add(pair)
    # What has no neighbour stays, and of two neighbours one goes.
    assert set(words) - {d for p in near for d in p} <= stay
    assert near and not any(a in stay and b in stay for a, b in near)
