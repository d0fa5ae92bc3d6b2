"""SimHash near copies against brute force."""

import numpy as np
import pytest
import xxhash
from cases import documents, empty
from pyspark.sql import functions as F

from lexspark.llm import neardup, simhash
from lexspark.llm.common import components


def plain(text, words=4):
    tokens = [w for w in _split((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def _split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near(fps, distance):
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= distance]


def cloud(seed, centres=20, each=30, flips=7):
    rng = np.random.default_rng(seed)
    out = set()
    for c in rng.integers(0, 2 ** 64, centres, dtype=np.uint64):
        for _ in range(each):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, flips)):
                x ^= 1 << int(b)
            out.add(x)
    return sorted(out)


def test_documents_against_brute_force(spark):
    docs, rows = documents(spark)
    fps = [plain(t) for _, t in rows]
    root = groups(sorted(set(fps)), near(sorted(set(fps)), 4))
    lowest = {}
    for (d, _), f in zip(rows, fps):
        if d is not None:
            lowest[root[f]] = min(d, lowest.get(root[f], d))
    want = sorted(((d, f"{f:016x}", lowest.get(root[f])) for (d, _), f in zip(rows, fps)), key=repr)
    got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_only_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {None}
    assert simhash.near_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("distance", [1, 4])
def test_links_connect_what_brute_force_connects(spark, distance):
    fps = cloud(distance)
    signed = [(int(np.uint64(f).astype(np.int64)),) * 2 for f in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp long, node long"), distance).collect()
    got = groups(fps, [(int(np.int64(r.a).astype(np.uint64)), int(np.int64(r.b).astype(np.uint64))) for r in links])
    assert got == groups(fps, near(fps, distance))
    # A forest per task, never all pairs of a group.
    assert len(links) <= len(fps) * 8


@pytest.mark.parametrize("small", [2, 5, 64, 4096])
def test_crowded_groups_are_divided_without_loss(monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_GROUP", small)
    fps = np.array(cloud(3), np.uint64)
    found = simhash._Links()
    simhash.compare_runs(simhash._Rows(fps, fps.view(np.int64), None, 0), np.array([0]), 4, 2 ** 64 - 1, found)
    a, b = found.reduce()
    linked = zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist())
    assert groups(fps.tolist(), linked) == groups(fps.tolist(), near(fps.tolist(), 4))


@pytest.mark.parametrize("distance", [1, 4, 10])
def test_plan_keeps_the_pigeonhole(distance):
    rng = np.random.default_rng(distance)
    fps = rng.integers(0, 2 ** 64, 400, dtype=np.uint64)
    both = simhash._both_set(fps).reshape(64, 64)
    for m in range(2, distance + 2):
        parts = simhash.group_bits(both, len(fps), m)
        assert sorted(sum(parts, [])) == list(range(64)) and max(map(len, parts)) - min(map(len, parts)) <= 1
        shares = np.array([simhash.close_shares(np.diag(both) / len(fps), p, distance) for p in parts])
        for n in (100, 10 ** 6, 10 ** 10):
            cost, chosen = simhash.allocate(parts, shares, n, distance)
            assert sum(t + 1 for t in chosen) == distance + 1
            # No other allocation of the same sum is cheaper.
            if m == 2:
                price = lambda ts: sum(0 if t < 0 else n * simhash.comb(len(p), t) * simhash.KEY_COST
                                       + n * n / 2 * s[t] * simhash.PAIR_COST for p, s, t in zip(parts, shares, ts))
                assert cost == pytest.approx(min(price((t, distance - 1 - t)) for t in range(-1, distance + 1)))


def test_correlated_bits_meet():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (2000, 64), dtype=np.uint8)
    bits[:, 40:50] = bits[:, [3]]  # eleven bits that always agree
    fps = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    parts = simhash.group_bits(simhash._both_set(fps).reshape(64, 64), len(fps), 4)
    assert any({3, *range(40, 50)} <= set(p) for p in parts)


def test_components(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, i) for i in range(1001, 1400)]
    more = [(int(a), int(b)) for a, b in rng.integers(2000, 2300, (200, 2))]
    links = [*chain, *star, *more, (5, 5), (7, 6), (7, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = [(a, b) for a, b in links if a != b]
    assert got == groups(sorted({n for l in linked for n in l}), linked)


def test_representatives(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    base = [[word() for _ in range(200)] for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        for k in range(3):  # three words changed: similarity about 0.86
            c = list(b)
            for at in rng.choice(200, 3, replace=False):
                c[at] = word()
            rows.append((1000 + 10 * i + k, " ".join(c)))
        rows.append((2000 + i, " ".join(b[:100] + [word() for _ in range(100)])))  # half new: no copy
    rows += [(3000, None), (3001, ""), (3002, " \n"), (None, rows[0][1]), (None, "only here and without any id"), rows[1], rows[1]]
    full = [(d, t, "x", 1) for d, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, fp string, node int")
    kept = neardup.representatives(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id for r in kept.collect()), key=repr)
    want = sorted([*range(30), *range(2000, 2030), 3000, None], key=repr)
    missing, extra = set(want) - set(got), set(got) - set(want)
    assert not missing and len(extra) <= 2 and got.count(None) == 1 and got.count(1) == 1
    assert neardup.representatives(empty(spark)).collect() == []


@pytest.mark.parametrize("distance", [4, 10])
def test_crowded_runs_of_equal_fingerprints_end(monkeypatch, distance):
    monkeypatch.setattr(simhash, "SMALL_GROUP", 8)
    calls, plain_compare = [], simhash.compare_runs

    def counted(*args):
        calls.append(1)
        assert len(calls) < 5000
        return plain_compare(*args)

    monkeypatch.setattr(simhash, "compare_runs", counted)
    fps = np.array([5] * 30 + [6] * 30 + [2 ** 60 - 1] * 30, np.uint64)
    node = np.arange(90)
    for checks in (None, np.zeros((90, 2), np.uint64)):
        found = simhash._Links()
        simhash.compare_runs(simhash._Rows(fps, node, checks, 0), np.array([0]), distance, 2 ** 64 - 1, found)
        a, b = found.reduce()
        assert groups(node.tolist(), zip(a.tolist(), b.tolist())) == {n: 0 if n < 60 else 60 for n in range(90)}
