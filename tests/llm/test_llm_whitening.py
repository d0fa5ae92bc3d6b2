"""Whitening against numpy."""

import numpy as np
import pytest

from lexspark.llm import whitening

KIND = "vec_id long, embedding array<float>, label int, n string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n", "c") for i, v in rows], KIND)


def expected(rows, k=16):
    """{place in rows: (n, deviation, whitened up to sign, explained)} of usable rows."""
    good = {i: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for i, (_, v) in enumerate(rows)
            if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    x = np.array(sorted(set(map(tuple, good.values()))), np.int64)
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, row in good.items():
        away = [n * a - int(s) for a, s in zip(row, sums)]
        out[i] = n, sum(a * a for a in away), (np.array(row) - sums / n) @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)
    return out


def check(spark, rows, k=16):
    got = {}
    for r in whitening.whiten(table(spark, rows), k).collect():
        got.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    want = expected(rows, k)
    assert sum(len(x) for c in got.values() for x in c.values()) == len(want) * min(k, len(next(v for _, v in rows if v)))
    signs = None
    for i, (n, deviation, values, shares) in want.items():
        own = got[rows[i][0]]
        assert sorted(own) == list(range(1, len(values) + 1))
        line = [own[c][0] for c in sorted(own)]
        assert all(r.n == n and r.deviation == deviation and r.identity_error < 1e-6 for r in line)
        made = np.array([r.whitened for r in line])
        if signs is None:
            signs = np.where(np.sign(made) == np.sign(values), 1, -1)
        assert np.allclose(made, signs * values, atol=1e-6)
        assert np.allclose([r.explained for r in line], shares, rtol=1e-8)


def rows_of(n=300, d=6, seed=0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    return [(i, [float(c) for c in rng.normal(size=d) @ mix]) for i in range(n)]


@pytest.mark.parametrize("block", [1024, 37])
def test_against_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "ROWS", block)
    rows = rows_of()
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # a third of all rows
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 4), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5)]
    check(spark, rows)
    check(spark, rows, 2)


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check(spark, rows)


def test_large_values_are_exact(spark):
    rows = [(i, [c * 2.0 ** 34 for c in v]) for i, v in rows_of(40, 3)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(table(spark, rows)).where("component = 1").collect()}
    want = {rows[i][0]: e[1] for i, e in expected(rows).items()}
    assert got == {i: d if d < 1 << 63 else None for i, d in want.items()} and None in got.values()


def test_repeated_and_null_ids(spark):
    rows = rows_of(50, 3)
    twice = whitening.whiten(table(spark, rows + rows[:10] + [(None, rows[0][1])])).collect()
    once = {(r.vec_id, r.component): r for r in whitening.whiten(table(spark, rows)).collect()}
    assert len(twice) == 61 * 3
    assert {(r.n, r.deviation) for r in twice if r.vec_id == 4} == {(once[4, 1].n, once[4, 1].deviation)}
    assert sum(r.vec_id is None for r in twice) == 3


def test_flat_and_small(spark):
    flat = [(i, [v[0], 5.0, 2 * v[0]]) for i, v in rows_of(30, 1)]
    got = whitening.whiten(table(spark, flat)).collect()
    assert len(got) == 90 and {r.component for r in got if r.whitened is None} >= {3}
    assert all(r.identity_error < 1e-6 for r in got)
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None)] * 4


def test_odd_tables(spark):
    kind = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [])], [(1, [float("nan")])]):
        found = whitening.whiten(table(spark, rows))
        assert found.columns == kind and found.collect() == []
    with pytest.raises(ValueError, match="components"):
        whitening.whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
