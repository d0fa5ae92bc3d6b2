"""Ball trees and top-k against brute force."""

import numpy as np
import pytest

from lexspark.llm import balltree


def brute(ids, rows, query_ids, queries, k):
    out = {}
    for q, v in zip(query_ids, queries):
        score = rows @ v
        ok = ids != q
        order = np.lexsort((ids[ok], -score[ok]))[:k]
        out[int(q)] = list(zip(ids[ok][order].tolist(), score[ok][order].astype(int).tolist()))
    return out


@pytest.mark.parametrize("n,same,k", [(0, 0, 3), (1, 0, 3), (40, 0, 50), (900, 0, 20), (900, 400, 20), (900, 900, 5)])
def test_tree(n, same, k):
    rng = np.random.default_rng(n + same)
    rows = np.floor(64 * rng.normal(0, 0.1, (n, 16)))
    rows[:same] = rows[:1]
    ids = rng.permutation(n).astype(np.int64)
    queries, query_ids = rows[: 50].copy(), ids[: 50]
    tree = balltree.BallTree(ids, rows, k)
    at, found, score = tree.search(query_ids, queries, np.full(len(queries), -2.0 ** 62), k)
    got = {int(q): list(zip(found[at == i].tolist(), score[at == i].astype(int).tolist())) for i, q in enumerate(query_ids)}
    assert got == brute(ids, rows, query_ids, queries, k)


def test_floor_keeps_ties():
    rows = np.array([[1.0], [2.0], [2.0], [3.0]])
    tree = balltree.BallTree(np.arange(4), rows, 2)
    at, found, score = tree.search(np.array([9]), np.array([[1.0]]), np.array([2.0]), 2)
    assert found.tolist() == [3, 1] and score.tolist() == [3.0, 2.0]


@pytest.mark.parametrize("n,same", [(300, 0), (300, 200)])
def test_large_components(n, same):
    """Scores beyond 2**53 that differ by less than a double can show."""
    rng = np.random.default_rng(n + same)
    rows = rng.integers(2 ** 28, 2 ** 28 + 40, (n, 16)) * rng.choice([-1, 1], (n, 1))
    rows[:same] = rows[:1]
    ids = rng.permutation(n).astype(np.int64)
    floor = np.full(30, float(balltree.LEAST))
    tree = balltree.BallTree(ids, rows.astype(float), 7, 8, rows)
    want = brute(ids, rows, ids[:30], rows[:30], 7)
    # Once without a floor, once with the k-th score, as a double, as the floor.
    for _ in range(2):
        at, found, score = tree.search(ids[:30], rows[:30].astype(float), floor, 7, rows[:30])
        got = {int(q): list(zip(found[at == i].tolist(), score[at == i].tolist())) for i, q in enumerate(ids[:30])}
        assert got == want
        floor = np.array([float(want[int(q)][-1][1]) for q in ids[:30]])


def test_large_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(180_000, 180_020, 8)], 0, "") for i in range(120)]
    vectors = balltree.usable(frame(spark, rows))
    whole, ids = np.array([r[1] for r in rows]).astype(np.int64) * 64, np.arange(120)
    want = brute(ids, whole, ids[::20], whole[::20], 5)
    got = {}
    for r in sorted(balltree.top_k(vectors, vectors.where("vec_id % 20 = 0"), 5, shard_rows=30).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want
    with pytest.raises(Exception, match="exceed a long"):
        huge = balltree.usable(frame(spark, [(1, [1e30, 1.0], 0, ""), (2, [1e30, 2.0], 0, "")]))
        balltree.top_k(huge, huge, 5).collect()


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")


def test_top_k_with_many_shards_and_hard_cases(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(0, 0.2, (600, 8)) + rng.normal(0, 0.3, (6, 8))[rng.integers(0, 6, 600)]).astype(np.float32)
    vectors[300:500] = vectors[300]  # a third of all rows
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(vectors)]
    bad = [(1000, None, 0, ""), (1020, [None] * 8, 0, ""), (1040, [float("nan")] * 8, 0, ""), (1060, [float("inf")] * 8, 0, ""),
           (None, [1.0] * 8, 0, ""), rows[5], rows[20]]
    made = balltree.usable(frame(spark, rows + bad))
    got = {}
    for r in balltree.top_k(made, made.where("vec_id % 20 = 0"), 20, shard_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = np.floor(64 * vectors.astype(float))
    ids = np.arange(600)
    assert got == brute(ids, whole, ids[::20], whole[::20], 20)


def test_few_rows_short_vectors_and_none(spark):
    made = balltree.usable(frame(spark, [(0, [1.0, 2.0], 0, ""), (1, [1.0], 0, ""), (2, [], 0, "")]))
    got = [tuple(r) for r in balltree.top_k(made, made.where("vec_id = 0"), 20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 4096), (0, 2, 2, 0)]
    none = made.limit(0)
    assert balltree.top_k(none, none).collect() == []
    assert balltree.top_k(made, none).collect() == []
    with pytest.raises(Exception, match="too large"):
        big = balltree.usable(frame(spark, [(0, [1e30], 0, ""), (1, [1e30], 0, "")]))
        balltree.top_k(big, big).collect()
