"""Hilbert order: the curve itself, even shards, pruning."""

import itertools

import numpy as np
import pytest
from cases import documents, empty, multiset

from lexspark.llm import hilbert


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_is_a_hilbert_curve(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert.curve_index(points, bits)
    assert sorted(index.tolist()) == list(range(len(points)))
    steps = np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(1)
    assert (steps == 1).all()


@pytest.mark.parametrize("shards", [1, 7, 8, 500])
def test_even_runs(spark, shards):
    docs, rows = documents(spark)
    got = hilbert.shard(docs, ["lang", "doc_id", "score"], shards).collect()
    assert multiset((r.doc_id, r.text) for r in got) == multiset(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(i, [])) for i in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    curve = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert curve == sorted(curve)


def test_a_cell_with_a_third_of_the_rows_is_spread(spark):
    rows = [(i, "t", "same" if i % 3 else f"s{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = hilbert.shard(docs, ["source"], 8).groupBy("shard").count().collect()
    assert {r["count"] for r in got} == {375}


def test_manifest_prunes(spark):
    rows = [(i, i % 64, (i * 37) % 61) for i in range(4096)]
    docs = spark.createDataFrame(rows, "doc_id long, a int, b int")
    got = hilbert.shard(docs, ["a", "b"], 8).cache()
    bounds = hilbert.cell_bounds(docs, ["a", "b"])
    cells = hilbert.hilbert(docs, ["a", "b"], bounds).where("a = 3 and b < 8").select("cells").collect()
    listed = hilbert.manifest(got, ["a", "b"], run=64).collect()
    assert sum(r.n_rows for r in listed) == 4096
    # Runs that the manifest rules out hold none of the wanted cells, and they are most.
    wanted = [tuple(c.cells) for c in cells]
    hit = [r for r in listed if any(r.min_a <= x <= r.max_a and r.min_b <= y <= r.max_b for x, y in wanted)]
    runs = {(r.shard, r.slot // 64) for r in got.collect() if r.a == 3 and r.b < 8}
    assert runs <= {(r.shard, r.run) for r in hit} and len(hit) < len(listed) / 4


def test_nulls_have_their_own_cell_and_nothing_is_fine(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "a", 1.0), (3, "a", float("nan")), (3, "a", float("nan"))],
                                 "doc_id long, source string, x double")
    got = hilbert.shard(docs, ["source", "x"], 2).collect()
    assert {(r.doc_id, r.cells[0] == 0, r.cells[1] == 0) for r in got} == {(1, True, True), (2, False, False), (3, False, True)}
    assert hilbert.shard(empty(spark), ["lang", "n_chars"], 8).collect() == []


def test_written_runs_are_read_back(spark, tmp_path):
    docs, rows = documents(spark, extra=False)
    hilbert.write(hilbert.shard(docs, ["doc_id"], 4), str(tmp_path / "out"), run=16)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert multiset((r.doc_id, r.text) for r in back.collect()) == multiset(rows)
    with pytest.raises(ValueError):
        hilbert.hilbert(docs, ["doc_id"] * 11, [], 6)
