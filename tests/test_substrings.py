"""Substrings by an index of pieces: the same answers as a scan of everything."""

import random

import pytest
from pyspark.sql import functions as F

from lexspark.functions.text import contains_folded
from lexspark.operators import match, substrings
from lexspark.plans import reading, search
from lexspark.sources.tables import Library, containing

ALPHABET = "aáÁbBñ 😀\n'\\"


def ids(df):
    return sorted(r.id_tesis for r in df.collect())


@pytest.fixture(scope="module")
def small(spark, criteria, tmp_path_factory):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices(ALPHABET, k=rng.randint(0, n)))
    rows = [{"id_tesis": str(i), "rubro": text(8), "texto": text(30) if i % 9 else None, "tesis_codigo": text(5)} for i in range(80)]
    return Library.save(criteria(rows), str(tmp_path_factory.mktemp("pieces") / "lib"), 4, pieces=True)


def test_random_needles(small):
    rng = random.Random(12)
    full = Library(small.corpus, small.postings, small.doc_stats, small.term_stats, small.corpus_stats)
    needles = ["a", "ab", "ÁB", "n~", "😀", "😀b", "", " ", "zzz"] + ["".join(rng.choices(ALPHABET, k=rng.randint(1, 4))) for _ in range(8)]
    for needle in needles:
        for column in ("rubro", "tesis_codigo"):
            got = containing(small, [[needle]], (column,)).filter(contains_folded(F.col(column), F.lit(needle)))
            assert ids(got) == ids(small.corpus.filter(contains_folded(F.col(column), F.lit(needle)))), (needle, column)
    for _ in range(4):
        concepts = [rng.sample(needles, 2), rng.sample(needles, 3)]
        scope = rng.choice(["todo", "texto", "rubro"])
        want = ids(small.corpus.filter(match.scan_condition(concepts, scope)))
        assert ids(search.scanned(small, concepts, scope)) == ids(search.scanned(full, concepts, scope)) == want, (concepts, scope)


def test_few_criteria_are_read(spark, lib):
    """The pieces propose nearly what the test keeps, and only those ids go to the scan."""
    for needle, column in (("7/2", "tesis_codigo"), ("ÇAI", "rubro")):
        right = lib.corpus.filter(contains_folded(F.col(column), F.lit(needle))).count()
        assert right <= substrings.proposed(lib.pieces, [[needle]], (column,)).count() <= right + 2
    plan = containing(lib, [["ÇAI"]], ("rubro",))._jdf.queryExecution().executedPlan().toString()
    assert "In(id_tesis" in plan or "EqualTo(id_tesis" in plan
    assert "Join" not in plan
    assert ids(reading.read(lib, "no such code", "tesis_codigo")) == []


def test_pieces_group_without_a_shuffle(spark, lib):
    plan = substrings.proposed(lib.pieces, [["nicht", "mente"]], ("texto", "rubro"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in text, text
    assert "PushedFilters: [In(campo" in text or "In(piece" in text


def test_reopened(spark, small, criteria, tmp_path):
    root = str(tmp_path / "plain")
    assert Library.save(criteria([{"id_tesis": "1"}]), root, 2).pieces is None
    assert Library.open(spark, root).pieces is None
    assert small.pieces is not None
