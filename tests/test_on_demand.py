"""The stored library's tables: statistics without a group per posting, each table when it is first read."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexspark.operators import index
from lexspark.plans import reading, search
from lexspark.sources import tables
from lexspark.sources.tables import Library, OnDemand


def corpus(criteria, ids):
    rng = random.Random(7)
    text = lambda k: " ".join(rng.choices(["uno", "dos", "Ñandú", "x", "漢字", "7/2"], k=rng.randint(0, k)))
    return criteria([{"id_tesis": i, "rubro": text(4), "texto": text(30) if n % 5 else None, "materias": text(2),
                      "tesis_codigo": f"T. {i}"} for n, i in enumerate(ids)])


def counted(df):
    return sorted(map(tuple, df.select("tok", "df", "df_rubro", "df_texto").collect()))


def test_statistics_are_grouped_by_token_alone(criteria, tmp_path, monkeypatch):
    df = corpus(criteria, [str(n) for n in range(50)])
    want = counted(index.term_stats(index.postings(df)))
    monkeypatch.setattr(index, "term_stats", lambda posts: pytest.fail("a group per token and document"))
    assert counted(Library.save(df, str(tmp_path / "lib"), 2).term_stats) == want != []


@pytest.mark.parametrize("few", [True, False])
def test_repeated_and_null_ids_count_once(criteria, tmp_path, monkeypatch, few):
    df = corpus(criteria, [str(n % 40) if n % 9 else "none" for n in range(90)]).withColumn("id_tesis", F.nullif("id_tesis", F.lit("none")))
    if not few:
        monkeypatch.setattr(index, "small_rows", lambda df: None)
    assert counted(Library.save(df, str(tmp_path / "lib"), 2).term_stats) == counted(index.term_stats(index.postings(df))) != []


def test_no_rows(criteria, tmp_path):
    made = OnDemand(corpus(criteria, ["1"]).limit(0), str(tmp_path / "lib"), 2)
    assert made.term_stats.count() == made.postings.count() == made.pieces.count() == 0 and made.size == (0, 0.0)


def test_tables_are_written_when_they_are_read(spark, criteria, tmp_path):
    df, root = corpus(criteria, [str(n) for n in range(50)]), tmp_path / "lib"
    made, saved = OnDemand(df, str(root), 2), Library.save(df, str(tmp_path / "saved"), 2, pieces=True)
    there = lambda: {p.name for p in Path(root).glob("*")}
    rows = lambda found: sorted(map(str, found.collect()))
    assert rows(reading.cite(made, "T. 7", "tesis_codigo")) == rows(reading.cite(saved, "T. 7", "tesis_codigo")) != []
    assert there() == {"corpus"}
    scan = lambda lib: search.search_title(lib, ["dos", "x"], mode="scan", limite=50)
    assert rows(scan(made)) == rows(scan(saved)) != []
    assert there() == {"corpus", "pieces"}
    near = lambda lib: search.search_near(lib, "uno", "dos", 3, limite=50)
    assert rows(near(made)) == rows(near(saved)) != []
    again = made.complete()
    for name in ("corpus", "postings", "doc_stats", "term_stats", "corpus_stats", "pieces"):
        a, b, c = (getattr(lib, name) for lib in (made, saved, again))
        assert a.columns == b.columns == c.columns and rows(a) == rows(b) == rows(c) != [], name
    assert spark.read.schema(tables.MANIFEST).json(f"{root}/manifest").where(F.col("pieces")).count() == 1
