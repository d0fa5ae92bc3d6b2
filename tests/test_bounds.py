"""Searches by score that read only what can reach the best: the same answers as scoring all."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from lexspark.operators import bounds, match
from lexspark.operators.match import Lookups
from lexspark.plans import search
from lexspark.plans.similar import similar_batch
from lexspark.sources.tables import Library

WORDS = ["amparo", "civil", "juez", "ley", "pago", "renta", "daño", "plazo", "de", "la"]


def saved(spark, corpus, root):
    """The library with its bounds, and the same without."""
    Library.save(corpus, root, 2)
    lib = Library.save_bounds(spark, root)
    return lib, dataclasses.replace(lib, impacts=None)


def rows(df):
    return sorted((r["query_id"], r["rank"], r.id_tesis, r.bm25) for r in df.collect())


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory, request):
    """Random texts of very different lengths, many of them equal (ties), some without words."""
    from lexspark.sources.schema import TESIS

    rng = random.Random(3)
    made = []
    for i in range(90):
        text = " ".join(rng.choices(WORDS, weights=range(1, 11), k=rng.choice([0, 2, 5, 40])))
        row = {"id_tesis": str(i), "rubro": " ".join(rng.choices(WORDS, k=3)) if i % 4 else None, "texto": text if i % 7 else "ley de pago",
               "tipo_tesis": "Jurisprudencia" if i % 3 else "Aislada", "anio": 2000 + i % 5, "materias": "Civil" if i % 2 else ""}
        made.append([row.get(f) for f in TESIS.names])
    held = bounds.BLOCK
    bounds.BLOCK = 4
    yield saved(spark, spark.createDataFrame(made, TESIS), str(tmp_path_factory.mktemp("bounds") / "lib"))
    bounds.BLOCK = held


@pytest.fixture
def tight(monkeypatch):
    monkeypatch.setattr(bounds, "FIRST", 2)


def test_blocks(both):
    lib, _ = both
    placed = lib.blocks.join(lib.doc_stats, "id_tesis").groupBy("block").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in placed) == 90 and max(r.n for r in placed) == 4
    most = lib.bounds.count()
    assert most < lib.impacts.count() == lib.postings.select("id_tesis", "tok").distinct().count()


@pytest.mark.parametrize("concepts,scope,f", [
    ([["amparo", "renta", "la"]], "todo", {}),
    ([["amparo", "civil"], ["plazo", "de"]], "texto", {"solo_jurisprudencia": True, "anio_minimo": 2002}),
    ([["ley de pago", "juez"]], "rubro", {}),
    ([["ley de", "renta"], ["la", "de la"]], "todo", {"solo_jurisprudencia": True}),
    ([["none such"]], "todo", {}),
])
def test_single(both, tight, concepts, scope, f):
    def asked(lib):
        return rows(search._run(lib, concepts, search.Filters(**f), order="relevancia", limit=6, scope=scope, texts=False))

    lib, plain = both
    assert asked(lib) == asked(plain)


def batch(spark, orders=("relevancia", "similitud")):
    rng = random.Random(5)
    return search.query_table(spark, [
        {"concepts": [rng.sample([*WORDS, "ley de", "nada"], rng.randint(1, 5)) for _ in range(rng.choice([1, 1, 2]))],
         "buscar_en": rng.choice(search.SCOPES), "orden": rng.choice(orders), "limite": rng.choice([1, 3, 9, 100]),
         "materia": rng.choice(["", "civil"]), "solo_jurisprudencia": rng.random() < 0.3}
        for _ in range(25)])


def test_batch(spark, both, tight):
    lib, plain = both
    want = rows(search.search_batch(plain, batch(spark)))
    assert want and rows(search.search_batch(lib, batch(spark))) == want
    mixed = batch(spark, ("relevancia", "reciente", "vinculancia"))
    assert rows(search.search_batch(lib, mixed)) == rows(search.search_batch(plain, mixed))
    near = batch(spark).limit(1).withColumn("concepts", F.expr("array(array('ley'), array('de'))")).withColumn("distancia", F.lit(2))
    assert rows(search.search_batch(lib, near)) == rows(search.search_batch(plain, near))


def test_large_tables_of_queries(spark, both, tight, monkeypatch):
    """The plan of tables too large to be broadcast."""
    lib, plain = both
    want = rows(search.search_batch(plain, batch(spark)))
    monkeypatch.setattr(match, "small_rows", lambda df: None)
    monkeypatch.setattr(bounds, "small_rows", lambda df: None)
    monkeypatch.setattr(search, "small_rows", lambda df: None)
    assert rows(search.search_batch(lib, batch(spark))) == want


def test_similar(both, tight):
    lib, plain = both
    keys = lib.corpus.select("id_tesis")
    assert rows(similar_batch(lib, keys, 4)) == rows(similar_batch(plain, keys, 4))


def test_less_is_read(spark, both, tight):
    """A rare word and frequent ones: the frequent ones are read for few documents."""
    lib, _ = both
    queries = search.durable(search.completed(search.query_table(spark, [{"concepts": [["amparo", "la", "de"]], "orden": "relevancia", "limite": 3}])))
    lookups = Lookups.of(queries, lib.term_stats)
    leading, completing = bounds.parts(lib, lookups, search._admitted(lib, queries), F.col("limite"))
    matched = lib.impacts.filter(F.col("tok").isin("amparo", "la", "de")).count()
    assert leading.count() + completing.count() < matched / 2


def test_few_texts(spark, criteria, tmp_path):
    """No token at all, and one."""
    for texts in (["", None], [None, "ley"]):
        root = str(tmp_path / f"lib{texts[1]}")
        lib, plain = saved(spark, criteria([{"id_tesis": str(n), "texto": t} for n, t in enumerate(texts)]), root)
        found = rows(search.search_concept(lib, ["ley"], orden="relevancia", texts=False))
        assert found == rows(search.search_concept(plain, ["ley"], orden="relevancia", texts=False))
        assert len(found) == ("ley" in texts) and Library.open(spark, root).impacts is not None


def test_impacts_are_counted_from_texts(spark, criteria, tmp_path, monkeypatch):
    """The rows that the postings give, ids that come twice included; of postings only these are grouped."""
    made = [{"id_tesis": str(i % 27), "rubro": "uno dos uno" if i % 4 else None, "texto": f"uno w{i % 5} uno " * (i % 6), "materias": "uno"} for i in range(30)]
    df = criteria(made)
    grouped, plain = [], bounds.impacts

    def counted(posts, placed):
        grouped.append({r.id_tesis for r in posts.select("id_tesis").distinct().collect()})
        return plain(posts, placed)

    monkeypatch.setattr(bounds, "impacts", counted)
    Library.save(df, str(tmp_path / "lib"), 2)
    lib = Library.save_bounds(spark, str(tmp_path / "lib"))
    names = ["block", "tok", "id_tesis", "dl", "f_todo", "f_rubro", "f_texto"]
    want = sorted(map(tuple, plain(lib.postings, lib.blocks).select(names).collect()))
    assert sorted(map(tuple, lib.impacts.select(names).collect())) == want and want
    assert grouped == [{"0", "1", "2"}]
