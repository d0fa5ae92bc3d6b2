"""Query tables ranked by shares of documents and blocks of queries: the rows of the plain way."""

import random

import pytest
from pyspark.sql import functions as F

from lexspark.operators import match, rank, together
from lexspark.operators.match import Lookups
from lexspark.plans import search
from lexspark.plans.similar import similar_batch
from lexspark.sources.tables import Library

WORDS = ["amparo", "civil", "juez", "ley", "pago", "renta", "daño", "plazo", "de", "la"]


@pytest.fixture(scope="module")
def small(spark):
    """Many ties, empty titles, a missing year, and a criterion that comes twice."""
    from lexspark.sources.schema import TESIS

    rng, made = random.Random(7), []
    for i in range(80):
        row = {"id_tesis": str(i % 79), "rubro": " ".join(rng.choices(WORDS, k=3)) if i % 4 else None,
               "texto": " ".join(rng.choices(WORDS, k=rng.choice([0, 3, 30]))) if i % 7 else "ley de pago", "tipo_tesis": "Jurisprudencia" if i % 3 else "Aislada",
               "anio": 2000 + i % 5 if i % 11 else None, "materias": "Civil" if i % 2 else "", "instancia": "Plenos de Circuito" if i % 5 else ""}
        made.append([row.get(f) for f in TESIS.names])
    return Library.of(spark.createDataFrame(made, TESIS).cache())


def batch(spark):
    concepts = [[["juez", "ley de"]], [["daño"], ["plazo", "renta"]], [["de la", "amparo", "amparo"]], [["pago"], []], [["pago"], ["de"], ["la"]], [["nada"]]]
    return search.query_table(spark, [
        {"query_id": f"{n}-{order}", "concepts": c, "orden": order, "limite": 3 + n, "buscar_en": ("todo", "texto", "rubro")[n % 3],
         "solo_jurisprudencia": n % 2 == 0, "materia": "civil" if n == 1 else ""}
        for n, c in enumerate(concepts)
        for order in (rank.BY_FORCE, rank.BY_SCORE, rank.BY_DATE, rank.BY_YEAR, rank.BY_SIMILARITY, "otro")])


def rows(df):
    return sorted((r["query_id"], r["rank"], r.id_tesis, r.bm25) for r in df.collect())


def test_the_rows_of_the_plain_way(spark, small, monkeypatch):
    keys = spark.createDataFrame([(str(n),) for n in range(0, 79, 2)], "id_tesis string")
    got = rows(search.search_batch(small, batch(spark))), rows(similar_batch(small, keys, 4))
    monkeypatch.setattr(together, "filter_kinds", lambda *_: None)
    assert got == (rows(search.search_batch(small, batch(spark))), rows(similar_batch(small, keys, 4))) and all(got)


def test_no_row_per_query_and_matching_document(spark, small, monkeypatch):
    """The terms of all queries are brought to documents once; copies of a query add only its best."""
    asked = batch(spark).where("orden = 'vinculancia'").withColumn(
        "query_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda n: F.concat("query_id", F.lit("/"), n.cast("string")))))
    seen, plain = [], search.score.scored

    def counted(lib, lookups):
        found = plain(lib, lookups)
        seen.append(found.count())
        return found

    monkeypatch.setattr(search.score, "scored", counted)
    assert search.search_batch(small, asked).count() > 40
    terms = match.query_terms(asked).select("buscar_en", "tok").distinct().count()
    assert seen and sum(seen) <= 80 * (terms + 4)


def test_shares_and_blocks(spark, small, monkeypatch):
    want = rows(search.search_batch(small, batch(spark)))
    monkeypatch.setattr(together, "SHARE", 20)
    monkeypatch.setattr(together, "BLOCK", 7)
    monkeypatch.setattr(together, "FEWEST", 10)
    assert rows(search.search_batch(small, batch(spark))) == want


def test_ids_that_come_twice_and_many_filters_take_the_plain_way(spark, monkeypatch):
    table = search.query_table(spark, [{"query_id": "a", "concepts": [["x"]]}, {"query_id": "b", "concepts": [["x"]], "anio_minimo": 2000}])
    lookups = Lookups.of(table, spark.createDataFrame([("x", 1, 1, 1)], "tok string, df long, df_rubro long, df_texto long"))
    assert together.filter_kinds(table, lookups).count() == 2
    assert together.filter_kinds(table.unionByName(table), lookups) is None
    monkeypatch.setattr(together, "MAX_KINDS", 1)
    assert together.filter_kinds(table, lookups) is None


def test_nothing_grows_with_shares_times_queries(spark, small, monkeypatch):
    """A task keeps a query's best of all its shares; what it hands on does not grow with the shares."""
    asked = batch(spark).where("orden = 'vinculancia'")
    want = rows(search.search_batch(small, asked))
    for name, value in (("SHARE", 1), ("FEWEST", 2), ("TASKS", 0), ("_ROWS", 3)):
        monkeypatch.setattr(together, name, value)
    seen, plain = [], search._listed

    def counted(found, order, limit):
        seen.append(found.groupBy("query_id").count().agg(F.max("count")).first()[0])
        return plain(found, order, limit)

    monkeypatch.setattr(search, "_listed", counted)
    # Without tasks for the cores, one task meets all shares.
    assert rows(search.search_batch(small, asked)) == want
    # Limits are 3 to 8; ties with the last place stay.
    assert seen and seen[0] <= 20


def test_sums_that_doubles_cannot_hold(spark, small, monkeypatch):
    want = rows(search.search_batch(small, batch(spark)))
    monkeypatch.setattr(together, "_EXACT", 0)
    assert rows(search.search_batch(small, batch(spark))) == want


def test_a_few_phrases_are_broadcast_and_read_their_own_tokens(spark, small, monkeypatch):
    want = rows(search.search_batch(small, batch(spark)))
    monkeypatch.setattr(match, "small_rows", lambda df: None)
    monkeypatch.setattr(match, "BROADCAST_TERMS", 3)
    read, plain = [], Lookups.with_other_tokens

    def counted(self, posts, phrases):
        found = plain(self, posts, phrases)
        read.append({r.tok for r in found.select("tok").distinct().collect()})
        return found

    monkeypatch.setattr(Lookups, "with_other_tokens", counted)
    assert rows(search.search_batch(small, batch(spark))) == want
    # "ley de" and "de la": the postings of their first tokens are not read again.
    assert read and set.union(*read) < {"de", "la", "ley"}
