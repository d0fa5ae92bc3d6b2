"""Matching, scores and fragments against SQLite's full-text search, on the same texts."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from lexspark.operators import score
from lexspark.operators.filters import Filters
from lexspark.operators.match import Lookups
from lexspark.plans import search
from lexspark.sources.tables import Library


@pytest.fixture(scope="module")
def sqlite(lib):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(id unindexed, rubro, texto, precedentes, materias, "
                "tokenize='unicode61 remove_diacritics 2')")
    rows = lib.corpus.select("id_tesis", "rubro", "texto", "precedentes", "materias").collect()
    con.executemany("insert into f values (?, ?, ?, ?, ?)", [tuple(r) for r in rows])
    return con


def quoted(terms):
    return " OR ".join(f'"{t}"' for t in terms)


def sqlite_scores(con, expression):
    # Column 0 holds the id and is not indexed.
    return {r[0]: round(r[1], 6) for r in con.execute("select id, bm25(f) from f where f match ?", [expression])}


def our_scores(lib, concepts, scope="todo", near=None):
    query = search.query_table(lib.corpus.sparkSession, [{"concepts": concepts, "buscar_en": scope, "distancia": near}])
    return {r[0]: r[1] for r in score.scored(lib, Lookups.of(query, lib.term_stats))
            .select("id_tesis", score.as_bm25(F.col("units"))).collect()}


def same(a, b):
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 2e-6 for k in a)


CASES = [
    ([["mente", "constitucional civil", "nicht"]], "todo", None),
    ([["mente", "nicht"], ["the that", "la"]], "todo", None),
    ([["mente", "nicht"], ["de", "die"], ["la", "der"]], "todo", None),
    ([["the that"], ["and"]], "todo", 3),
    ([["la"], ["de"]], "todo", 1),
    ([["the"], ["the"]], "todo", 5),
    ([["mente", "the that"]], "rubro", None),
    ([["la", "the"], ["contradiccion de tesis", "contradiccion de criterios"]], "todo", None),
    ([["mente", "nicht", "the", "or", "the"]], "todo", None),
]


def expression(concepts, scope, near):
    if near is not None:
        return "NEAR(" + " ".join(f'"{c[0]}"' for c in concepts) + f", {near})"
    text = " AND ".join(f"({quoted(c)})" for c in concepts)
    return f"{{{scope}}} : ({text})" if scope != "todo" else text


@pytest.mark.parametrize("concepts,scope,near", CASES)
def test_scores(lib, sqlite, concepts, scope, near):
    want = sqlite_scores(sqlite, expression(concepts, scope, near))
    assert want
    same(our_scores(lib, concepts, scope, near), want)


def test_random_near_and_phrases(lib, sqlite):
    rng = random.Random(7)
    texts = [r[0] for r in lib.corpus.select("texto").orderBy("id_tesis").limit(40).collect()]
    for _ in range(4):
        words = [w for w in re.findall(r"[a-z]+", rng.choice(texts).lower()) if len(w) > 1]
        if len(words) < 12:
            continue
        i = rng.randrange(len(words) - 8)
        a, b, n = " ".join(words[i:i + rng.choice([1, 2])]), words[i + rng.randrange(2, 6)], rng.randrange(1, 12)
        want = sqlite_scores(sqlite, f'NEAR("{a}" "{b}", {n})')
        same(our_scores(lib, [[a], [b]], near=n), want)


@pytest.mark.parametrize("concepts,scope,near", [CASES[0], CASES[1], CASES[3], CASES[4], CASES[6]])
def test_fragments(lib, sqlite, concepts, scope, near):
    """Marks, windows and ellipses are those of the reference engine's own snippets."""
    spark = lib.corpus.sparkSession
    query = search.query_table(spark, [{"concepts": concepts, "buscar_en": scope, "distancia": near}])
    lookups = Lookups.of(query, lib.term_stats)
    ranking = search.ranked_one(lib, lookups, Filters(), "vinculancia", 100)
    got = {r.id_tesis: r.fragmento for r in search.presented(lib, ranking, lookups).collect()}
    want = dict(sqlite.execute("select id, snippet(f, 2, '«', '»', ' … ', 15) from f where f match ?",
                               [expression(concepts, scope, near)]).fetchall())
    assert got
    assert {k: want[k] for k in got} == got


def test_fragment_rules(spark, criteria):
    """Overlapping and adjacent phrases, sentence starts, short and hitless bodies."""
    filler = " ".join(f"w{i}" for i in range(40))
    bodies = [
        "z z z", "a z z b. z z", f"{filler} z z z z {filler}", f"¡Uno! {filler}: alfa z {filler}. z z beta",
        f"{filler}. Frase con z y más z z, fin.", filler, "…z…", f"{filler} z {filler} z z {filler} z z z",
        "z " * 30, f"z. {filler}", f"x y {filler}. z", "Canción z él z", "",
    ]
    rows = [{"id_tesis": str(i), "rubro": "z z" if b in (filler, "") else "q", "texto": b} for i, b in enumerate(bodies)]
    small = Library.of(criteria(rows))
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(id unindexed, rubro, texto, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("insert into f values (?, ?, ?)", [(r["id_tesis"], r["rubro"], r["texto"]) for r in rows])
    for terms in (["z"], ["z z"], ["z z", "z"], ["z z z", "w3 w4", "beta"]):
        want = dict(con.execute("select id, snippet(f, 2, '«', '»', ' … ', 15) from f where f match ?", [quoted(terms)]))
        got = {r.id_tesis: r.fragmento for r in search.search_concept(small, terms, limite=100).collect()}
        assert got == want


def test_tokens(spark):
    from lexspark.functions.text import tokens

    samples = ["1a./J. 45/2023", "a_b", "ÑANDÚ Çelik", "él niño", "Ação ŠKODA žluťoučký", "", None]
    df = spark.createDataFrame([(s,) for s in samples], "s string").select(tokens(F.col("s")))
    assert [r[0] for r in df.collect()] == [
        ["1a", "j", "45", "2023"], ["a", "b"], ["nandu", "celik"], ["el", "nino"],
        ["acao", "skoda", "zlutoucky"], [], []]
