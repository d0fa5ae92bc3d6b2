"""The public searches: errors, equal forms, skewed corpora."""

import pytest

from lexspark import session
from lexspark.operators import match
from lexspark.plans import dossier, profile, reading, search
from lexspark.plans.similar import similar_batch
from lexspark.sources.tables import Library

SYNONYMS = ["mente", "constitucional civil", "nicht"]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("run", [
    lambda lib: search.search_concept(lib, []),
    lambda lib: search.search_concept(lib, ["", '"*"', " ( ) "]),
    lambda lib: search.search_intersection(lib, ["a"], []),
    lambda lib: search.search_near(lib, "a", ""),
    lambda lib: search.search_contradiction(lib, []),
    lambda lib: search.search_circuit(lib, "nada", ["a"]),
    lambda lib: search.search_similar(lib, "no such id"),
    lambda lib: search.timeline(lib, []),
    lambda lib: profile.facet(lib.corpus, "texto"),
    lambda lib: reading.read_many(lib, ["", " "]),
    lambda lib: reading.read(lib, "1", "texto"),
])
def test_bad_arguments(lib, run):
    with pytest.raises(ValueError):
        run(lib)


def test_special_characters(lib):
    plain = search.search_concept(lib, ["the that"], texts=False)
    noisy = search.search_concept(lib, ['"the* (that)^', "???"], texts=False)
    assert rows(plain) == rows(noisy) != []


def test_no_match_is_empty(lib):
    assert search.search_concept(lib, ["zzzzqqqq"]).collect() == []
    assert search.search_intersection(lib, ["the"], ["..."], texts=False).collect() == []


def test_binding_criteria_come_first(lib):
    found = search.search_concept(lib, ["the", "la", "der"], limite=100, texts=False).orderBy("rank").collect()
    levels = [r.nivel for r in found]
    assert levels[0] == "S"
    assert levels == sorted(levels, key=lambda x: (x in "EF", "SABCD".find(x) if x in "SABCD" else 0))


def test_limits(lib):
    assert search.search_concept(lib, ["the"], limite=0, texts=False).count() == 1
    assert search.search_concept(lib, ["the"], limite=100, texts=False).count() == 100


@pytest.mark.parametrize("run", [
    lambda lib: search.search_concept(lib, ["the"], limite=101),
    lambda lib: search.search_similar(lib, "6", 51),
    lambda lib: search.timeline(lib, ["the"], limite=81),
    lambda lib: similar_batch(lib, lib.corpus, 51),
    lambda lib: reading.read_many(lib, [str(n) for n in range(16)]),
    lambda lib: search.search_near(lib, "the", "and", mode="scan"),
])
def test_more_than_the_maximum_is_an_error(lib, run):
    with pytest.raises(ValueError):
        run(lib)


@pytest.mark.parametrize("bad,said", [
    ({"limite": 101}, "limite above"), ({"distancia": 3}, "exactly two"),
    ({"distancia": 3, "concepts": [["a"], ["b"], ["c"]]}, "exactly two"),
])
def test_batch_rejects_what_it_cannot_do(spark, lib, bad, said):
    with pytest.raises(Exception, match=said):
        search.search_batch(lib, search.query_table(spark, [{"concepts": [["the"]], **bad}])).collect()


def test_batch_distances_are_clamped(spark, lib):
    pair = [["the that"], ["and"]]
    got = {}
    for d in (0, 1, 100, 5000):
        table = search.query_table(spark, [{"concepts": pair, "distancia": d, "limite": 100}])
        got[d] = rows(search.search_batch(lib, table))
    assert got[0] == got[1] != [] and got[100] == got[5000] != got[1]


def test_any_number_of_concepts(criteria):
    words = [f"w{n}" for n in range(80)]
    small = Library.of(criteria([{"id_tesis": "all", "texto": " ".join(words)}, {"id_tesis": "less", "texto": " ".join(words[:-1])}]))
    spark = small.corpus.sparkSession
    for n in (2, 63, 64, 65, 80):
        table = search.query_table(spark, [{"concepts": [[w] for w in words[-n:]]}])
        assert [r.id_tesis for r in search.search_batch(small, table).collect()] == ["all"]


def test_contradiction_across_lines(criteria):
    from lexspark.operators import match

    found = criteria([{"id_tesis": "1", "texto": "Contradicción\nentre varias de tesis"}, {"id_tesis": "2", "texto": "contradicción", "precedentes": "de tesis"},
                      {"id_tesis": "3", "rubro": "contradiccion de criterios"}, {"id_tesis": "4", "texto": None}])
    assert {r.id_tesis for r in found.filter(match.mentions_contradiction()).collect()} == {"1", "3"}


def test_batch_equals_single(spark, lib):
    queries = [
        {"query_id": "a", "concepts": [SYNONYMS], "limite": 40},
        {"query_id": "b", "concepts": [["mente", "nicht"], ["the that", "la"]], "orden": "relevancia"},
        {"query_id": "c", "concepts": [["the that"], ["and"]], "distancia": 3, "instancia": "scjn"},
        {"query_id": "d", "concepts": [["mente", "the that"]], "buscar_en": "rubro", "orden": "reciente"},
        {"query_id": "e", "concepts": [["the"]], "solo_jurisprudencia": True, "anio_minimo": 2005,
         "anio_maximo": 2020, "epocas": ["decima"], "materia": "comun", "organo": "sala"},
        {"query_id": "f", "concepts": [["the"]], "circuito": 17},
    ]
    batch = {}
    for r in search.search_batch(lib, search.query_table(spark, queries)).collect():
        batch.setdefault(r.query_id, set()).add(tuple(r)[1:])
    single = {
        "a": search.search_concept(lib, SYNONYMS, limite=40, texts=False),
        "b": search.search_intersection(lib, ["mente", "nicht"], ["the that", "la"], orden="relevancia", texts=False),
        "c": search.search_near(lib, "the that", "and", 3, instancia="scjn", texts=False),
        "d": search.search_concept(lib, ["mente", "the that"], buscar_en="rubro", orden="reciente", texts=False),
        "e": search.search_concept(lib, ["the"], True, "comun", "", "sala", 2005, 2020, ["10"], texts=False),
        "f": search.search_circuit(lib, 17, ["the"], limite=25, texts=False),
    }
    for name, df in single.items():
        assert {tuple(r)[1:] for r in df.collect()} == batch.get(name, set()), name


def test_batch_rejects_unknown_filters(spark, lib):
    for bad in ({"instancia": "no such"}, {"epocas": ["xyz"]}):
        with pytest.raises(Exception, match="unknown instancia|none of the epocas"):
            search.search_batch(lib, search.query_table(spark, [{"concepts": [["the"]], **bad}])).collect()


def test_large_query_tables_take_the_salted_path(spark, lib, monkeypatch):
    queries = [
        {"query_id": "a", "concepts": [SYNONYMS], "limite": 40},
        {"query_id": "b", "concepts": [["the that"], ["and"]], "distancia": 3},
        {"query_id": "c", "concepts": [["mente", "nicht"], ["the that", "la"]]},
    ]
    table = search.query_table(spark, queries)
    small = rows(search.search_batch(lib, table))
    monkeypatch.setattr(match, "small_rows", lambda df: None)
    monkeypatch.setattr(search, "small_rows", lambda df: None)
    assert rows(search.search_batch(lib, table)) == small != []


def test_saved_library_reopens(spark, lib, tmp_path):
    Library.save(lib.corpus.drop("epoca_part"), str(tmp_path / "one"), 4)
    again = Library.open(spark, str(tmp_path / "one"))
    fresh = Library.of(lib.corpus.drop("epoca_part"))
    for name in ("postings", "doc_stats", "term_stats", "corpus_stats"):
        a, b = getattr(again, name), getattr(fresh, name)
        assert a.select(b.columns).exceptAll(b).count() == b.exceptAll(a.select(b.columns)).count() == 0


def test_stored_index_is_searched_without_shuffling_postings(lib):
    query = search.query_table(lib.corpus.sparkSession, [{"concepts": [["mente", "the that"]]}])
    plan = match.matches(match.hits(lib.postings, match.Lookups.of(query, lib.term_stats)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert "PushedFilters: [In(tok" in plan


def test_reopened_with_its_own_buckets(spark, criteria, tmp_path):
    """Another session knows neither the layout nor the tables; an old entry is replaced."""
    ids = [str(n) for n in range(40)]
    for buckets, text in ((8, "uno"), (6, "dos")):
        Library.save(criteria([{"id_tesis": i, "texto": f"{text} palabra{i}"} for i in ids]), str(tmp_path / "lib"), buckets)
        other = Library.open(spark.newSession(), str(tmp_path / "lib"))
        for i in ids:
            assert [r.texto for r in reading.read(other, i).collect()] == [f"{text} palabra{i}"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        Library.open(spark, str(tmp_path / "nothing"))


def references(lib, *ids):
    return lib.corpus.sparkSession.createDataFrame([(i,) for i in ids], "id_tesis string")


def test_similar_batch_is_the_single_form(lib):
    keys = ("6", "11", "57", "138", "199")
    every = {}
    for r in similar_batch(lib, references(lib, *keys, "6", "no such id"), 5).collect():
        every.setdefault(r.query_id, set()).add((r["rank"], r.id_tesis, r.bm25))
    assert set(every) == set(keys)
    for key in keys:
        one = {(r["rank"], r.id_tesis, r.bm25) for r in search.search_similar(lib, key, 5, texts=False).collect()}
        assert one == every[key]


def test_similar_batch_with_a_hot_title(criteria):
    """A third of the criteria share a title and one word is everywhere: the result stays whole."""
    rows_ = [{"id_tesis": str(i), "texto": f"comun cuerpo{i % 7} extra{i}",
              "rubro": "comun repetido titulo" if i % 3 == 0 else f"comun cuerpo{i % 7} otro_mas{i % 2} cuerpo{i % 7}"}
             for i in range(90)]
    small = Library.of(criteria(rows_))
    every = {}
    for r in similar_batch(small, small.corpus, 7).collect():
        every.setdefault(r.query_id, set()).add((r["rank"], r.id_tesis, r.bm25))
    assert len(every) == 90 and all(len(v) == 7 for v in every.values())
    for key in ("0", "1", "50", "89"):
        one = {(r["rank"], r.id_tesis, r.bm25) for r in search.search_similar(small, key, 7, texts=False).collect()}
        assert one == every[key]


def test_timeline_runs(spark):
    data = [("q", i + 1, e, 2000 + i, "c", "t", str(i), "S") for i, e in
            enumerate(["A", "A", None, "", "B", "A"])]
    df = spark.createDataFrame(data, "query_id string, rank int, epoca string, anio int, tesis_codigo string, "
                                     "rubro string, id_tesis string, nivel string")
    got = [(r.etapa, r.abre_etapa, r.epoca) for r in search.epoch_runs(df).orderBy("rank").collect()]
    assert got == [(1, True, "A"), (1, False, "A"), (2, True, "Sin época"), (2, False, "Sin época"),
                   (3, True, "B"), (4, True, "A")]


def test_citation_parts(criteria):
    full = {"id_tesis": "9", "tipo_tesis": "Jurisprudencia", "tesis_codigo": "1a./J. 1", "fuente": "SJF",
            "epoca": "Novena Época", "mes": "mayo", "anio": 2001, "rubro": "R", "instancia": "I", "organo_juris": "O"}
    bare = {"id_tesis": "8", "tipo_tesis": "", "mes": "", "anio": 1999}
    got = {r.id_tesis: r for r in reading.citations(criteria([full, bare])).collect()}
    assert got["9"].cita == "Jurisprudencia, 1a./J. 1, SJF, Novena Época, mayo de 2001, registro digital: 9."
    assert got["9"].ficha.endswith("Órgano emisor: I — O")
    assert got["8"].cita == "1999, registro digital: 8."


def test_dossier_joins_rounds(spark, lib):
    cases = spark.createDataFrame(
        [("k", [["mente", "nicht"], ["la", "der"]], ["the that"])],
        "case_id string, concepts array<array<string>>, opposing array<string>")
    found = dossier.dossier(lib, cases).collect()
    assert {x for r in found for x in r.rondas.split(", ")} == {
        dossier.CONCEPT, dossier.CROSSING, dossier.CONTRADICTION, dossier.OPPOSING}
    assert len({r.id_tesis for r in found}) == len(found)


def test_dossier_keeps_cases_apart_and_crosses_what_is_named(spark, lib):
    cases = spark.createDataFrame(
        [("a|b", [["the"], ["and"], ["of"], ["is"]], [], None), ("a|c", [["mente"], ["nicht"], ["la"], ["zzzz"]], [], [0, 2]),
         ("a", [["nicht"]], ["the"], None)],
        "case_id string, concepts array<array<string>>, opposing array<string>, cruce array<int>")
    found = dossier.dossier(lib, cases)
    got = {}
    for r in found.collect():
        got.setdefault(r.case_id, {})[r.id_tesis] = r.rondas
    assert set(got) == {"a|b", "a|c", "a"}
    # All four concepts cross without a choice; only the named ones with it.
    whole = search.query_table(spark, [{"concepts": [["the"], ["and"], ["of"], ["is"]], "limite": 15}])
    named = search.query_table(spark, [{"concepts": [["mente"], ["la"]], "limite": 15}])
    for case, table in (("a|b", whole), ("a|c", named)):
        crossed = {i for i, x in got[case].items() if dossier.CROSSING in x}
        assert crossed == {r.id_tesis for r in search.search_batch(lib, table).collect()}
    read = dossier.read_marked(lib, found).collect()
    assert {(r.case_id, r.id_tesis) for r in read} == {(r.case_id, r.id_tesis) for r in found.filter("leer").collect()}
    assert all(r.texto for r in read)


def test_diff_of_equal_results_is_empty(lib):
    one = search.search_concept(lib, SYNONYMS, texts=False)
    assert profile.result_diff(one, one).count() == 0


def test_cluster_needs_a_shared_folder(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_large_results_are_joined_not_pushed_down(lib, monkeypatch):
    from lexspark.sources import tables

    small = rows(search.search_concept(lib, SYNONYMS, limite=40))
    monkeypatch.setattr(tables, "small_rows", lambda df: None)
    assert rows(search.search_concept(lib, SYNONYMS, limite=40)) == small != []
