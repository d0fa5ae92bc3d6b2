"""Landed replies, batches, retries and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from lexspark.operators import index
from lexspark.plans import health, profile
from lexspark.sources import landing
from lexspark.sources.schema import LANDED, TESIS
from lexspark.sources.tables import Library
from lexspark.streaming.refresh import NEW_ONLY, UPSERT, Store


def replies(spark, *rows):
    data = [(i, p if isinstance(p, str) else json.dumps(p, ensure_ascii=False)) for i, p in rows]
    return spark.createDataFrame(data, LANDED)


def test_normalise(spark):
    df = landing.normalized(replies(
        spark,
        ("1", {"idTesis": 7, "rubro": "R", "materias": ["Civil", "Penal"], "anio": 2001, "tesis": "c"}),
        ("2", {"materias": "Común", "anio": "1999", "organoJuris": "O", "otra": {"x": 1}}),
        ("3", {"materias": [], "anio": "mil"}), ("4", {"anio": 2020.0}), ("5", {"anio": "2020.5"}), ("6", {"anio": "1e99"}),
    ))
    got = {r.id_tesis: r for r in df.collect()}
    assert df.columns == TESIS.names
    assert (got["7"].materias, got["7"].anio, got["7"].tesis_codigo) == ("Civil, Penal", 2001, "c")
    assert (got["2"].materias, got["2"].anio, got["2"].organo_juris, got["2"].rubro) == ("Común", 1999, "O", "")
    assert (got["3"].materias, got["3"].anio) == ("", None)
    assert (got["4"].anio, got["5"].anio, got["6"].anio) == (2020, None, None)


@pytest.mark.parametrize("payload", ["[1, 2]", '"text"', "12", "nope", "", "null", "[{}]", "true"])
def test_rejects(spark, payload):
    df = replies(spark, ("1", payload), ("2", {"rubro": "ok"}))
    assert [r.requested_id for r in landing.rejects(df).collect()] == ["1"]
    assert [r.id_tesis for r in landing.normalized(df).collect()] == ["2"]


def test_page_shapes(spark):
    pages = ["[1, 2]", '{"data": [3], "ids": [4]}', '{"items": ["5"], "data": 9}', '{"otros": [6]}', "7", "nope", "{}"]
    df = spark.createDataFrame([(p,) for p in pages], "payload string")
    assert sorted(r[0] for r in landing.page_ids(df).collect()) == ["1", "2", "3", "5"]


@pytest.mark.parametrize("payload,want", [("12", 12), ('"34"', 34), ('"x"', None), ("null", None), ("-1", None)])
def test_reported_count(spark, criteria, payload, want):
    df = spark.createDataFrame([(payload,)], "payload string")
    corpus = criteria([{"id_tesis": "1"}])
    assert landing.reconcile(df, corpus, corpus).first().reportado == want


def test_status(spark):
    rows = spark.createDataFrame([(0, 0), (3, 0), (3, 2)], "n long, e long")
    got = [r[0] for r in rows.select(landing.run_status(F.col("n"), F.col("e"))).collect()]
    assert got == ["Base de datos ya actualizada (sin tesis nuevas)", "Exito - 3 tesis nuevas descargadas",
                   "Completado con 2 error(es) - 3 nuevas"]


def first(spark):
    return replies(spark, ("1", {"rubro": "uno amparo"}), ("2", {"rubro": "dos"}), ("3", "nope"))


def second(spark):
    return replies(spark, ("2", {"rubro": "dos cambiado"}), ("4", {"rubro": "cuatro"}))


def titles(store):
    return {r.id_tesis: r.rubro for r in store.corpus().collect()}


@pytest.mark.parametrize("mode,two", [(NEW_ONLY, "dos"), (UPSERT, "dos cambiado")])
def test_batches_and_retries(spark, tmp_path, mode, two):
    store = Store(spark, str(tmp_path), mode)
    store.load(first(spark), 1)
    store.load(second(spark), 2)
    want = {"1": "uno amparo", "2": two, "4": "cuatro"}
    assert titles(store) == want
    before = sorted(map(str, store.postings().collect()))
    store.load(second(spark), 2)  # a retried batch changes nothing
    assert titles(store) == want
    assert sorted(map(str, store.postings().collect())) == before
    assert store.rejects().count() == 1
    log = {r.batch: (r.nuevas, r.errores, r.total) for r in store.run_log().collect()}
    assert log == {1: (2, 1, 2), 2: (1, 0, 3)}
    # The versioned postings are those of the current corpus.
    fresh = index.postings(store.corpus())
    assert store.postings().select(fresh.columns).exceptAll(fresh).count() == 0
    assert fresh.exceptAll(store.postings().select(fresh.columns)).count() == 0


def test_stream_equals_batches(spark, tmp_path):
    landed, offsets = str(tmp_path / "landed"), str(tmp_path / "offsets")
    streamed = Store(spark, str(tmp_path / "a"), UPSERT)
    first(spark).write.mode("append").json(landed)
    streamed.follow(landed, offsets).awaitTermination()
    second(spark).write.mode("append").json(landed)
    streamed.follow(landed, offsets).awaitTermination()
    batched = Store(spark, str(tmp_path / "b"), UPSERT)
    batched.load(first(spark), 1)
    batched.load(second(spark), 2)
    assert titles(streamed) == titles(batched) != {}
    compacted = streamed.compact(str(tmp_path / "c"), 2)
    assert {r.id_tesis: r.rubro for r in compacted.corpus.collect()} == titles(batched)


def test_streams_and_batches_share_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), UPSERT)
    store.load(replies(spark, ("1", {"rubro": "uno"}), ("2", {"rubro": "dos"})), 1)
    for n, reply in enumerate((("3", {"rubro": "tres"}), ("4", {"rubro": "cuatro"}), ("2", {"rubro": "dos nuevo"}))):
        landed = str(tmp_path / f"landed{n}")
        replies(spark, reply).write.json(landed)
        for _ in range(2):  # started again, a stream has nothing new
            store.follow(landed, str(tmp_path / f"offsets{n}")).awaitTermination()
    assert titles(store) == {"1": "uno", "2": "dos nuevo", "3": "tres", "4": "cuatro"}
    assert sorted(r.batch for r in store.run_log().collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        store.load(first(spark), 3)
    store.load(replies(spark, ("1", {"rubro": "uno otra vez"})), 1)
    assert titles(store)["1"] == "uno otra vez"
    # A micro-batch that is repeated finds the number it had.
    assert store._number("s", 7) == store._number("s", 7) == 5 and store._number("s", 8) == 6


def test_batches_continue_a_library(spark, tmp_path, criteria):
    """Base and batches together answer like a library built from scratch."""
    from lexspark.plans import search

    rows = [{"id_tesis": str(i), "rubro": f"amparo tema{i % 3}", "texto": f"cuerpo del amparo directo {i}"} for i in range(20)]
    base = Library.save(criteria(rows), str(tmp_path / "base"), 2)
    store = Store(spark, str(tmp_path / "more"), UPSERT, base)
    store.load(replies(spark, ("3", {"rubro": "tema9", "texto": "otra cosa"}), ("n", {"rubro": "amparo nuevo", "texto": ""})), 1)
    store.load(replies(spark, ("4", {"rubro": "amparo amparo"}), ("3", {"rubro": "amparo directo"}), ("x", "[]")), 2)
    assert [(r.nuevas, r.errores, r.total) for r in store.run_log().orderBy("batch").collect()] == [(1, 0, 21), (0, 1, 21)]
    now = store.library()
    scratch = Library.of(store.corpus())
    for name in ("postings", "doc_stats", "term_stats", "corpus_stats"):
        a, b = getattr(now, name), getattr(scratch, name)
        assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect())), name
    for terms in (["amparo directo"], ["tema1", "nuevo"]):
        a, b = (sorted(map(tuple, search.search_concept(x, terms).collect()), key=str) for x in (now, scratch))
        assert a == b != []


def test_new_only_continues_a_library(spark, tmp_path, criteria):
    base = Library.save(criteria([{"id_tesis": "1", "rubro": "uno"}]), str(tmp_path / "base"), 2)
    store = Store(spark, str(tmp_path / "more"), NEW_ONLY, base)
    store.load(replies(spark, ("1", {"rubro": "otro"}), ("2", {"rubro": "dos"})), 1)
    assert titles(store) == {"1": "uno", "2": "dos"}


def test_upsert_and_refresh(spark, criteria):
    corpus = criteria([{"id_tesis": "1", "rubro": "a b"}, {"id_tesis": "2", "rubro": "c"}])
    changed = criteria([{"id_tesis": "2", "rubro": "d e"}, {"id_tesis": "3", "rubro": "f"}])
    after = landing.upsert(corpus, changed)
    assert {(r.id_tesis, r.rubro) for r in after.collect()} == {("1", "a b"), ("2", "d e"), ("3", "f")}
    refreshed = index.refresh_postings(index.postings(corpus), changed)
    assert refreshed.exceptAll(index.postings(after)).count() == 0
    assert {(r.id_tesis, r.desfase) for r in health.drift(after, Library.of(corpus).doc_stats).collect()} == {
        ("2", "cambiado"), ("3", "sin indexar")}


def test_health_reports_failures(spark, criteria):
    sick = criteria([{"id_tesis": "1"}, {"id_tesis": "1"}, {"id_tesis": ""}]).drop("mes").withColumn(
        "json_completo", F.lit(""))
    states = {r.revision: r.estado for r in health.health(Library.of(sick)).collect()}
    assert states["claves"] == states["esquema minimo"] == states["busqueda de prueba"] == "fallo"
    assert states["json_completo"] == "info"
    assert not health.verdict(health.health(Library.of(sick))).first().ok


class Broken(Store):
    """Fails before a table is written."""

    def _add(self, df, table, batch, attempt):
        if table == self.mode_fails:
            raise InterruptedError(table)
        super()._add(df, table, batch, attempt)

    def _commit(self, parts, attempt):
        if self.mode_fails == "commit":
            raise InterruptedError("commit")
        super()._commit(parts, attempt)


def state(store):
    now = store.now()
    return sorted(map(str, now.corpus().collect())), sorted(map(str, now.postings().collect())), sorted(
        map(str, now.counts().collect())), now.rejects().count(), now.run_log().count()


@pytest.mark.parametrize("fails", ["rejects", "corpus", "postings", "counts", "commit"])
def test_a_batch_appears_whole_or_not_at_all(spark, tmp_path, monkeypatch, fails):
    monkeypatch.setattr(Broken, "mode_fails", fails, raising=False)
    store = Store(spark, str(tmp_path), UPSERT)
    store.load(first(spark), 1)
    before = state(store)
    with pytest.raises(InterruptedError):
        Broken(spark, store.root, UPSERT).load(second(spark), 2)
    assert state(store) == before
    with pytest.raises(InterruptedError):  # nor is a batch lost that is loaded again
        Broken(spark, store.root, UPSERT).load(second(spark), 1)
    assert state(store) == before
    store.load(second(spark), 2)
    assert titles(store) == {"1": "uno amparo", "2": "dos cambiado", "4": "cuatro"}
    assert state(store.at(1)) == before
    assert [(r.version, r.batch) for r in store.versions().orderBy("version").collect()] == [(1, 1), (2, 2)]


def test_a_reader_keeps_its_state(spark, tmp_path):
    store = Store(spark, str(tmp_path), UPSERT)
    assert store.corpus().count() == store.counts().count() == 0
    store.load(first(spark), 1)
    held = store.now()
    lib = held.library()
    store.load(second(spark), 1)
    assert titles(store) == {"2": "dos cambiado", "4": "cuatro"}
    assert titles(held) == {"1": "uno amparo", "2": "dos"}
    assert {r.tok for r in lib.postings.collect()} == {"uno", "amparo", "dos"}


def recounted(store):
    return sorted(map(str, profile.kept_counts(store.corpus()).drop("ultima").collect()))


def test_kept_counts_equal_a_recount(spark, tmp_path, criteria):
    rows = [{"id_tesis": str(i), "rubro": "r", "epoca": f"e{i % 2}", "anio": 2000 + i} for i in range(6)]
    base = Library.save(criteria(rows), str(tmp_path / "base"), 2)
    store = Store(spark, str(tmp_path / "more"), UPSERT, base)
    a = replies(spark, ("0", {"epoca": "e1", "anio": 1990}), ("5", {"epoca": "e9"}), ("n", {"anio": 2050}))
    b = replies(spark, ("n", {"anio": 2001, "tipoTesis": "Jurisprudencia"}), ("0", {"epoca": "e2"}))
    for load, batch in ((a, 1), (b, 2), (b, 1), (a, 2), (a, 1)):
        store.load(load, batch)  # also in place of a batch that later ones build upon
        counts = store.counts()
        assert sorted(map(str, counts.drop("ultima").collect())) == recounted(store)
        summary, want = profile.counted_summary(counts).first(), profile.corpus_summary(store.corpus()).first()
        # The last criterion that came may be of a batch that later ones replace.
        assert summary[:3] == want[:3] and summary.ultima_descarga >= want.ultima_descarga
    for kept, fresh in ((profile.counted_facets(counts), profile.facets(store.corpus())),
                        (profile.counted_breakdown(counts), profile.corpus_breakdown(store.corpus()))):
        assert sorted(map(str, kept.collect())) == sorted(map(str, fresh.collect()))
