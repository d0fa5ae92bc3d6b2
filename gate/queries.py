"""Every operator and query as a callable of (spark, sf_dir).

Names match those of the checks. Each reads the given tables, or the library
stored from them, whole.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gate import inputs
from gate.inputs import library
from lexspark.functions import cards, court
from lexspark.functions.text import keywords
from lexspark.operators import filters as flt
from lexspark.operators import index, match, rank, score
from lexspark.operators.filters import Filters
from lexspark.operators.match import Lookups
from lexspark.plans import dossier as dossiers
from lexspark.plans import health as checks
from lexspark.plans import profile, reading, search
from lexspark.plans.similar import similar_batch as similar_to
from lexspark.session import durable
from lexspark.sources import landing
from lexspark.sources.derived import derived_corpus
from lexspark.sources.segments import Segments
from lexspark.streaming.refresh import UPSERT, Store

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}

SYNONYMS = ["mente", "constitucional civil", "nicht"]
CONCEPT_A, CONCEPT_B, CONCEPT_C = ["mente", "nicht"], ["the that", "la"], ["de", "die"]
EPOCHS = ["decima", "11"]


def query(run: Query) -> Query:
    REGISTERED[run.__name__] = run
    return run


def _titled(lib, ranking: DataFrame) -> DataFrame:
    """Ranked rows with title, year and organ."""
    rows = search.attach(durable(ranking), lib.corpus, ["rubro", "anio", "organo_juris"])
    return rows.drop("query_id")


def _hits(lib, concepts, scope="todo", near=None) -> DataFrame:
    spark = lib.corpus.sparkSession
    table_ = search.query_table(
        spark, [{"concepts": concepts, "buscar_en": scope, "distancia": near}])
    lookups = Lookups.of(table_, lib.term_stats)
    return match.matching_hits(match.hits(lib.postings, lookups), lookups)


def _ids(found: DataFrame) -> DataFrame:
    return match.matches(found).select("id_tesis")


# -- sources, ingest, sinks -------------------------------------------------

@query
def corpus_scan(spark, sf):
    return library(spark, sf).corpus.select(
        "id_tesis", "rubro", "epoca", "instancia", "organo_juris", "fuente", "tipo_tesis", "anio",
        "mes", "materias", "tesis_codigo", "huella_digital", F.md5("texto").alias("texto_md5"),
        "precedentes",
        F.date_format("fecha_descarga", "yyyy-MM-dd HH:mm:ss").alias("fecha_descarga"),
    )


@query
def ingest_normalize(spark, sf):
    return landing.normalized(inputs.replies(spark, sf)).select(
        "id_tesis", "rubro", "epoca", "instancia", "organo_juris", "fuente", "tipo_tesis", "anio",
        "mes", "materias", "tesis_codigo", "huella_digital", F.md5("texto").alias("texto_md5"),
        "precedentes",
    )


@query
def ingest_ids(spark, sf):
    return landing.page_ids(inputs.id_pages(spark, sf))


@query
def ingest_new_ids(spark, sf):
    asked = inputs.replies(spark, sf).select(F.col("requested_id").alias("id_tesis"))
    return landing.new_ids(asked, library(spark, sf).corpus)


def _upserted(spark, sf) -> DataFrame:
    return landing.upsert(library(spark, sf).corpus, landing.normalized(inputs.replies(spark, sf)))


@query
def ingest_upsert(spark, sf):
    return _upserted(spark, sf).select(
        "id_tesis", "rubro", "anio", "materias", "tipo_tesis", F.md5("texto").alias("texto_md5"))


@query
def ingest_rejects(spark, sf):
    return landing.rejects(inputs.replies(spark, sf))


@query
def ingest_run_log(spark, sf):
    return landing.run_log(inputs.replies(spark, sf), library(spark, sf).corpus)


@query
def ingest_reconcile(spark, sf):
    reported = (
        inputs.replies(spark, sf).agg(F.count("*").alias("n"))
        .select(F.to_json(F.array(F.col("n").cast("string"))).alias("payload"))
        .select(F.regexp_replace("payload", r"[\[\]]", "").alias("payload"))
    )
    return landing.reconcile(reported, library(spark, sf).corpus, _upserted(spark, sf))


def _store(spark, sf, name, mode=UPSERT) -> Store:
    return Store(spark, inputs.folder(spark, sf, name), mode)


def _loaded(store: Store) -> DataFrame:
    return store.corpus().select("id_tesis", "rubro", "anio", F.md5("texto").alias("texto_md5"))


@query
def ingest_incremental(spark, sf):
    store = _store(spark, sf, "incremental")
    store.load(inputs.added(spark, sf), 1)
    store.load(inputs.revised(spark, sf), 2)
    store.load(inputs.replies(spark, sf), 3)
    return _loaded(store)


@query
def ingest_stream(spark, sf):
    store = _store(spark, sf, "stream", "new_only")
    landed = inputs.folder(spark, sf, "landed")
    inputs.replies(spark, sf).write.mode("overwrite").json(landed)
    store.follow(landed, inputs.folder(spark, sf, "offsets")).awaitTermination()
    return _loaded(store)


@query
def ingest_streams(spark, sf):
    """A batch, then two streams with checkpoint folders of their own: all ids stay."""
    store = _store(spark, sf, "streams")
    store.load(inputs.malformed(spark, sf).unionByName(inputs.added(spark, sf)), 1)
    for n, replies in enumerate((inputs.revised(spark, sf), inputs.added(spark, sf))):
        landed = inputs.folder(spark, sf, f"landed{n}")
        replies.write.mode("overwrite").json(landed)
        store.follow(landed, inputs.folder(spark, sf, f"offsets{n}")).awaitTermination()
    return _loaded(store)


class _Interrupted(Store):
    """A store whose loads end before the postings are written."""

    def _add(self, df, table, batch, attempt):
        if table == "postings":
            raise InterruptedError(table)
        super()._add(df, table, batch, attempt)


def _broken_off(spark, sf, name) -> Store:
    """All new criteria loaded, and a load of revised ones that ended half-way."""
    store = _store(spark, sf, name)
    store.load(inputs.added(spark, sf), 1)
    try:
        _Interrupted(spark, store.root, store.mode).load(inputs.replies(spark, sf), 2)
    except InterruptedError:
        pass
    return store


def _indexed(store: Store) -> DataFrame:
    """Each criterion of a store with the number of its tokens in the index."""
    store = store.now()
    lengths = store.postings().groupBy("id_tesis").agg(F.sum(F.size("pos")).alias("tokens"))
    return _loaded(store).join(lengths, "id_tesis", "left")


@query
def ingest_interrupted(spark, sf):
    """What a reader sees after a load that broke off: the state before it."""
    return _indexed(_broken_off(spark, sf, "interrupted"))


@query
def ingest_retried(spark, sf):
    """The same load again: all of it, once."""
    store = _broken_off(spark, sf, "retried")
    store.load(inputs.replies(spark, sf), 2)
    return _indexed(store)


@query
def ingest_version(spark, sf):
    """The state at the first of two commits."""
    store = _store(spark, sf, "versions")
    store.load(inputs.added(spark, sf), 1)
    store.load(inputs.replies(spark, sf), 2)
    return _indexed(store.at(1))


def _counted(spark, sf) -> DataFrame:
    """Counts kept by batches that continue the library: new criteria, then replaced ones."""
    store = Store(spark, inputs.folder(spark, sf, "counted"), UPSERT, library(spark, sf))
    store.load(inputs.added(spark, sf), 1)
    store.load(inputs.replies(spark, sf), 2)
    return store.counts()


@query
def kept_facets(spark, sf):
    return profile.counted_facets(_counted(spark, sf))


@query
def kept_breakdown(spark, sf):
    return profile.counted_breakdown(_counted(spark, sf))


@query
def kept_summary(spark, sf):
    return profile.counted_summary(_counted(spark, sf)).drop("ultima_descarga")


@query
def corpus_layout(spark, sf):
    stored = library(spark, sf).corpus
    return stored.groupBy("epoca_part", "epoca").agg(
        F.count("*").alias("total"), F.min("anio").alias("anio_min"), F.max("anio").alias("anio_max"))


@query
def column_weights(spark, sf):
    return profile.column_weights(library(spark, sf).corpus.drop("epoca_part"))


# -- text index -------------------------------------------------------------

@query
def tokenize(spark, sf):
    docs = index.tokenized(derived_corpus(spark, sf))
    digests = [F.md5(F.array_join(c, " ")).alias(f"{c}_md5") for c in index.INDEXED]
    return docs.select("id_tesis", "dl", *digests)


@query
def postings_build(spark, sf):
    posts = index.postings(derived_corpus(spark, sf))
    return posts.groupBy("tok").agg(
        F.countDistinct("id_tesis").alias("documentos"),
        F.sum(F.size("pos")).alias("veces"),
        F.sum(F.aggregate("pos", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("posiciones"),
    )


@query
def doc_stats(spark, sf):
    return library(spark, sf).doc_stats.select("id_tesis", "dl")


@query
def term_stats(spark, sf):
    return library(spark, sf).term_stats


def _refreshed(spark, sf) -> Segments:
    """The index in segments after the landed criteria came in, as deltas on its base."""
    base = inputs.segments(spark, sf)
    return base.at(base.refresh(landing.normalized(inputs.replies(spark, sf))))


def _per_document(posts: DataFrame) -> DataFrame:
    return posts.groupBy("id_tesis").agg(
        F.sum(F.size("pos")).alias("veces"), F.countDistinct("tok").alias("distintos"))


@query
def postings_refresh(spark, sf):
    return _per_document(_refreshed(spark, sf).postings())


@query
def postings_removed(spark, sf):
    """Every labelled criterion leaves the index again, then the heavy buckets are folded."""
    lib, root = library(spark, sf), inputs.folder(spark, sf, "removed")
    index_ = Segments.create(lib.corpus, root, inputs.SEGMENT_BUCKETS, lib.postings)
    labelled = inputs.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id_tesis"))
    index_.refresh(lib.corpus.limit(0), labelled)
    index_.fold()
    return _per_document(index_.postings())


@query
def refreshed_terms(spark, sf):
    """Term statistics after a refresh, corrected by what went and what came."""
    return _refreshed(spark, sf).term_stats()


@query
def refresh_segments(spark, sf):
    """What a refresh added to each bucket, and what the bucket holds now."""
    refreshed = _refreshed(spark, sf)
    return refreshed.segments().where(F.col("version") == refreshed.version).select(
        "bucket", "listed", "docs", "tokens")


@query
def query_terms(spark, sf):
    terms = match.query_terms(search.completed(inputs.passages(spark, sf)))
    return terms.groupBy("query_id", "tok").agg(
        F.count("*").alias("veces"), F.max("plen").alias("plen"), F.sum("off").alias("off"))


# -- matching ---------------------------------------------------------------

@query
def match_term(spark, sf):
    return _hits(library(spark, sf), [["mente"]]).select(
        "id_tesis", "col", F.size("starts").alias("veces"))


@query
def match_phrase(spark, sf):
    return _hits(library(spark, sf), [["the that"]]).select(
        "id_tesis", "col", F.explode("starts").alias("inicio"))


@query
def match_or(spark, sf):
    return _ids(_hits(library(spark, sf), [SYNONYMS]))


@query
def match_and(spark, sf):
    return _ids(_hits(library(spark, sf), [CONCEPT_A, CONCEPT_B]))


@query
def match_and_many(spark, sf):
    """Seventy concepts, each of which most documents hold by one of two words."""
    concepts = [["the", "de"] if n % 2 else ["the", "de", "und"] for n in range(70)]
    return _ids(_hits(library(spark, sf), concepts))


@query
def match_near(spark, sf):
    return _hits(library(spark, sf), [["the that"], ["and"]], near=3).select(
        "id_tesis", "col", "concept", F.explode("starts").alias("inicio"))


@query
def match_rubro(spark, sf):
    return _ids(_hits(library(spark, sf), [["mente", "the that"]], "rubro"))


@query
def match_texto(spark, sf):
    return _ids(_hits(library(spark, sf), [["mente", "contradiccion de tesis"]], "texto"))


@query
def match_bag(spark, sf):
    words = ["mente", "nicht", "aning", "the", "or", "the"]
    return _ids(_hits(library(spark, sf), [words]))


@query
def scan_or(spark, sf):
    return search.scanned(library(spark, sf), [["ción de", "nicht"]]).select("id_tesis")


@query
def scan_and(spark, sf):
    return search.scanned(library(spark, sf), [["mente", "nicht"], ["die", "la "]]).select("id_tesis")


@query
def scan_contradiction(spark, sf):
    return library(spark, sf).corpus.filter(match.mentions_contradiction()).select("id_tesis")


# -- filters ----------------------------------------------------------------

def _filtered(name: str, column: str, f: Filters) -> None:
    def run(spark, sf):
        return flt.apply_filters(library(spark, sf).corpus, f).select("id_tesis", column)

    REGISTERED[name] = run


_filtered("filter_binding", "tipo_tesis", Filters(solo_jurisprudencia=True))
_filtered("filter_subject", "materias", Filters(materia="COMUN"))
_filtered("filter_organ", "organo_juris", Filters(organo="Decimo septimo"))
_filtered("filter_years", "anio", Filters(anio_minimo=2003, anio_maximo=2012))
_filtered("filter_epochs", "epoca", Filters(epocas=("Décima Época", "11", "xyz")))
_filtered("filter_circuit", "organo_juris", Filters(circuito=17))
for _preset in court.PRESETS:
    _filtered(f"filter_preset_{_preset}", "organo_juris", Filters(instancia=_preset))


@query
def read_one(spark, sf):
    return reading.read(library(spark, sf), "77")


@query
def read_by_code(spark, sf):
    return reading.read(library(spark, sf), "7/2", "tesis_codigo")


@query
def read_by_title(spark, sf):
    return reading.read(library(spark, sf), "ÇAI", "rubro")


@query
def read_many_by_code(spark, sf):
    keys = [f"T. {n}/{1995 + n % 31}" for n in range(5, 200, 14)]
    return reading.read_many(library(spark, sf), keys, "tesis_codigo")


@query
def read_keys(spark, sf):
    labelled = inputs.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id_tesis"))
    return reading.read_keys(library(spark, sf), labelled).select("id_tesis", "rubro", F.md5("texto").alias("texto_md5"))


@query
def cite_by_code(spark, sf):
    return reading.cite(library(spark, sf), "T. 77/2010", "tesis_codigo").select("id_tesis", "cita", "rubro")


@query
def read_many(spark, sf):
    keys = [str(n) for n in range(3, 198, 13)]
    return reading.read_many(library(spark, sf), keys)


# -- scalar functions -------------------------------------------------------

@query
def binding_level(spark, sf):
    level = court.binding_level(F.col("tipo_tesis"), F.col("instancia"), F.col("organo_juris"))
    return library(spark, sf).corpus.select("id_tesis", level.alias("nivel"))


@query
def binding_bucket(spark, sf):
    return library(spark, sf).corpus.select(
        "id_tesis",
        F.when(court.is_binding(F.col("tipo_tesis")), 0).otherwise(1).alias("aislada"),
        court.binding_bucket(F.col("instancia"), F.col("organo_juris")).alias("cubo"))


@query
def normalize_epoch(spark, sf):
    corpus = library(spark, sf).corpus
    spelled = F.array(
        F.upper("epoca"), F.substring_index("epoca", " ", 1),
        (F.col("anio") - 1994).cast("string"), F.col("materias"))
    return corpus.select("id_tesis", F.posexplode(spelled).alias("n", "escrita")).select(
        "id_tesis", "n", court.normalize_epoch(F.col("escrita")).alias("epoca"))


@query
def parse_circuit(spark, sf):
    corpus = library(spark, sf).corpus
    return corpus.select(
        "id_tesis",
        court.parse_circuit((F.col("anio") - 1990).cast("string")).alias("de_numero"),
        court.parse_circuit(F.regexp_extract("organo_juris", r"del (.*) Circuito", 1)).alias("de_ordinal"),
        court.circuit_of_court(F.col("organo_juris")).alias("de_organo"))


@query
def cite(spark, sf):
    return reading.citations(library(spark, sf).corpus).select("id_tesis", "cita", F.md5("ficha").alias("ficha"))


@query
def extract(spark, sf):
    return library(spark, sf).corpus.select(
        "id_tesis", cards.extract(F.col("texto")).alias("extracto"),
        F.md5(cards.cut(F.col("texto"), cards.FULL_TEXT)).alias("texto_md5"),
        F.length(cards.cut(F.col("texto"), cards.FULL_TEXT)).alias("largo"))


@query
def snippet(spark, sf):
    found = search.search_concept(library(spark, sf), SYNONYMS + ["the that"], limite=100)
    return found.select("rank", "id_tesis", "fragmento")


@query
def title_keywords(spark, sf):
    return library(spark, sf).corpus.select(
        "id_tesis", F.array_join(keywords(F.col("rubro")), " ").alias("palabras"))


@query
def render(spark, sf):
    found = search.search_concept(library(spark, sf), SYNONYMS, limite=40)
    return found.select("rank", cards.render(full=False).alias("ficha"))


@query
def render_full(spark, sf):
    read = reading.read(library(spark, sf), "T. 1", "tesis_codigo")
    return read.select("rank", cards.render(full=True).alias("ficha"))


# -- aggregates, scores, orders ---------------------------------------------

def _scored(lib, concepts, scope="todo", near=None) -> DataFrame:
    table_ = search.query_table(
        lib.corpus.sparkSession, [{"concepts": concepts, "buscar_en": scope, "distancia": near}])
    return score.scored(lib, Lookups.of(table_, lib.term_stats)).select(
        "id_tesis", score.as_bm25(F.col("units")).alias("bm25"))


@query
def bm25(spark, sf):
    return _scored(library(spark, sf), [SYNONYMS + ["the"]])


@query
def bm25_title(spark, sf):
    return _scored(library(spark, sf), [["mente", "the that"]], "rubro")


@query
def bm25_near(spark, sf):
    return _scored(library(spark, sf), [["the that"], ["and"]], near=3)


for _campo in profile.FACETS:
    def _run(spark, sf, campo=_campo):
        return profile.facet(library(spark, sf).corpus, campo)

    REGISTERED[f"facet_{_campo}"] = _run


@query
def facet_all(spark, sf):
    return profile.facets(library(spark, sf).corpus)


@query
def corpus_summary(spark, sf):
    summary = profile.corpus_summary(library(spark, sf).corpus)
    return summary.withColumn(
        "ultima_descarga", F.date_format("ultima_descarga", "yyyy-MM-dd HH:mm:ss"))


@query
def describe_last_load(spark, sf):
    """The run log's last row, as the description of the corpus shows it."""
    store = _store(spark, sf, "described")
    store.load(inputs.added(spark, sf), 1)
    store.load(inputs.replies(spark, sf), 2)
    last = profile.describe_corpus(library(spark, sf), store.run_log())["ultima_actualizacion"]
    return last.select("nuevas", "errores", "total", "estado")


@query
def corpus_breakdown(spark, sf):
    return profile.corpus_breakdown(library(spark, sf).corpus)


@query
def result_summary(spark, sf):
    return profile.result_summary(search.search_batch(library(spark, sf), inputs.passages(spark, sf)))


def _ordered(spark, sf, order: str, lib=None) -> DataFrame:
    lib = lib or library(spark, sf)
    return _titled(lib, search.search_concept(lib, SYNONYMS, orden=order, limite=100, texts=False))


@query
def order_binding(spark, sf):
    return _ordered(spark, sf, rank.BY_FORCE)


@query
def order_relevance(spark, sf):
    return _ordered(spark, sf, rank.BY_SCORE)


@query
def order_relevance_bounded(spark, sf):
    return _ordered(spark, sf, rank.BY_SCORE, inputs.bounded(spark, sf))


@query
def order_recent(spark, sf):
    return _ordered(spark, sf, rank.BY_DATE)


@query
def topk_per_query(spark, sf):
    return search.search_batch(library(spark, sf), inputs.word_queries(spark, sf))


@query
def topk_bounded(spark, sf):
    return search.search_batch(inputs.bounded(spark, sf), inputs.word_queries(spark, sf))


@query
def result_diff(spark, sf):
    lib = library(spark, sf)
    before = search.search_concept(lib, SYNONYMS, limite=50, texts=False)
    after = search.search_concept(lib, SYNONYMS, limite=50, orden=rank.BY_SCORE, texts=False)
    return profile.result_diff(before.select("id_tesis", "nivel"), after.select("id_tesis", "nivel"))


# -- composite queries ------------------------------------------------------

@query
def search_concept(spark, sf):
    return search.search_concept(
        library(spark, sf), SYNONYMS, materia="civil", anio_minimo=2000, limite=50).drop("query_id")


@query
def search_concept_scan(spark, sf):
    found = search.search_concept(
        library(spark, sf), ["mente", "nicht"], solo_jurisprudencia=True, mode="scan", limite=50)
    return found.select("rank", "id_tesis", "nivel", "rubro", "extracto")


def _scanned(found: DataFrame) -> DataFrame:
    return found.select("rank", "id_tesis", "nivel", "rubro")


@query
def search_title_scan(spark, sf):
    return _scanned(search.search_title(library(spark, sf), ["mente", "the that"], mode="scan", limite=50))


@query
def search_intersection_scan(spark, sf):
    return _scanned(search.search_intersection(
        library(spark, sf), CONCEPT_A, CONCEPT_B, anio_minimo=2001, mode="scan", limite=50))


@query
def search_contradiction_scan(spark, sf):
    return _scanned(search.search_contradiction(library(spark, sf), ["la", "the"], mode="scan", limite=60))


@query
def search_circuit_scan(spark, sf):
    return _scanned(search.search_circuit(library(spark, sf), 17, ["mente", "the", "la"], mode="scan", limite=100))


@query
def timeline_scan(spark, sf):
    return search.timeline(library(spark, sf), ["mente", "the"], limite=80, mode="scan").drop("query_id")


@query
def search_intersection(spark, sf):
    lib = library(spark, sf)
    return _titled(lib, search.search_intersection(
        lib, CONCEPT_A, CONCEPT_B, epocas=EPOCHS, limite=50, texts=False))


@query
def search_intersection3(spark, sf):
    lib = library(spark, sf)
    return _titled(lib, search.search_intersection(
        lib, CONCEPT_A, CONCEPT_B, CONCEPT_C, orden=rank.BY_SCORE, limite=50, texts=False))


@query
def search_near(spark, sf):
    found = search.search_near(library(spark, sf), "the that", "and", 3, instancia="scjn", limite=50)
    return found.select("rank", "id_tesis", "nivel", "bm25", "rubro", "fragmento")


@query
def search_title(spark, sf):
    found = search.search_title(library(spark, sf), ["mente", "the that"], limite=50)
    return found.select("rank", "id_tesis", "nivel", "bm25", "rubro", "fragmento")


@query
def search_contradiction(spark, sf):
    lib = library(spark, sf)
    return _titled(lib, search.search_contradiction(lib, ["la", "the"], anio_minimo=2001, limite=60, texts=False))


@query
def search_similar(spark, sf):
    lib = library(spark, sf)
    return _titled(lib, search.search_similar(lib, "138", limite=40, texts=False))


@query
def search_similar_bounded(spark, sf):
    lib = inputs.bounded(spark, sf)
    return _titled(lib, search.search_similar(lib, "138", limite=40, texts=False))


@query
def search_circuit(spark, sf):
    lib = library(spark, sf)
    return _titled(lib, search.search_circuit(lib, "décimo séptimo", ["mente", "the", "la"], limite=100, texts=False))


@query
def timeline(spark, sf):
    return search.timeline(library(spark, sf), ["mente", "the"], limite=80).drop("query_id")


@query
def search_batch(spark, sf):
    return search.search_batch(library(spark, sf), inputs.passages(spark, sf))


@query
def dossier(spark, sf):
    return dossiers.dossier(library(spark, sf), durable(inputs.cases(spark, sf)))


@query
def dossier_read(spark, sf):
    lib = library(spark, sf)
    found = durable(dossiers.dossier(lib, durable(inputs.cases(spark, sf))))
    return dossiers.read_marked(lib, found).select(
        "case_id", "lugar", "id_tesis", "nivel", "rondas", "rubro", F.md5("texto").alias("texto_md5"),
        F.md5("precedentes").alias("precedentes_md5"))


@query
def expand_subjects(spark, sf):
    return dossiers.expand_subjects(library(spark, sf).corpus, list(dossiers.RELATED))


@query
def similar_batch(spark, sf):
    labelled = inputs.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id_tesis"))
    return similar_to(library(spark, sf), labelled)


# -- health -----------------------------------------------------------------

@query
def health(spark, sf):
    return checks.health(library(spark, sf), "mente")


@query
def health_verdict(spark, sf):
    return checks.verdict(checks.health(library(spark, sf), "mente")).select("ok", "fallos")


@query
def health_drift(spark, sf):
    return checks.segment_drift(_upserted(spark, sf), inputs.segments(spark, sf).at(1))


@query
def health_keys(spark, sf):
    replies = inputs.replies(spark, sf)
    stored = library(spark, sf).corpus.select("id_tesis")
    return checks.key_problems(stored.unionByName(landing.normalized(replies).select("id_tesis")))
