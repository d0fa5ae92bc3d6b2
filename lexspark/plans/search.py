"""Searches: one query or a table of queries against a library.

Every search is a row of the query table. `ranked` turns the table into
(query_id, rank, id_tesis, nivel, bm25); the texts of the few ranked criteria
are fetched afterwards, so bodies are never read for documents that only match.
"""

from __future__ import annotations

import re
from dataclasses import asdict
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.functions import court
from lexspark.functions.cards import NO_EPOCH, TIMELINE_TITLE, extract
from lexspark.functions.text import keywords
from lexspark.operators import filters as flt
from lexspark.operators import bounds, match, rank, score, together
from lexspark.operators.filters import Filters
from lexspark.operators.match import Lookups
from lexspark.operators.snippet import snippets
from lexspark.session import durable, local_table, small_rows
from lexspark.sources.schema import QUERY
from lexspark.sources.tables import Library, containing, rows_of

SCOPES = ("todo", "rubro", "texto")
DEFAULTS = {
    "buscar_en": "todo", "distancia": None, "solo_jurisprudencia": False, "materia": "",
    "instancia": "", "organo": "", "anio_minimo": 0, "anio_maximo": 0, "epocas": [],
    "circuito": None, "excluir": None, "orden": rank.BY_FORCE, "limite": 25,
}
# Characters of the query language; they never reach it, a term is one phrase.
OPERATORS = re.compile(r'["*()+^{}\[\]~:]')
LISTED = (
    "rubro", "tipo_tesis", "instancia", "organo_juris", "epoca", "anio", "materias",
    "tesis_codigo", "fuente",
)
CONTRADICTION = list(match.CONTRADICTION)
# Documents up to which the metadata of all matches is fetched by id.
FEW_DOCUMENTS = 2000


# -- query tables -----------------------------------------------------------

def query_table(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """Query table from dicts; `concepts` is a list of lists of synonyms."""
    full = [{"query_id": str(n), **DEFAULTS, **row} for n, row in enumerate(rows)]
    return local_table(spark, [[r[f] for f in QUERY.names] for r in full], QUERY)


def completed(queries: DataFrame) -> DataFrame:
    """A query table with every column of QUERY; missing ones and NULLs take the default."""
    columns = []
    for f in QUERY:
        value = F.lit(DEFAULTS.get(f.name)) if f.name != "epocas" else F.array()
        value = value.cast(f.dataType)
        if f.name in queries.columns:
            value = F.coalesce(F.col(f.name).cast(f.dataType), value)
        columns.append(value.alias(f.name))
    return checked(queries.select(*columns))


def checked(queries: DataFrame) -> DataFrame:
    """Limits from 1, distances within 1 to 100 between exactly two concepts. A limit
    above the maximum or another number of concepts fails the job."""
    limit, two = F.col("limite"), F.size("concepts") == 2
    too_many = F.concat(F.lit("limite above the maximum: "), limit.cast("string"))
    near = F.least(F.greatest("distancia", F.lit(1)), F.lit(rank.MAX_RESULTS))
    return queries.withColumns({
        "limite": F.when(limit > rank.MAX_RESULTS, F.raise_error(too_many).cast("int")).otherwise(F.greatest(limit, F.lit(1))),
        "distancia": F.when(F.col("distancia").isNull(), F.lit(None).cast("int")).when(two, near)
        .otherwise(F.raise_error(F.lit("distancia: give exactly two concepts")).cast("int")),
    })


def usable(terms: Sequence[str], name: str) -> list[str]:
    """Terms with something left besides operators and blanks; none is an error."""
    if isinstance(terms, str):
        raise ValueError(f"{name}: give a list of terms")
    kept = [t for t in terms or [] if t and OPERATORS.sub(" ", t).strip()]
    if not kept:
        raise ValueError(f"{name}: give at least one term")
    return kept


# -- ranking ----------------------------------------------------------------

_RANKING = ("id_tesis", "tipo_tesis", "instancia", "organo_juris", "anio")


def _listed(rows: DataFrame, order: Column, limit: Column) -> DataFrame:
    level = court.binding_level(F.col("tipo_tesis"), F.col("instancia"), F.col("organo_juris"))
    return rank.top_k(rows, order, limit).select(
        "query_id", "rank", "id_tesis", level.alias("nivel"),
        score.as_bm25(F.col("units")).alias("bm25"),
    )


def ranked_one(lib: Library, lookups: Lookups, f: Filters, order: str, limit: int) -> DataFrame:
    """Rank the documents of a single query, its filters pushed to the corpus scan."""
    corpus = flt.apply_filters(lib.corpus, f)
    if order in rank.SCORED and bounds.usable(lib, lookups):
        def admitted(scored: DataFrame) -> DataFrame:
            scored = durable(scored)
            return scored.join(rows_of(corpus, scored).select(*_RANKING), "id_tesis")

        best = bounds.scored(lib, lookups, admitted, F.lit(limit))
        return _listed(admitted(best), F.lit(order), F.lit(limit))
    scored = score.scored(lib, lookups)
    if lookups.most is not None and lookups.most <= FEW_DOCUMENTS:
        # Few documents can match: fetch just their metadata by id.
        scored = durable(scored)
        rows = F.broadcast(scored).join(rows_of(corpus, scored).select(*_RANKING), "id_tesis")
    else:
        # Both sides lie in the same buckets; a sort-merge join may spill.
        rows = scored.join(corpus.select(*_RANKING), "id_tesis")
    return _listed(rows, F.lit(order), F.lit(limit))


def ranked_batch(lib: Library, queries: DataFrame, lookups: Lookups) -> DataFrame:
    """Rank every query of a completed table; filters, order and limit are per query."""
    admitted = _admitted(lib, queries)
    if bounds.usable(lib, lookups) and not queries.filter(~F.col("orden").isin(*rank.SCORED)).head(1):
        scored = bounds.scored(lib, lookups, admitted, F.col("limite"))
    elif (kinds := together.filter_kinds(queries, lookups)) is not None:
        best = together.ranked_rows(lib, queries, kinds, list(_RANKING))
        return _listed(best, F.col("orden"), F.col("limite"))
    else:
        scored = score.scored(lib, lookups)
    return _listed(admitted(scored), F.col("orden"), F.col("limite"))


def _admitted(lib: Library, queries: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Joins scored rows with their query and criterion and applies the query's filters."""
    asked = flt.checked_filters(queries).select(
        "query_id", "orden", "limite",
        F.struct(*[F.col(name) for name in asdict(Filters())]).alias("q"),
    )
    needed = [*_RANKING, "materias", "epoca"]
    meta = lib.corpus.select("id_tesis", F.struct(*needed).alias("c"))
    few = small_rows(queries.select("query_id")) is not None

    def admitted(scored: DataFrame) -> DataFrame:
        # Few queries are broadcast; a large table is joined with its hot queries
        # dealt out by document.
        if few:
            rows = scored.join(F.broadcast(asked), "query_id")
        else:
            rows = match.salted_join(scored, asked, ["query_id"], "id_tesis")
        return (
            rows.join(meta, "id_tesis")
            .filter(flt.query_condition("q", "c"))
            .select("query_id", "units", "orden", "limite", "c.*")
        )

    return admitted


def scanned(lib: Library, concepts: list[list[str]], scope: str = "todo") -> DataFrame:
    """Criteria that hold a term of every concept as a substring. With an index of pieces
    only the criteria that it proposes are read and tested."""
    terms = [[term.strip() for term in concept] for concept in concepts]
    return containing(lib, terms, match.SCANNED[scope]).filter(match.scan_condition(concepts, scope))


def ranked_scan(lib: Library, concepts: list[list[str]], scope: str, f: Filters, order: str,
                limit: int, extra: Column | None = None) -> DataFrame:
    """The same without the index: substring tests in one pass over the corpus."""
    rows = flt.apply_filters(scanned(lib, concepts, scope), f)
    if extra is not None:
        rows = rows.filter(extra)
    if order in (rank.BY_SCORE, rank.BY_SIMILARITY):
        order = rank.BY_FORCE
    # Without a score, the year follows the binding force directly.
    rows = rows.select(
        F.lit("0").alias("query_id"), *_RANKING, F.lit(0).cast("bigint").alias("units")
    )
    return _listed(rows, F.lit(order), F.lit(limit)).withColumn(
        "bm25", F.lit(None).cast("double")
    )


# -- texts of ranked criteria -----------------------------------------------

def attach(result: DataFrame, corpus: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Corpus columns of the ranked criteria. `result` must be cheap to read again."""
    return result.join(rows_of(corpus, result).select("id_tesis", *columns), "id_tesis")


def presented(lib: Library, ranking: DataFrame, lookups: Lookups | None) -> DataFrame:
    """Result rows as a reader sees them: metadata, extract and marked fragment."""
    ranking = durable(ranking)
    rows = attach(ranking, lib.corpus, [*LISTED, "texto"])
    fragment = F.lit(None).cast("string").alias("fragmento")
    if lookups is not None:
        found = match.matching_hits(match.hits(rows_of(lib.postings, ranking), lookups), lookups)
        # Hits of other queries on the same documents fall out here.
        found = found.join(ranking.select("query_id", "id_tesis"), ["query_id", "id_tesis"], "left_semi")
        marked = snippets(rows.select("query_id", "id_tesis", "texto"), durable(found))
        rows = rows.join(marked, ["query_id", "id_tesis"], "left")
        fragment = F.col("fragmento")
    return rows.select(
        "query_id", "rank", "id_tesis", "nivel", "bm25", *LISTED,
        fragment, extract(F.col("texto")).alias("extracto"),
    )


# -- the searches -----------------------------------------------------------

def _run(lib: Library, concepts: list[list[str]], f: Filters, *, order: str = rank.BY_FORCE,
         limit: int = 25, cap: int = rank.MAX_RESULTS, scope: str = "todo",
         near: int | None = None, mode: str = "index", scan_extra: Column | None = None,
         scan_concepts: list[list[str]] | None = None, texts: bool = True) -> DataFrame:
    if mode not in ("index", "scan"):
        raise ValueError("mode: index or scan")
    limit = rank.checked_limit(limit, cap)
    if mode == "scan" and near is not None:
        raise ValueError("mode: a scan knows no distances")
    if mode == "scan":
        ranking = ranked_scan(lib, scan_concepts or concepts, scope, f, order, limit, scan_extra)
        return presented(lib, ranking, None) if texts else ranking
    query = query_table(
        lib.corpus.sparkSession,
        [{"concepts": concepts, "buscar_en": scope, "distancia": near}],
    )
    lookups = Lookups.of(query, lib.term_stats)
    ranking = ranked_one(lib, lookups, f, order, limit)
    return presented(lib, ranking, lookups) if texts else ranking


def _order(name: str) -> str:
    return (name or rank.BY_FORCE).strip().lower()


def search_concept(lib: Library, terminos: Sequence[str], solo_jurisprudencia: bool = False,
                   materia: str = "", instancia: str = "", organo: str = "", anio_minimo: int = 0,
                   anio_maximo: int = 0, epocas: Sequence[str] = (), buscar_en: str = "todo",
                   orden: str = rank.BY_FORCE, limite: int = 25, **how) -> DataFrame:
    """Any of several synonyms, as whole phrases."""
    f = Filters(solo_jurisprudencia, materia, instancia, organo, anio_minimo, anio_maximo,
                tuple(epocas or ()))
    scope = buscar_en if buscar_en in SCOPES else "todo"
    return _run(lib, [usable(terminos, "terminos")], f, order=_order(orden), limit=limite,
                scope=scope, **how)


def search_title(lib: Library, terminos: Sequence[str], solo_jurisprudencia: bool = False,
                 materia: str = "", instancia: str = "", anio_minimo: int = 0, limite: int = 25,
                 **how) -> DataFrame:
    """The same, in titles only."""
    return search_concept(lib, terminos, solo_jurisprudencia, materia, instancia,
                          anio_minimo=anio_minimo, buscar_en="rubro", limite=limite, **how)


def search_intersection(lib: Library, concepto_a: Sequence[str], concepto_b: Sequence[str],
                        concepto_c: Sequence[str] | None = None, solo_jurisprudencia: bool = False,
                        materia: str = "", instancia: str = "", organo: str = "",
                        anio_minimo: int = 0, anio_maximo: int = 0, epocas: Sequence[str] = (),
                        orden: str = rank.BY_FORCE, limite: int = 25, **how) -> DataFrame:
    """Two or three concepts together, each by any of its synonyms."""
    concepts = [usable(concepto_a, "concepto_a"), usable(concepto_b, "concepto_b")]
    if concepto_c:
        concepts.append(usable(concepto_c, "concepto_c"))
    f = Filters(solo_jurisprudencia, materia, instancia, organo, anio_minimo, anio_maximo,
                tuple(epocas or ()))
    return _run(lib, concepts, f, order=_order(orden), limit=limite, **how)


def search_near(lib: Library, termino_a: str, termino_b: str, distancia: int = 15,
                solo_jurisprudencia: bool = False, materia: str = "", instancia: str = "",
                anio_minimo: int = 0, limite: int = 25, **how) -> DataFrame:
    """Two phrases within a number of tokens, in one column, in either order."""
    concepts = [usable([termino_a], "termino_a"), usable([termino_b], "termino_b")]
    f = Filters(solo_jurisprudencia, materia, instancia, anio_minimo=anio_minimo)
    return _run(lib, concepts, f, limit=limite, near=rank.clamp(distancia), **how)


def search_contradiction(lib: Library, terminos: Sequence[str], instancia: str = "",
                         anio_minimo: int = 0, limite: int = 20, **how) -> DataFrame:
    """Binding criteria that mention a resolved contradiction."""
    terms = usable(terminos, "terminos")
    f = Filters(True, instancia=instancia, anio_minimo=anio_minimo)
    return _run(lib, [terms, CONTRADICTION], f, limit=limite, scan_concepts=[terms],
                scan_extra=match.mentions_contradiction(), **how)


def parse_circuit(spark: SparkSession, circuito) -> int:
    number = None
    if not isinstance(circuito, bool) and circuito is not None:
        number = flt.evaluate(spark, court.parse_circuit(F.lit(str(circuito))))
    if number is None:
        raise ValueError(f"circuito={circuito!r}: use 1 to 32, a Roman numeral or an ordinal")
    return number


def search_circuit(lib: Library, circuito, terminos: Sequence[str], limite: int = 30,
                   **how) -> DataFrame:
    """What binds the courts of one circuit."""
    number = parse_circuit(lib.corpus.sparkSession, circuito)
    return _run(lib, [usable(terminos, "terminos")], Filters(circuito=number), limit=limite, **how)


def timeline(lib: Library, tema: Sequence[str], anio_minimo: int = 2010, instancia: str = "",
             limite: int = 30, **how) -> DataFrame:
    """Binding criteria on a subject, oldest first, cut into runs of one epoch.

    Sorted, then limited: the oldest are kept. A later return to an epoch opens
    a new run.
    """
    f = Filters(True, instancia=instancia, anio_minimo=anio_minimo)
    ranking = durable(
        _run(lib, [usable(tema, "tema")], f, order=rank.BY_YEAR, limit=limite, cap=80,
             texts=False, **how)
    )
    rows = attach(ranking, lib.corpus, ["rubro", "epoca", "anio", "tesis_codigo"])
    return epoch_runs(rows)


def epoch_runs(rows: DataFrame) -> DataFrame:
    """Number the runs of equal epochs along the ranking."""
    order = W.partitionBy("query_id").orderBy("rank")
    epoch = F.coalesce(F.nullif("epoca", F.lit("")), F.lit(NO_EPOCH))
    opens = F.coalesce((F.lag("epoca").over(order) != F.col("epoca")).cast("int"), F.lit(1))
    return (
        rows.withColumn("epoca", epoch)
        .withColumn("opens", opens)
        .withColumn("etapa", F.sum("opens").over(order).cast("int"))
        .select(
            "query_id", "rank", "etapa", (F.col("opens") == 1).alias("abre_etapa"), "epoca",
            "anio", "tesis_codigo", F.substring("rubro", 1, TIMELINE_TITLE).alias("rubro"),
            "id_tesis", "nivel",
        )
    )


def similar_query(references: DataFrame) -> DataFrame:
    """Query table that looks for the key words of each criterion's title, elsewhere."""
    words = keywords(F.col("rubro"))
    return references.select(
        F.col("id_tesis").alias("query_id"), F.array(words).alias("concepts"),
        F.col("id_tesis").alias("excluir"),
    ).filter(F.size(F.element_at("concepts", 1)) > 0)


def search_similar(lib: Library, id_tesis: str, limite: int = 15,
                   solo_jurisprudencia: bool = False, texts: bool = True) -> DataFrame:
    """Criteria that share rare title words with a given one."""
    reference = lib.corpus.filter(F.col("id_tesis") == str(id_tesis))
    query = similar_query(reference).first()
    if query is None:
        raise ValueError(f"id_tesis={id_tesis!r}: no such criterion, or no key words in its title")
    table = query_table(lib.corpus.sparkSession, [{"concepts": query.concepts}])
    lookups = Lookups.of(table, lib.term_stats)
    ranking = ranked_one(
        lib, lookups, Filters(solo_jurisprudencia, excluir=str(id_tesis)),
        rank.BY_SIMILARITY, rank.checked_limit(limite, 50),
    )
    return presented(lib, ranking, lookups) if texts else ranking


def search_batch(lib: Library, queries: DataFrame, texts: bool = False) -> DataFrame:
    """Many searches in one job; `queries` has columns of QUERY, at least the first two."""
    queries = durable(completed(queries))
    lookups = Lookups.of(queries, lib.term_stats)
    ranking = ranked_batch(lib, queries, lookups)
    return presented(lib, ranking, lookups) if texts else ranking
