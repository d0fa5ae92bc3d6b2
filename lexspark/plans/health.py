"""Health of corpus and index as rows of (revision, estado, detalle)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.operators import match
from lexspark.operators.index import content_hash
from lexspark.operators.match import Lookups
from lexspark.plans.search import query_table
from lexspark.session import durable, local_table
from lexspark.sources.schema import TESIS
from lexspark.sources.segments import Segments, bucket_of
from lexspark.sources.tables import Library

LEFTOVER = "json_completo"
SANITY_TERM = "amparo"
_CHECK = T.StructType([T.StructField(n, T.StringType()) for n in ("revision", "estado", "detalle")])


def _row(name: str, ok, detail) -> list:
    state = F.when(ok, "ok").otherwise("fallo")
    return [F.lit(name).alias("revision"), state.alias("estado"), detail.alias("detalle")]


def check_rows(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("n")).select(
        *_row("tabla con registros", F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" registros")))
    )


def check_schema(corpus: DataFrame) -> DataFrame:
    """Every expected column is there; a leftover one is only reported."""
    missing = sorted(set(TESIS.names) - set(corpus.columns))
    rows = [["esquema minimo", "fallo" if missing else "ok", ", ".join(missing)]]
    if LEFTOVER in corpus.columns:
        rows.append([LEFTOVER, "info", "columna sobrante"])
    return local_table(corpus.sparkSession, rows, _CHECK)


def key_problems(corpus: DataFrame) -> DataFrame:
    """Missing keys and repeated ones, with the number of rows."""
    return (
        corpus.groupBy("id_tesis").agg(F.count("*").alias("filas"))
        .filter(F.col("id_tesis").isNull() | (F.col("id_tesis") == "") | (F.col("filas") > 1))
        .withColumn(
            "problema",
            F.when(F.coalesce("id_tesis", F.lit("")) == "", "clave vacia").otherwise("clave repetida"),
        )
    )


def check_keys(corpus: DataFrame) -> DataFrame:
    return key_problems(corpus).agg(F.count("*").alias("n")).select(
        *_row("claves", F.col("n") == 0, F.concat(F.col("n").cast("string"), F.lit(" con problemas")))
    )


def drift(corpus: DataFrame, doc_stats: DataFrame) -> DataFrame:
    """Documents that index and corpus do not agree on, and how."""
    return drift_of_hashes(corpus.select("id_tesis", content_hash().alias("content_hash")), doc_stats)


def drift_of_hashes(hashed: DataFrame, doc_stats: DataFrame) -> DataFrame:
    """The same for criteria whose content is hashed already."""
    now = hashed.select("id_tesis", F.col("content_hash").alias("now"))
    indexed = doc_stats.select("id_tesis", F.col("content_hash").alias("then"))
    kind = (
        F.when(F.col("then").isNull(), "sin indexar")
        .when(F.col("now").isNull(), "huerfano")
        .when(F.col("now") != F.col("then"), "cambiado")
    )
    return (
        now.join(indexed, "id_tesis", "full_outer")
        .select("id_tesis", kind.alias("desfase")).filter("desfase is not null")
    )


def segment_drift(corpus: DataFrame, segments: Segments) -> DataFrame:
    """The same against an index in segments: checksums of buckets first, then the lists of
    the buckets that differ; the others are not read.

    Texts are read once, to be hashed; an id and a hash are kept of each. Ids are taken
    as unique (`key_problems` finds others).
    """
    hashed = durable(corpus.select(
        "id_tesis", content_hash().alias("content_hash"), bucket_of(F.col("id_tesis"), segments.buckets).alias("bucket")))
    buckets = segments.differing(hashed)
    wanted = F.col("bucket").isin(buckets) | F.col("bucket").isNull()
    return drift_of_hashes(hashed.where(wanted), segments.docs(buckets))


def check_drift(lib: Library) -> DataFrame:
    return drift(lib.corpus, lib.doc_stats).agg(F.count("*").alias("n")).select(
        *_row("corpus e indice iguales", F.col("n") == 0,
              F.concat(F.col("n").cast("string"), F.lit(" documentos distintos")))
    )


def check_search(lib: Library, term: str = SANITY_TERM) -> DataFrame:
    """A common word has hits: the index is not empty."""
    query = query_table(lib.corpus.sparkSession, [{"concepts": [[term]]}])
    found = match.matches(match.hits(lib.postings, Lookups.of(query, lib.term_stats)))
    return found.agg(F.count("*").alias("n")).select(
        *_row("busqueda de prueba", F.col("n") > 0,
              F.concat(F.col("n").cast("string"), F.lit(f" documentos para '{term}'")))
    )


def health(lib: Library, term: str = SANITY_TERM) -> DataFrame:
    checks = [
        check_rows(lib.corpus), check_schema(lib.corpus), check_keys(lib.corpus),
        check_drift(lib), check_search(lib, term),
    ]
    return reduce(DataFrame.unionByName, checks)


def verdict(checks: DataFrame) -> DataFrame:
    """One row: all passed, how many failed, and the report as JSON."""
    report = F.to_json(F.sort_array(F.collect_list(F.struct("revision", "estado", "detalle"))))
    return checks.agg(
        F.bool_and(F.col("estado") != "fallo").alias("ok"),
        F.count_if(F.col("estado") == "fallo").alias("fallos"),
        report.alias("informe"),
    )
