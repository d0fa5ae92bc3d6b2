"""What a corpus holds: facets, summary, breakdown, weights, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.functions import court
from lexspark.sources.tables import Library

FACETS = ("tipo_tesis", "epoca", "instancia", "materias", "organo_juris", "fuente")
EPOCHS_SHOWN = 12


def facet(corpus: DataFrame, campo: str, limite: int = 30) -> DataFrame:
    """Values of one field and how often they occur, most frequent first."""
    if campo not in FACETS:
        raise ValueError(f"campo={campo!r}: use one of {', '.join(sorted(FACETS))}")
    return (
        corpus.filter(F.col(campo).isNotNull() & (F.col(campo) != ""))
        .groupBy(F.col(campo).alias("valor"))
        .agg(F.count("*").alias("total"))
        .orderBy(F.col("total").desc(), "valor")
        .limit(limite)
    )


def facets(corpus: DataFrame, limite: int = 30) -> DataFrame:
    """All fields in one pass."""
    pairs = ", ".join(f"'{c}', {c}" for c in FACETS)
    counts = (
        corpus.select(F.expr(f"stack({len(FACETS)}, {pairs}) as (campo, valor)"))
        .filter("valor is not null and valor <> ''")
        .groupBy("campo", "valor").agg(F.count("*").alias("total"))
    )
    place = F.row_number().over(W.partitionBy("campo").orderBy(F.col("total").desc(), "valor"))
    return counts.withColumn("lugar", place).filter(F.col("lugar") <= limite)


def corpus_summary(corpus: DataFrame) -> DataFrame:
    known = F.when(F.col("anio") > 0, F.col("anio"))
    return corpus.agg(
        F.count("*").alias("total"),
        F.min(known).alias("anio_min"),
        F.max(known).alias("anio_max"),
        F.max("fecha_descarga").alias("ultima_descarga"),
    )


def corpus_breakdown(corpus: DataFrame) -> DataFrame:
    """Counts by type, court and epoch in one pass, most frequent first.

    Empty courts and epochs are left out, an empty type is not; the twelve most
    frequent epochs are shown.
    """
    fields = ["tipo_tesis", "instancia", "epoca"]
    grouped = (
        corpus.select(*fields)
        .groupingSets([[F.col(f)] for f in fields], *[F.col(f) for f in fields])
        .agg(
            F.count("*").alias("total"),
            F.grouping("tipo_tesis").alias("g_tipo"),
            F.grouping("instancia").alias("g_inst"),
        )
    )
    dimension = (
        F.when(F.col("g_tipo") == 0, "tipo_tesis").when(F.col("g_inst") == 0, "instancia")
        .otherwise("epoca")
    )
    value = F.coalesce(*fields)
    place = F.row_number().over(
        W.partitionBy("dimension").orderBy(F.col("total").desc(), F.col("valor").asc_nulls_first())
    )
    return (
        grouped.select(dimension.alias("dimension"), value.alias("valor"), "total")
        .filter((F.col("dimension") == "tipo_tesis") | (F.coalesce("valor", F.lit("")) != ""))
        .withColumn("lugar", place)
        .filter((F.col("dimension") != "epoca") | (F.col("lugar") <= EPOCHS_SHOWN))
    )


def describe_corpus(lib: Library, run_log: DataFrame | None = None) -> dict[str, DataFrame]:
    """Summary, breakdown and the last entry of the run log."""
    described = {
        "resumen": corpus_summary(lib.corpus), "desglose": corpus_breakdown(lib.corpus),
    }
    if run_log is not None:
        described["ultima_actualizacion"] = run_log.orderBy(F.col("fecha").desc()).limit(1)
    return described


def result_summary(result: DataFrame) -> DataFrame:
    """Per query: results, binding and isolated ones, and one column per level."""
    binding = F.col("nivel").isin("S", "A", "B", "C", "D")
    return result.groupBy("query_id").agg(
        F.count("*").alias("total"),
        F.count_if(binding).alias("jurisprudencias"),
        F.count_if(~binding).alias("aisladas"),
        *[F.count_if(F.col("nivel") == x).alias(f"nivel_{x.lower()}") for x in court.LEVELS],
    )


def column_weights(corpus: DataFrame) -> DataFrame:
    """Characters stored per text column; what dropping it would save."""
    names = [f.name for f in corpus.schema if isinstance(f.dataType, T.StringType)]
    sums = corpus.agg(*[F.coalesce(F.sum(F.length(n)), F.lit(0)).alias(n) for n in names])
    return sums.unpivot([], names, "columna", "caracteres")


def result_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows only in one of two results, repeats counted; empty if they are equal."""
    return before.exceptAll(after).withColumn("lado", F.lit("antes")).unionByName(
        after.exceptAll(before).withColumn("lado", F.lit("despues"))
    )


# -- kept counts --------------------------------------------------------------

COUNTED = (*FACETS, "anio")


def kept_counts(corpus: DataFrame) -> DataFrame:
    """campo, valor, total, ultima: how often each value of a counted field occurs, in one
    pass. The field '' counts criteria, and keeps the time at which the last one came."""
    pairs = ", ".join(f"'{c}', cast({c} as string)" for c in COUNTED)
    values = corpus.select("fecha_descarga", F.expr(f"stack({len(COUNTED) + 1}, '', '', {pairs}) as (campo, valor)"))
    last = F.max(F.when(F.col("campo") == "", F.col("fecha_descarga"))).alias("ultima")
    return values.groupBy("campo", "valor").agg(F.count("*").alias("total"), last)


def merged_counts(counts: DataFrame, all_rows: bool = False) -> DataFrame:
    """The sum of several counts, some of them negative; values that are gone drop out.
    `ultima` is the time of the last criterion that came, also if it has been replaced."""
    summed = counts.groupBy("campo", "valor").agg(F.sum("total").alias("total"), F.max("ultima").alias("ultima"))
    return summed if all_rows else summed.filter("total > 0")


def counted_facets(counts: DataFrame, limite: int = 30) -> DataFrame:
    """facets() from kept counts."""
    place = F.row_number().over(W.partitionBy("campo").orderBy(F.col("total").desc(), "valor"))
    shown = counts.filter(F.col("campo").isin(*FACETS) & (F.coalesce("valor", F.lit("")) != ""))
    return shown.select("campo", "valor", "total").withColumn("lugar", place).filter(F.col("lugar") <= limite)


def counted_summary(counts: DataFrame) -> DataFrame:
    """corpus_summary() from kept counts; years by those that still have criteria."""
    year = F.when((F.col("campo") == "anio") & (F.col("valor").cast("int") > 0), F.col("valor").cast("int"))
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("campo") == "", F.col("total"))), F.lit(0).cast("long")).alias("total"),
        F.min(year).alias("anio_min"), F.max(year).alias("anio_max"), F.max("ultima").alias("ultima_descarga"),
    )


def counted_breakdown(counts: DataFrame) -> DataFrame:
    """corpus_breakdown() from kept counts."""
    place = F.row_number().over(
        W.partitionBy("dimension").orderBy(F.col("total").desc(), F.col("valor").asc_nulls_first()))
    return (
        counts.filter(F.col("campo").isin("tipo_tesis", "instancia", "epoca"))
        .select(F.col("campo").alias("dimension"), "valor", "total")
        .filter((F.col("dimension") == "tipo_tesis") | (F.coalesce("valor", F.lit("")) != ""))
        .withColumn("lugar", place)
        .filter((F.col("dimension") != "epoca") | (F.col("lugar") <= EPOCHS_SHOWN))
    )
