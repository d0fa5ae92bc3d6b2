"""Optional metadata filters, all joined by AND.

The same rules serve one query, whose values are literals pushed to the corpus
scan, and a table of queries, whose values are columns of the joined row.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import court
from lexspark.functions.text import contains_folded, fold


@dataclass(frozen=True)
class Filters:
    """Values of one query; blank, zero and empty mean off."""

    solo_jurisprudencia: bool = False
    materia: str = ""
    instancia: str = ""
    organo: str = ""
    anio_minimo: int = 0
    anio_maximo: int = 0
    epocas: Sequence[str] = field(default_factory=tuple)
    circuito: int | None = None
    excluir: str | None = None


def preset_key(name: str) -> str:
    key = name.strip().lower().replace(" ", "_")
    if key and key not in court.PRESETS:
        raise ValueError(f"instancia={name!r}: use one of {', '.join(sorted(court.PRESETS))}")
    return key


def evaluate(spark: SparkSession, expression: Column):
    """Value of an expression without inputs."""
    return spark.range(1).select(expression.alias("value")).first()[0]


def canonical_epochs(spark: SparkSession, epochs: Sequence[str]) -> list[str]:
    """Canonical names of the recognised epochs; it is an error if there is none."""
    if not epochs:
        return []
    names = F.transform(F.array(*[F.lit(str(e)) for e in epochs]), court.normalize_epoch)
    known = [name for name in evaluate(spark, names) if name]
    if not known:
        raise ValueError(f"epocas={list(epochs)!r}: none is known")
    return known


def rules(q: Callable[[str], Column], c: Callable[[str], Column]) -> list[Column]:
    """The conditions of a query on a corpus row. `q` gives the query's values, `c` the
    corpus columns; a value that asks for nothing makes its condition true."""
    kind, tribunal, organ = c("tipo_tesis"), c("instancia"), c("organo_juris")
    preset = F.when(q("instancia") == "", F.lit(True))
    for name, condition in court.court_presets(tribunal, organ).items():
        preset = preset.when(q("instancia") == name, condition)
    return [
        ~q("solo_jurisprudencia") | court.is_binding(kind),
        (F.trim(q("materia")) == "") | contains_folded(c("materias"), F.trim(q("materia"))),
        F.coalesce(preset, F.lit(False)),
        (F.trim(q("organo")) == "") | contains_folded(organ, F.trim(q("organo"))),
        (q("anio_minimo") <= 0) | (c("anio") >= q("anio_minimo")),
        (q("anio_maximo") <= 0) | (c("anio") <= q("anio_maximo")),
        (F.size(q("epocas")) == 0) | F.array_contains(q("epocas"), c("epoca")),
        q("circuito").isNull() | court.binds_circuit(kind, tribunal, organ, q("circuito")),
        q("excluir").isNull() | (c("id_tesis") != q("excluir")),
    ]


def literal_conditions(spark: SparkSession, f: Filters) -> list[Column]:
    """The rules for one query. Its values are literals, so the optimiser folds what it
    does not ask for and pushes the rest to the scan."""
    values = {
        **asdict(f), "materia": f.materia or "", "organo": f.organo or "", "instancia": preset_key(f.instancia or ""),
        "anio_minimo": int(f.anio_minimo or 0), "anio_maximo": int(f.anio_maximo or 0),
        "solo_jurisprudencia": bool(f.solo_jurisprudencia),
    }
    epochs = F.array(*map(F.lit, canonical_epochs(spark, f.epocas))).cast("array<string>")
    kinds = {"circuito": "int", "excluir": "string"}
    return rules(
        lambda name: epochs if name == "epocas" else F.lit(values[name]).cast(kinds[name]) if name in kinds else F.lit(values[name]),
        F.col)


def apply_filters(corpus: DataFrame, f: Filters) -> DataFrame:
    spark = corpus.sparkSession
    conditions = literal_conditions(spark, f)
    if f.epocas and "epoca_part" in corpus.columns:
        # The layout's own copy of the epoch prunes directories.
        names = F.array(*map(F.lit, canonical_epochs(spark, f.epocas)))
        conditions.append(F.col("epoca_part").isin(list(evaluate(spark, F.transform(names, fold)))))
    return reduce(lambda df, condition: df.filter(condition), conditions, corpus)


def checked_filters(queries: DataFrame) -> DataFrame:
    """Query table with canonical epochs and preset names; unknown ones fail the job."""
    key = F.replace(F.lower(F.trim("instancia")), F.lit(" "), F.lit("_"))
    preset = F.when((key == "") | key.isin(*court.PRESETS), key).otherwise(
        F.raise_error(F.concat(F.lit("unknown instancia: "), key)).cast("string")
    )
    known = F.filter(F.transform("epocas", court.normalize_epoch), lambda e: e.isNotNull())
    epochs = F.when((F.size("epocas") == 0) | (F.size(known) > 0), known).otherwise(
        F.raise_error(F.lit("none of the epocas is known")).cast("array<string>")
    )
    return queries.withColumn("instancia", preset).withColumn("epocas", epochs)


def query_condition(q: str, c: str) -> Column:
    """The same rules with per-query values: struct `q` against corpus struct `c`."""
    return reduce(lambda a, b: a & b, rules(lambda name: F.col(f"{q}.{name}"), lambda name: F.col(f"{c}.{name}")))
