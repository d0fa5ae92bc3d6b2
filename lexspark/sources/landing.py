"""Landed upstream replies: parse, normalise, reject, compare, upsert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.session import durable
from lexspark.sources.schema import CORRUPT, PAGE_KEYS, REPLY, TESIS, UPSTREAM
from lexspark.sources.tables import rows_of


def page_ids(pages: DataFrame) -> DataFrame:
    """Ids named by the id pages (column payload): a list, or an object that
    wraps one under a known key; anything else names none."""
    ids = T.ArrayType(T.StringType())
    wrapped = T.StructType([T.StructField(k, T.StringType()) for k in PAGE_KEYS])
    lists = pages.select("*", F.from_json("payload", wrapped).alias("o")).select(
        "*",
        F.when(F.trim("payload").startswith("["), F.from_json("payload", ids)).alias("plain"),
        *[
            F.when(F.trim(F.col(f"o.{k}")).startswith("["), F.from_json(F.col(f"o.{k}"), ids)).alias(f"l_{k}")
            for k in PAGE_KEYS
        ],
    )
    first = F.coalesce("plain", *[F.col(f"l_{k}") for k in PAGE_KEYS])
    return lists.select(F.explode(first).alias("id_tesis")).filter("id_tesis is not null")


def new_ids(ids: DataFrame, corpus: DataFrame) -> DataFrame:
    """Ids not stored yet, compared as text."""
    wanted = ids.select(F.col("id_tesis").cast("string").alias("id_tesis")).distinct()
    # A small batch is looked up by id; the stored ids are not shuffled for it.
    return wanted.join(rows_of(corpus.select("id_tesis"), wanted), "id_tesis", "left_anti")


def parsed(replies: DataFrame) -> DataFrame:
    """Replies (requested_id, payload) with the record `r`, NULL unless it is an object."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    record = F.from_json("payload", REPLY, options)
    # Exploding the one record keeps it from being parsed once per field.
    return replies.withColumn("r", F.explode(F.array(record))).withColumn(
        "valid", F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull()
    )


def rejects(replies: DataFrame) -> DataFrame:
    """Replies that are no JSON object; counted as errors and set aside."""
    return parsed(replies).filter(~F.col("valid")).select("requested_id", "payload")


def _subjects(c: Column) -> Column:
    """A list becomes ", "-joined text, other values their text."""
    items = F.from_json(c, T.ArrayType(T.StringType()))
    return F.when(F.trim(c).startswith("["), F.concat_ws(", ", items)).otherwise(c)


def normalized(replies: DataFrame, ingested: Column | None = None) -> DataFrame:
    """Valid replies as corpus rows; missing texts are empty, a missing id is the requested one."""
    columns = []
    for name, column in UPSTREAM.items():
        value = F.col(f"r.{name}")
        if column == "id_tesis":
            value = F.coalesce(value, F.col("requested_id"))
        elif column == "anio":
            number = value.try_cast("double")
            whole = F.when((number == F.floor(number)) & (F.abs(number) < 2**31), number.cast("int"))
            value = F.coalesce(value.try_cast("int"), whole)
        elif column == "materias":
            value = F.coalesce(_subjects(value), F.lit(""))
        else:
            value = F.coalesce(value, F.lit(""))
        columns.append(value.alias(column))
    stamp = F.current_timestamp() if ingested is None else ingested
    rows = parsed(replies).filter("valid").select(*columns, stamp.alias("fecha_descarga"))
    return rows.select(*TESIS.names)


def latest(versions: DataFrame, order: list[Column]) -> DataFrame:
    """The last version of each criterion. A key has few versions; the group is
    one criterion, and co-located where the table is bucketed by id."""
    place = F.row_number().over(W.partitionBy("id_tesis").orderBy(*[c.desc() for c in order]))
    return versions.withColumn("v", place).filter("v = 1").drop("v")


def upsert(corpus: DataFrame, incoming: DataFrame) -> DataFrame:
    """Corpus after whole rows came in: replaced by key, or added.

    Several replies for one id count as one; equal ingest times are settled by content.
    """
    fresh = latest(incoming, [F.col("fecha_descarga"), F.xxhash64(*incoming.columns)])
    kept = corpus.join(fresh.select("id_tesis"), "id_tesis", "left_anti")
    return kept.select(*TESIS.names).unionByName(fresh.select(*TESIS.names))


# What a run reports.
def run_status(new: Column, errors: Column) -> Column:
    return (
        F.when(
            errors > 0,
            F.concat(F.lit("Completado con "), errors.cast("string"), F.lit(" error(es) - "),
                     new.cast("string"), F.lit(" nuevas")),
        )
        .when(new > 0, F.concat(F.lit("Exito - "), new.cast("string"),
                                F.lit(" tesis nuevas descargadas")))
        .otherwise(F.lit("Base de datos ya actualizada (sin tesis nuevas)"))
    )


def run_log(replies: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: new criteria, errors, total afterwards, status.

    `replies` and `corpus` are those before the run. Every count is aggregated
    to one row before the rows meet.
    """
    # Counted, listed and joined below: the replies are read and parsed once for all of that.
    checked = durable(parsed(replies).select(
        "valid", F.coalesce("r.idTesis", "requested_id").alias("id_tesis")
    ))
    errors = checked.agg(F.count_if(~F.col("valid")).alias("errores"))
    new = new_ids(checked.filter("valid"), corpus).agg(F.count("*").alias("nuevas"))
    stored = corpus.agg(F.count("*").alias("antes"))
    return _one_row([new, errors, stored]).select(
        "nuevas", "errores", (F.col("antes") + F.col("nuevas")).alias("total"),
        run_status(F.col("nuevas"), F.col("errores")).alias("estado"),
    )


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """One-row tables side by side."""
    keyed = [p.withColumn("k", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(F.broadcast(b), "k"), keyed).drop("k")


def reconcile(reported: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Upstream's count (column payload: number or digits, else unknown) beside
    the stored totals before and after a run."""
    count = F.when(F.trim(F.col("payload"), F.lit('"')).rlike("^[0-9]+$"),
                   F.trim(F.col("payload"), F.lit('"')).try_cast("bigint"))
    return _one_row(
        [
            reported.agg(F.max(count).alias("reportado")),
            before.agg(F.count("*").alias("antes")),
            after.agg(F.count("*").alias("despues")),
        ]
    ).select(
        "reportado", "antes", "despues",
        (F.col("despues") - F.col("antes")).alias("delta"),
        (F.col("reportado") - F.col("despues")).alias("faltan"),
    )
