"""Result orders and top-k per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.functions import court

BY_FORCE = "vinculancia"
BY_SCORE = "relevancia"
BY_DATE = "reciente"
BY_YEAR = "cronologico"
BY_SIMILARITY = "similitud"
# The best scores lead.
SCORED = (BY_SCORE, BY_SIMILARITY)

MAX_RESULTS = 100


def force() -> Column:
    """Binding force: the smaller, the stronger."""
    isolated = F.when(court.is_binding(F.col("tipo_tesis")), 0).otherwise(1)
    return isolated * 10 + court.binding_bucket(F.col("instancia"), F.col("organo_juris"))


def by_year(year: Column) -> tuple[Column, Column]:
    """Keys by which the newest or the oldest lead; a missing year comes last, or first."""
    return F.coalesce(-year, F.lit(2**31 - 1)).cast("bigint"), F.coalesce(year, F.lit(-(2**31))).cast("bigint")


def sort_keys(order: Column) -> list[Column]:
    """Keys for rows with tipo_tesis, instancia, organo_juris, units, anio, id_tesis.

    Unknown names mean the default. Missing years come last when the newest
    lead, first when the oldest do. The id always breaks ties.
    """
    strength = force()
    score = -F.col("units")
    newest, oldest = by_year(F.col("anio"))
    zero = F.lit(0).cast("bigint")

    def pick(by_force: Column, by_score: Column, by_date: Column, by_year: Column,
             by_similarity: Column) -> Column:
        return (
            F.when(order == BY_SCORE, by_score)
            .when(order == BY_DATE, by_date)
            .when(order == BY_YEAR, by_year)
            .when(order == BY_SIMILARITY, by_similarity)
            .otherwise(by_force)
        )

    return [
        pick(strength, score, newest, oldest, score).asc(),
        pick(score, newest, zero, strength, strength).asc(),
        pick(newest, zero, zero, zero, zero).asc(),
        F.when(order == BY_DATE, F.col("id_tesis")).desc(),
        F.col("id_tesis").asc(),
    ]


def top_k(rows: DataFrame, order: Column, limit: Column, cap: int = MAX_RESULTS) -> DataFrame:
    """Rank within each query and keep the best.

    The constant cap lets each partition keep only its own best rows before the
    shuffle, however many documents one query matches.
    """
    position = F.row_number().over(W.partitionBy("query_id").orderBy(*sort_keys(order)))
    return rows.withColumn("rank", position).filter(
        (F.col("rank") <= cap) & (F.col("rank") <= limit)
    )


def checked_limit(limit: int, cap: int = MAX_RESULTS) -> int:
    """At least 1; more than the documented maximum is an error, never a silent cut."""
    if int(limit) > cap:
        raise ValueError(f"limite={limit}: at most {cap}")
    return max(1, int(limit))


def clamp(value: int, cap: int = MAX_RESULTS) -> int:
    """A distance, brought into its range."""
    return max(1, min(int(value), cap))
