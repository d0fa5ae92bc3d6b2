"""BM25 over phrase hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.operators import match
from lexspark.operators.match import PHRASE, Lookups
from lexspark.session import durable
from lexspark.sources.tables import Library

# Fixed values.
K1 = 1.2
B = 0.75
MIN_IDF = 1e-6
# Contributions are summed as integers of this unit, so that a score does not
# depend on the order in which partitions arrive, nor a ranking on a retry.
UNIT = 1e12


def document_frequency(rows: DataFrame) -> DataFrame:
    """Documents per phrase of several tokens, inside the searched column, over
    the whole corpus. Words bring theirs from the term statistics."""
    return (
        rows.filter("plen > 1").select(*PHRASE, "id_tesis").distinct()
        .groupBy(*PHRASE).agg(F.count("*").alias("counted"))
    )


def weight(f: Column, dl: Column, average: float) -> Column:
    """What frequency and length give, whatever the phrase's rarity."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / average))


def rarity(lib: Library, n: Column) -> Column:
    """What a phrase that `n` documents hold gives, whatever its frequency in one."""
    return F.greatest(F.ln((F.lit(lib.size[0]) - n + 0.5) / (n + 0.5)), F.lit(MIN_IDF))


def units(lib: Library, n: Column, weight: Column) -> Column:
    """A weight times the rarity of a phrase that `n` documents hold, in integer units."""
    return F.floor(rarity(lib, n) * weight * UNIT + 0.5)


def contribution(lib: Library, f: Column, n: Column, dl: Column) -> Column:
    """One phrase's part of the score of one document, in integer units."""
    return units(lib, n, weight(f, dl, lib.size[1]))


def as_bm25(units: Column) -> Column:
    """Lower is better."""
    return F.round(-units / F.lit(UNIT), 6)


def _frequencies(found: DataFrame) -> DataFrame:
    """Instances `f` of each phrase in each document, over the searched columns."""
    return found.groupBy(*PHRASE, "n_concepts", "plen", "n", "id_tesis", "dl").agg(
        F.sum(F.size("starts")).cast("double").alias("f")
    )


def phrase_frequencies(lib: Library, lookups: Lookups) -> DataFrame:
    """The same of the phrases of several tokens, written once, with their documents counted."""
    phrases = durable(_frequencies(match.phrase_hits(lib.postings, lookups, shortest=2)))
    counted = lookups.join_phrases(phrases, document_frequency(phrases))
    return counted.withColumn("n", F.coalesce("n", "counted")).drop("counted")


def scored(lib: Library, lookups: Lookups) -> DataFrame:
    """(query_id, id_tesis, units) of every document that satisfies its query."""
    if lookups.has_near:
        found = match.hits(lib.postings, lookups)
        weighed = _frequencies(match.matching_hits(found, lookups))
    else:
        # Words and phrases are brought to one small row per phrase and document
        # each in its own way. Only phrases must be counted before they are weighed,
        # so only their rows are written; words bring their counts along.
        parts = []
        if lookups.has_words or not lookups.has_phrases:
            parts.append(_frequencies(match.word_hits(lib.postings, lookups)))
        if lookups.has_phrases:
            parts.append(phrase_frequencies(lib, lookups))
        weighed = reduce(DataFrame.unionByName, parts)
    if lookups.has_near and lookups.has_phrases:
        weighed = lookups.join_phrases(weighed, document_frequency(found)).withColumn(
            "n", F.coalesce("n", "counted")
        )
    return (
        match.with_all_concepts(weighed, contribution(lib, F.col("f"), F.col("n"), F.col("dl")))
        .withColumnRenamed("s0", "units")
    )
