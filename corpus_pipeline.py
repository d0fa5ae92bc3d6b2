"""A corpus from raw documents: language, quality, shared lines, near copies, packing.

Each stage is a function of (spark, docs, sf_dir); run() writes each result as
Parquet to shared storage and reads it back as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import langmix, linededup, linefirst, neardup, tiers
from lexspark.llm.common import stored

#: A text whose best language holds less than this is no text of a known language.
LEAST_SCORE = 0.4


def _aside(docs: DataFrame, names: list[str]) -> DataFrame:
    """`docs` with all columns but `names` renamed, so that no stage's own columns clash."""
    return docs.select(*names, *[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(docs.columns) if c not in names])


def _back(found: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns of `docs` again; n_chars counts the text as it is now."""
    kept = {c: F.col(c) if c in names else F.col(f"own{i}") for i, c in enumerate(docs.columns)}
    if "n_chars" in kept:
        kept["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[kept[c].alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; a missing lang is filled in.

    Null, empty and letterless texts have no language and go. Repeated rows and rows
    with a null doc_id are judged like others (the latter teach nothing); other columns
    are handed through, whatever their names. An empty table stays empty; ValueError if
    documents have letters but no labelled one teaches a language.
    """
    names = ["doc_id", "text", "lang"]
    model = langmix.train(docs.where(~langmix.held_out() & F.col("doc_id").isNotNull()))
    if not model.languages and not docs.where(F.col("text").rlike(r"\p{L}")).isEmpty():
        raise ValueError("no document with a lang and a text to learn languages from")
    found = langmix.predict(_aside(docs, names), model)
    good = found.where((F.col("lang_pred") != langmix.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _back(good.withColumn("lang", F.coalesce("lang", "lang_pred")), docs, names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their failed lines removed.

    Null and empty texts fail. Each row is judged by itself, so ties, repeated rows and
    null ids need no rule; other columns are handed through; an empty table stays empty.
    """
    return _back(linefirst.clean(_aside(docs, ["doc_id", "text"])).where("kept"), docs, ["doc_id", "text"])


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that many of them share.

    A null text becomes an empty one. Every row counts as a document, also if rows share
    an id or are equal; a document that loses all lines stays with an empty text. Other
    columns are handed through; an empty table stays empty.
    """
    return _back(linededup.dedup(_aside(docs, ["doc_id", "text"])), docs, ["doc_id", "text"])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Null, empty and blank texts are one group. A null doc_id stays only without another
    one in its group; of equal rows one stays. Other columns are handed through; an empty
    table stays empty.
    """
    return neardup.representatives(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their windows.

    A null or empty text is the end id alone, a null doc_id stays null, equal rows are
    documents of their own; other columns are not read; an empty table gives no piece.
    """
    return tiers.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("line_dedup", shared_lines),
    ("near_dedup", near_copies),
    ("packing", packing),
]

# Language, fingerprints and token ids cannot be expressed in SQL; tests compare
# the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
