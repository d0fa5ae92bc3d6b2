"""The similar criteria of every criterion of a table.

One search per distinct title among the references: its key words against the whole
corpus. What is scored is every document that shares a word with a title, so the
work grows with references times corpus. Asking it of a whole corpus means all pairs
of documents with a common word; there is no exact way around that, and no form
here pretends to one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.functions.text import keywords
from lexspark.operators import rank
from lexspark.operators.match import Lookups, salted_join
from lexspark.plans import search
from lexspark.session import durable
from lexspark.sources.tables import Library

SEPARATOR = "\u0001"


def similar_batch(lib: Library, references: DataFrame, limite: int = 15) -> DataFrame:
    """(query_id, rank, id_tesis, bm25): for each criterion of `references` (id_tesis) the
    most similar others, as `search_similar` finds them. An id that the corpus does
    not hold, or whose title has no key words, has no rows."""
    limit = rank.checked_limit(limite, 50)
    asked = references.select("id_tesis").distinct()
    words = F.sort_array(keywords(F.col("rubro")))
    members = durable(
        lib.corpus.join(asked, "id_tesis", "left_semi").filter(F.size(words) > 0)
        .select("id_tesis", F.array_join(words, SEPARATOR).alias("words"))
    )
    # The criterion itself may be among the best: one more is asked for.
    queries = search.completed(members.select("words").distinct().select(
        F.col("words").alias("query_id"), F.array(F.split("words", SEPARATOR)).alias("concepts"),
        F.lit(rank.BY_SIMILARITY).alias("orden"), F.lit(limit + 1).alias("limite")))
    queries = durable(queries)
    found = search.ranked_batch(lib, queries, Lookups.of(queries, lib.term_stats)).select(
        F.col("query_id").alias("words"), F.col("rank").alias("place"), F.col("id_tesis").alias("similar"), "bm25")
    # A title that a third of the references share is spread over the members.
    position = F.row_number().over(W.partitionBy("id_tesis").orderBy("place"))
    return (
        salted_join(members, found, ["words"], "id_tesis")
        .filter(F.col("similar") != F.col("id_tesis"))
        .withColumn("rank", position).filter(F.col("rank") <= limit)
        .select(F.col("id_tesis").alias("query_id"), "rank", F.col("similar").alias("id_tesis"), "bm25")
    )
