"""One document of each group of near copies: SimHash proposes, shingles decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import jaccard, simhash
from lexspark.llm.common import components, spread_join, stored

WORDS = 5
#: The share of their distinct shingles that two near copies have in common.
SIMILAR = jaccard.Similar(4, 5)


def links(found: jaccard.Prepared, distance: int = simhash.DISTANCE) -> DataFrame:
    """node, root: what pairs of sets connect whose SimHashes differ in `distance` bits at
    most and whose shingles are similar. The SimHashes of a family of copies are near one
    another, so its sets are connected before the lists of its shingles are searched."""
    asked = found.asks.select("node").distinct()
    marked = found.nodes.join(asked, "node").select("node", "fp")
    # Sets of one fingerprint are compared with one of them.
    firsts = stored(marked.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    same = spread_join(marked, firsts, "fp", "node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = simhash.links(firsts.select("fp", F.col("first").alias("node")), distance)
    pairs = stored(same.where("a <> b").unionByName(near), "pairs")
    return components(stored(jaccard.asked(pairs, found.sets, SIMILAR), "found"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, any other columns), without all but one row of
    each group of near copies: the one with the smallest doc_id stays.

    Near copies are texts whose distinct shingles of five words have a Jaccard
    similarity of 0.8 or more, compared by 64-bit hashes. SimHash finds most of them;
    what it misses is found by the search of `jaccard`, so that none is left out. Groups
    are what such pairs connect. Texts of the same shingles are one group. Null, empty
    and blank texts are one group too. A row with a null doc_id stays only if its group
    has no other; of rows equal in doc_id and text one stays. An empty table stays empty.
    """
    found = jaccard.prepared(docs, WORDS, SIMILAR, fingerprint=True)
    member = stored(links(found), "member")
    more = jaccard.connected(found.asks, found.sets, SIMILAR, member)
    member = components(more.unionByName(member.toDF("a", "b")))
    group = found.nodes.join(member, "node", "left").select("node", F.col("rows").alias("n"), F.coalesce("root", "node").alias("group"))
    grouped = spread_join(found.rows.select("doc_id", "key", "node"), stored(group, "groups"), "node", "doc_id")
    rows = stored(grouped.groupBy("group", "doc_id", "key").agg(F.count(F.lit(1)).alias("n")), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "key")).alias("_stay")
    stays = stored(rows.groupBy("group").agg(first, F.count(F.lit(1)).alias("n")), "stays")
    same = F.col("doc_id").eqNullSafe(F.col("_stay.doc_id")) & F.col("key").eqNullSafe(F.col("_stay.key"))
    judged = spread_join(rows.withColumnRenamed("n", "_n"), stays, "group", "doc_id").select(
        F.col("doc_id").alias("__gone_id"), F.col("key").alias("__gone_key"), "_n", same.alias("_stays"))
    judged = stored(judged.where("not _stays or _n > 1"), "judged")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone_id")) & F.xxhash64("text").eqNullSafe(F.col("__gone_key"))
    # What goes grows with the corpus: one plan for all sizes, in which the documents
    # meet it once by key. Rows that stay but are repeated are few and apart.
    once = docs.join(judged.select("__gone_id", "__gone_key").hint("merge"), on, "left_anti")
    repeated = stored(judged.where("_stays").select("__gone_id", "__gone_key"), "repeated")
    again = docs.join(repeated, on, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again)
