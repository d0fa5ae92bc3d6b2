"""The best documents by score, without scoring every match.

Documents lie in small blocks of similar length. For each token the largest weight it
reaches in a block is stored beside the index (`bounds`), and the frequencies of a
block's documents without positions (`impacts`). The blocks of the largest bounds are
scored first and give a k-th score. No block whose bound lies below it is read. In the others
the words of the smallest bounds, as far as their sum stays below it, can't lift a
document that has none of the other, leading words: only leading words are read, then the
rest of the documents that can still reach the k-th score.

Nothing is missed. A bound is at least the score of each document of its block, and what
ties with the k-th score is read. A query whose first blocks hold fewer than k documents
that pass its filters reads all its words in all blocks.

Both tables are bucketed by block, so bounds and scores are summed where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.operators import index, match, rank, score
from lexspark.operators.match import Lookups, salted_join
from lexspark.session import durable, local_table, small_rows

# Documents of a block, and blocks read first for a k-th score.
BLOCK = 32
FIRST = 16
# Numbers of blocks of one bucket; a bucket holds fewer.
_STRIDE = 1 << 40
_IMPACTS = ["block", "tok", "id_tesis", "dl", "f_todo", "f_rubro", "f_texto"]
# Rows that are handed on at once.
_ROWS = 1 << 17
_WORD = ("query_id", "concept", "phrase", "n_concepts", "buscar_en", "n", "tok")


# -- tables -----------------------------------------------------------------

def blocks(stats: DataFrame, buckets: int) -> DataFrame:
    """id_tesis, block: the documents of each bucket in order of length, cut into blocks.
    Length decides most of a token's weight, so the largest of a block is near the others."""
    bucket = F.pmod(F.hash("id_tesis"), F.lit(buckets)).cast("bigint")
    place = F.row_number().over(W.partitionBy("bucket").orderBy("dl", "id_tesis"))
    number = F.col("bucket") * _STRIDE + F.expr(f"(place - 1) div {BLOCK}")
    return (
        stats.select("id_tesis", "dl", bucket.alias("bucket")).withColumn("place", place)
        .select("id_tesis", number.alias("block"))
    )


def impacts(posts: DataFrame, placed: DataFrame) -> DataFrame:
    """One row per document and token: how often it occurs in all columns, title and body."""
    def held(column: str) -> Column:
        return F.sum(F.when(F.col("col") == column, F.size("pos")).otherwise(0)).cast("int")

    counted = posts.groupBy("id_tesis", "tok").agg(
        F.max("dl").alias("dl"), F.sum(F.size("pos")).cast("int").alias("f_todo"),
        held("rubro").alias("f_rubro"), held("texto").alias("f_texto"))
    return counted.join(placed, "id_tesis").select("block", "tok", "id_tesis", "dl", "f_todo", "f_rubro", "f_texto")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of impacts from the tokens of whole documents, each with its block."""
    columns = len(index.INDEXED)
    for some, counts in index.chunks(batches):
        number, toks = index.numbered(some)
        # Token, document and column in one integer.
        key = np.sort(number * (len(some) * columns) + index.fields(counts))
        held, col = np.divmod(key, columns)
        opens = np.flatnonzero(np.diff(held, prepend=-1))
        tok, row = np.divmod(held[opens], len(some))
        of = lambda c: np.add.reduceat((col == index.INDEXED.index(c)).astype(np.int32), opens)
        made = pa.RecordBatch.from_arrays([
            some["block"].take(pa.array(row)), toks.take(pa.array(tok)), some["id_tesis"].take(pa.array(row)),
            some["dl"].take(pa.array(row)), pa.array(np.diff(np.append(opens, len(key))), pa.int32()),
            pa.array(of("rubro"), pa.int32()), pa.array(of("texto"), pa.int32())], _IMPACTS)
        yield from (made.slice(n, _ROWS) for n in range(0, len(made), _ROWS))


def dealt_impacts(corpus: DataFrame, posts: DataFrame, placed: DataFrame, parts: int) -> DataFrame:
    """impacts() of a corpus, in tasks of whole blocks. Texts are dealt out by block and counted there;
    rows of postings, many times as many, are read only for ids that the corpus holds several times."""
    repeated = durable(corpus.groupBy("id_tesis").agg(F.count("*").alias("n")).where("n > 1 and id_tesis is not null").select("id_tesis"))
    texts = corpus.select("id_tesis", *index.INDEXED)
    several = bool(repeated.head(1))
    once = texts.join(repeated, "id_tesis", "left_anti") if several else texts
    dealt = once.join(placed, "id_tesis").repartition(parts, "block")
    counted = index.tokenized(dealt, "block").select("id_tesis", "dl", *index.INDEXED, "block").mapInArrow(
        _counted, "block bigint, tok string, id_tesis string, dl int, f_todo int, f_rubro int, f_texto int")
    if not several:
        return counted
    rest = impacts(posts.join(repeated, "id_tesis", "left_semi"), placed)
    return counted.unionByName(rest.repartition(parts, "block"))


def bounds(stored: DataFrame, average: float) -> DataFrame:
    """Largest weight of each token in each block. All columns count, so it holds for
    searches of title or body, too."""
    weight = score.weight(F.col("f_todo").cast("double"), F.col("dl"), average)
    return stored.groupBy("block", "tok").agg(F.max(weight).alias("weight"))


# -- queries ----------------------------------------------------------------

def usable(lib, lookups: Lookups) -> bool:
    """A rule of distance is no sum of weights."""
    return lib.impacts is not None and not lookups.has_near


def _words(lookups: Lookups) -> DataFrame:
    return lookups.rows.filter("plen = 1").select(*_WORD)


def _phrases(lib, lookups: Lookups) -> DataFrame | None:
    """Contributions of phrases of several tokens: they have to be counted in the whole
    corpus before one can be weighed, so they are known exactly."""
    if not lookups.has_phrases:
        return None
    weighed = score.phrase_frequencies(lib, lookups)
    units = score.contribution(lib, F.col("f"), F.col("n"), F.col("dl"))
    return weighed.join(lib.blocks, "id_tesis").select(
        "query_id", "concept", "phrase", "n_concepts", "block", "id_tesis", units.alias("units"))


def block_bounds(lib, lookups: Lookups, phrases: DataFrame | None) -> DataFrame:
    """(query_id, block, most): the blocks in which every concept of a query can occur,
    with the most units a document there can have."""
    # One unit more than computed covers the rounding of a narrower search's weight.
    units = score.units(lib, F.col("n"), F.col("weight")) + 1
    columns = ("query_id", "concept", "n_concepts", "block", "units")
    rows = lookups.join_first_token(lib.bounds, _words(lookups), "block").withColumn("units", units).select(*columns)
    if phrases is not None:
        largest = phrases.groupBy("query_id", "concept", "phrase", "n_concepts", "block").agg(F.max("units").alias("units"))
        rows = rows.unionByName(largest.select(*columns))
    return match.with_all_concepts(rows, F.col("units"), document=("block",)).withColumnRenamed("s0", "most")


def _read(lib, lookups: Lookups, wanted: DataFrame) -> DataFrame:
    """Rows of `impacts` asked for by (block, tok) of `wanted`, or by (block, tok, id_tesis),
    with the units they bring their query. `wanted` must be cheap to read again."""
    known = small_rows(wanted)
    table = lookups.pushed_down(lib.impacts)
    if known is not None:
        # Few rows: only their blocks' buckets and row groups are read.
        numbers = sorted({r.block for r in known})
        table = table.filter(F.expr(f"block in ({', '.join(map(str, numbers))})") if numbers else F.lit(False))
        wanted = F.broadcast(local_table(lib.impacts.sparkSession, known, wanted.schema))
    scope = F.col("buscar_en")
    f = F.when(scope == "rubro", F.col("f_rubro")).when(scope == "texto", F.col("f_texto")).otherwise(F.col("f_todo"))
    units = score.contribution(lib, F.col("f"), F.col("n"), F.col("dl"))
    keys = [c for c in ("block", "tok", "id_tesis") if c in wanted.columns]
    return (
        table.join(wanted, keys).withColumn("f", f.cast("double")).filter("f > 0")
        .select("query_id", "concept", "n_concepts", "block", "id_tesis", units.alias("units"))
    )


def _summed(rows: DataFrame) -> DataFrame:
    found = match.with_all_concepts(rows, F.col("units"), document=("block", "id_tesis"))
    return found.select("query_id", "id_tesis", F.col("s0").alias("units"))


def _by_query(many: DataFrame, few: DataFrame, lookups: Lookups) -> DataFrame:
    """One row per query joined to rows of blocks; a query may hold most of these."""
    return many.join(F.broadcast(few), "query_id") if lookups.small else salted_join(many, few, ["query_id"], "block")


def _kth(found: DataFrame) -> DataFrame:
    """(query_id, least): the score at place `limite`, of queries that have so many rows."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("units").desc()))
    return (
        found.withColumn("place", place)
        .filter((F.col("place") <= rank.MAX_RESULTS) & (F.col("place") == F.col("limite")))
        .select("query_id", F.col("units").alias("least"))
    )


def demanded(lib, lookups: Lookups, phrases: DataFrame | None, admitted: Callable[[DataFrame], DataFrame],
             limit: Column) -> DataFrame:
    """(query_id, block, least): blocks that can reach the k-th score of the blocks read
    first, and that score; 0 if these hold fewer documents."""
    most = durable(block_bounds(lib, lookups, phrases))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("most").desc(), "block"))
    first = durable(most.withColumn("place", place).filter(F.col("place") <= FIRST).select("query_id", "block"))
    words = _words(lookups)
    rows = _read(lib, lookups, first.join(F.broadcast(words) if lookups.small else words, "query_id"))
    if phrases is not None:
        rows = rows.unionByName(phrases.drop("phrase").join(first, ["query_id", "block"]))
    found = admitted(_summed(rows)).select("query_id", "units", limit.alias("limite"))
    least = first.select("query_id").distinct().join(_kth(found), "query_id", "left").select(
        "query_id", F.coalesce("least", F.lit(0)).alias("least"))
    return durable(_by_query(most, least, lookups).filter("most >= least").select("query_id", "block", "least"))


def divided(lib, lookups: Lookups, chosen: DataFrame) -> DataFrame:
    """The words of each query in each demanded block: `leads` is false for those of the
    smallest bounds that together stay below the score demanded. A document
    without a leading word can't reach it; `rest` is what the others can add."""
    rows = lookups.join_first_token(lib.bounds, _words(lookups), "block")
    bound = score.units(lib, F.col("n"), F.col("weight")) + 1
    rows = rows.withColumn("bound", bound).drop("weight").join(chosen, ["query_id", "block"])
    place = W.partitionBy("query_id", "block")
    rising = place.orderBy("bound", "concept", "phrase").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = rows.withColumn("leads", F.sum("bound").over(rising) >= F.col("least"))
    rest = F.sum(F.when(~F.col("leads"), F.col("bound")).otherwise(0)).over(place)
    return marked.withColumn("rest", rest).drop("bound")


def parts(lib, lookups: Lookups, admitted: Callable[[DataFrame], DataFrame],
           limit: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of the leading words, and those of the others for documents that can still
    reach the score demanded."""
    phrases = _phrases(lib, lookups)
    chosen = demanded(lib, lookups, phrases, admitted, limit)
    words = durable(divided(lib, lookups, chosen))
    leading = _read(lib, lookups, words.filter("leads").select(*_WORD, "block"))
    if phrases is not None:
        leading = leading.unionByName(phrases.drop("phrase").join(chosen, ["query_id", "block"]).drop("least"))
    leading = durable(leading)
    some = durable(leading.groupBy("query_id", "block", "id_tesis").agg(
        F.sum("units").alias("units"), F.first("n_concepts").alias("n_concepts")))
    # With one concept each of these documents matches: its sum so far is a lower bound of
    # its score, and their k-th sum of the k-th score.
    sums = admitted(some.filter("n_concepts = 1").select("query_id", "id_tesis", "units"))
    least = (
        chosen.select("query_id", "least")
        .unionByName(_kth(sums.select("query_id", "units", limit.alias("limite"))))
        .groupBy("query_id").agg(F.max("least").alias("least"))
    )
    # A block in which only phrases are found has no row in `words`.
    rest = words.select("query_id", "block", "rest").distinct()
    able = durable(
        _by_query(some, durable(least), lookups).join(rest, ["query_id", "block"], "left")
        .filter(F.col("units") + F.coalesce("rest", F.lit(0)) >= F.col("least")).select("query_id", "block", "id_tesis"))
    others = words.filter(~F.col("leads")).select(*_WORD, "block")
    completing = _read(lib, lookups, able.join(others, ["query_id", "block"]))
    return leading.join(able, ["query_id", "block", "id_tesis"], "left_semi"), completing


def scored(lib, lookups: Lookups, admitted: Callable[[DataFrame], DataFrame], limit: Column) -> DataFrame:
    """Like `score.scored`, but only of documents that can be among the best `limit` of
    those that `admitted` lets pass. It gets (query_id, id_tesis, units) and
    gives the rows that a query's filters keep, with the columns of `limit`."""
    leading, completing = parts(lib, lookups, admitted, limit)
    return _summed(leading.unionByName(completing))
