"""Positional full-text index over four corpus columns, as ordinary tables.

The index is laid out by *document*, not by token: all postings of a criterion
live in the bucket of its id. Phrase, proximity, concept and score steps group
by id, so on the stored index none of them shuffles, and a token found in most
documents spreads evenly over all buckets instead of filling one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import tokens
from lexspark.session import durable, small_rows

INDEXED = ("rubro", "texto", "precedentes", "materias")
# Tokens that are sorted at once, and rows that are handed on at once.
_CHUNK, _ROWS = 1 << 20, 1 << 17


def tokenized(corpus: DataFrame, *kept: str) -> DataFrame:
    """One row per document: tokens of each indexed column and their total `dl`, with kept columns."""
    columns = corpus.select("id_tesis", *kept, *[tokens(F.col(c)).alias(c) for c in INDEXED])
    total = reduce(lambda a, b: a + b, [F.size(c) for c in INDEXED])
    return columns.withColumn("dl", total)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Tokenized documents, so many at once that their tokens are sorted in memory, in the order
    of their ids, and the tokens of each in each column."""
    for batch in batches:
        batch = batch.sort_by([("id_tesis", "ascending")])
        sizes = [np.asarray(pc.list_value_length(batch[c])).astype(np.int64) for c in INDEXED]
        ends = np.cumsum(sum(sizes))
        begin = 0
        while begin < len(batch):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + _CHUNK, "right")))
            some, counts = batch.slice(begin, end - begin), [n[begin:end] for n in sizes]
            begin = end
            if any(n.any() for n in counts):
                yield some, counts


def fields(counts: list[np.ndarray]) -> np.ndarray:
    """Of each token, column after column, its document and column as one number."""
    rows = np.arange(len(counts[0])) * len(INDEXED)
    return np.concatenate([np.repeat(rows + c, n) for c, n in enumerate(counts)])


def numbered(some: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """The number of each token, column after column, and the distinct tokens in their order."""
    toks = pa.concat_arrays([some[c].flatten() for c in INDEXED]).dictionary_encode()
    order = pc.sort_indices(toks.dictionary)
    number = np.empty(len(order), np.int64)
    number[np.asarray(order)] = np.arange(len(order))
    return number[np.asarray(toks.indices)], toks.dictionary.take(order)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings from the tokens of whole documents, in runs sorted by token and id."""
    for some, counts in chunks(batches):
        # A token's place: its document and column, and its position there.
        field = fields(counts)
        pos = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in counts])
        number, toks = numbered(some)
        # Token, place and position in one integer: (2**20 * 10000 * 4 * 2**20, or one document's) fits.
        width, positions = len(some) * len(INDEXED), int(pos.max()) + 1
        key = np.sort((number * width + field) * positions + pos)
        run, pos = np.divmod(key, positions)
        opens = np.flatnonzero(np.diff(run, prepend=-1))
        tok, field = np.divmod(run[opens], width)
        row, col = np.divmod(field, len(INDEXED))
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(opens, len(run)), pa.int32()), pa.array(pos, pa.int32()))
        first = np.diff(tok * len(some) + row, prepend=-1) != 0
        kept = some.schema.names[2 + len(INDEXED):]
        made = pa.RecordBatch.from_arrays([
            some["id_tesis"].take(pa.array(row)), some["dl"].take(pa.array(row)), pa.array(INDEXED).take(pa.array(col)),
            toks.take(pa.array(tok)), lists, pa.array(first), *[some[c].take(pa.array(row)) for c in kept]],
            ["id_tesis", "dl", "col", "tok", "pos", "first", *kept])
        yield from (made.slice(n, _ROWS) for n in range(0, len(made), _ROWS))


def postings(corpus: DataFrame) -> DataFrame:
    """One row per (document, column, token) with its sorted positions.

    Each task cuts the tokens of its documents into runs of one token, many documents at
    once, so no row per occurrence is ever made, shuffled or spilled.
    """
    return marked_postings(corpus).drop("first")


def marked_postings(corpus: DataFrame, *kept: str) -> DataFrame:
    """Postings with `first`: whether a row is the first of its token in a row of the corpus,
    and with the kept columns of that row."""
    kinds = "".join(f", {c} {corpus.schema[c].dataType.simpleString()}" for c in kept)
    return tokenized(corpus, *kept).select("id_tesis", "dl", *INDEXED, *kept).mapInArrow(
        _runs, f"id_tesis string, dl int, col string, tok string, pos array<int>, first boolean{kinds}")


def content_hash() -> Column:
    """Fingerprint of the indexed text, to see when the index is stale."""
    return F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in INDEXED])


def doc_stats(corpus: DataFrame, posts: DataFrame) -> DataFrame:
    """Tokens per document over all four columns, documents without tokens included.

    The lengths come from the postings; both sides are co-located when stored.
    """
    lengths = posts.groupBy("id_tesis").agg(F.max("dl").alias("dl"))
    hashed = corpus.select("id_tesis", content_hash().alias("content_hash"))
    return hashed.join(lengths, "id_tesis", "left").select(
        "id_tesis", F.coalesce("dl", F.lit(0)).alias("dl"), "content_hash"
    )


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: number of documents and of tokens."""
    return stats.agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens")
    )


def term_stats(posts: DataFrame) -> DataFrame:
    """Documents per token: in any column, in the title, in the body.

    The inner group is per document (no shuffle on the stored index); the outer
    one is pre-aggregated before its shuffle, so a frequent token arrives as one
    row per partition.
    """
    per_document = posts.groupBy("tok", "id_tesis").agg(
        F.max(F.when(F.col("col") == "rubro", 1).otherwise(0)).alias("in_rubro"),
        F.max(F.when(F.col("col") == "texto", 1).otherwise(0)).alias("in_texto"),
    )
    return per_document.groupBy("tok").agg(
        F.count("*").alias("df"),
        F.sum("in_rubro").alias("df_rubro"),
        F.sum("in_texto").alias("df_texto"),
    )


def marked_term_stats(marked: DataFrame, corpus: DataFrame) -> DataFrame:
    """term_stats() from marked postings of `corpus`, which are grouped by token alone: no
    group per token and document, of which there are as many as postings, has to be held or spilled.

    A document is counted at its first row of a token. Only of ids that the corpus holds
    several times (NULL is one, too) the postings are grouped by document.
    """
    repeated = durable(corpus.groupBy("id_tesis").agg(F.count("*").alias("n")).where("n > 1").select("id_tesis"))
    several = [] if not repeated.head(1) else [F.broadcast(repeated) if small_rows(repeated) is not None else repeated]
    once = reduce(lambda m, ids: m.join(ids, m.id_tesis.eqNullSafe(ids.id_tesis), "left_anti"), several, marked)
    counted = once.groupBy("tok").agg(
        F.count_if("first").alias("df"),
        F.count_if(F.col("col") == "rubro").alias("df_rubro"),
        F.count_if(F.col("col") == "texto").alias("df_texto"),
    )
    if not several:
        return counted
    rest = marked.join(several[0], marked.id_tesis.eqNullSafe(several[0].id_tesis), "left_semi")
    return counted.unionByName(term_stats(rest)).groupBy("tok").agg(
        *[F.sum(c).alias(c) for c in ("df", "df_rubro", "df_texto")])


def merge_counts(stats: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Statistics after some documents went and others came, from the three counts alone.

    For term statistics (keyed by tok) and corpus statistics (one row).
    """
    keys = [c for c in stats.columns if c == "tok"]
    counts = [c for c in stats.columns if c not in keys]
    negative = removed.select(*keys, *[(-F.col(c)).alias(c) for c in counts])
    merged = (
        stats.unionByName(negative).unionByName(added)
        .groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
    )
    return merged.filter("df > 0") if keys else merged


def refresh_postings(posts: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings after `changed` criteria (new or replaced, whole rows) came in."""
    kept = posts.join(changed.select("id_tesis"), "id_tesis", "left_anti")
    return kept.unionByName(postings(changed))
