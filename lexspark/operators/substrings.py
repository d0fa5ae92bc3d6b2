"""Which documents can contain a substring: an index of three-letter pieces.

For each document and column the pieces are the distinct runs of three letters of the
folded text, with two blanks put behind it. A text that contains a needle has all pieces
of the needle; a needle of one or two letters begins a piece. So the pieces propose
documents, never too few, and the substring test decides about them.

The table lies in the buckets of the corpus, sorted by piece: a needle reads few row
groups of it, groups without a shuffle, and then reads only the proposed criteria.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.functions.text import fold
from lexspark.session import local_table, one_of

LETTERS = 3
COLUMNS = ("rubro", "texto", "tesis_codigo")
_TABLE = "id_tesis string, campo string, piece string"
# Letters that are cut at once, and rows that are handed on at once.
_CHUNK, _ROWS = 1 << 22, 1 << 18
_WANTED = T.StructType([
    T.StructField("n", T.IntegerType()), T.StructField("pieces", T.IntegerType()), T.StructField("piece", T.StringType())])


def _cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Each piece of each text once, as (number of the piece, number of the text), sorted by
    both, and the pieces themselves in order."""
    lengths = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    if len(codes) < LETTERS:
        return np.empty(0, np.int64), np.empty(0, np.int64), []
    # Letters are numbered in order, so that a piece and its text fit into one integer.
    used = np.flatnonzero(np.bincount(codes))
    number = np.zeros(used[-1] + 1, np.int64)
    number[used] = np.arange(len(used))
    letters, text = number[codes], np.repeat(np.arange(len(texts)), lengths)
    key = letters[:-2] * len(used) + letters[1:-1]
    key = (key * len(used) + letters[2:]) * len(texts) + text[:-2]
    key = np.sort(key[text[:-2] == text[2:]])
    key = key[np.diff(key, prepend=-1) != 0]
    piece, text = np.divmod(key, len(texts))
    opens = np.diff(piece, prepend=-1) != 0
    held = piece[opens]
    spelled = np.stack([held // len(used) ** 2, held // len(used) % len(used), held % len(used)], axis=1)
    joined = used[spelled].astype("<u4").tobytes().decode("utf-32-le")
    return np.cumsum(opens) - 1, text, [joined[i:i + LETTERS] for i in range(0, len(joined), LETTERS)]


def _of(term: str) -> list[str]:
    return _cut([term])[2]


def _chunks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows with so many letters at most (or one row)."""
    begin = total = 0
    for n, length in enumerate(lengths):
        if n > begin and total + length > _CHUNK:
            yield begin, n
            begin, total = n, 0
        total += length
    if lengths:
        yield begin, len(lengths)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the table from ids and folded texts, sorted as the table is in long runs."""
    names = sorted(COLUMNS)
    for batch in batches:
        batch = batch.sort_by([("id_tesis", "ascending")])
        ids, texts = batch["id_tesis"], [batch[c].to_pylist() for c in names]
        for begin, end in _chunks([sum(map(len, row)) for row in zip(*texts)]):
            some = [t for column in texts for t in column[begin:end]]
            # So many different letters that a piece and its text do not fit: text by text.
            fits = len(set().union(*some)) ** LETTERS * len(some) < 2**63
            for first, group in [(0, some)] if fits else [(n, [t]) for n, t in enumerate(some)]:
                piece, text, pieces_ = _cut(group)
                campo, row = np.divmod(text + first, end - begin)
                table = pa.RecordBatch.from_arrays([
                    ids.take(pa.array(row + begin)), pa.array(names).take(pa.array(campo)),
                    pa.array(pieces_, pa.string()).take(pa.array(piece))], ["id_tesis", "campo", "piece"])
                yield from (table.slice(n, _ROWS) for n in range(0, len(table), _ROWS))


def pieces(corpus: DataFrame) -> DataFrame:
    """id_tesis, campo, piece: each piece of each column once. NULL text has none but the
    blanks' (which no needle asks for: needles are stripped or longer)."""
    padded = [F.concat(fold(F.coalesce(F.col(c), F.lit(""))), F.lit(" " * (LETTERS - 1))).alias(c) for c in COLUMNS]
    return corpus.select("id_tesis", *padded).mapInArrow(_rows, _TABLE)


def proposed(table: DataFrame, concepts: list[list[str]], columns: tuple[str, ...]) -> DataFrame | None:
    """id_tesis of the documents that can hold a term of every concept in one of the
    columns, from their pieces; None if every document can (no term restricts any)."""
    spark = table.sparkSession
    terms = [(c, term) for c, concept in enumerate(concepts) for term in concept]
    given = local_table(spark, [{0: n, 1: t} for n, (_, t) in enumerate(terms)], T.StructType([
        T.StructField("n", T.IntegerType()), T.StructField("term", T.StringType())]))
    folded = given.select("n", fold(F.col("term")).alias("term"))
    split = {r.n: r.term for r in folded.collect()}
    # A concept with an empty term, or with none, is no condition that pieces can test.
    open_ = {c for n, (c, _) in enumerate(terms) if not split[n]}
    tested = [c for c, concept in enumerate(concepts) if concept and c not in open_]
    if not tested:
        return None
    searched = table.where(F.col("campo").isin(*columns))
    asked = {n: _of(split[n]) for n, (c, _) in enumerate(terms) if c in tested}
    found = []
    long = [{0: n, 1: len(held), 2: p} for n, held in asked.items() for p in held]
    if long:
        some = searched.where(one_of("piece", sorted({r[2] for r in long})))
        found.append(
            some.join(F.broadcast(local_table(spark, long, _WANTED)), "piece")
            .groupBy("id_tesis", "campo", "n").agg(F.count("*").alias("held"), F.first("pieces").alias("pieces"))
            .where("held = pieces").select("id_tesis", "n"))
    for n, held in asked.items():
        if not held:
            found.append(searched.where(F.col("piece").startswith(split[n])).select("id_tesis", F.lit(n).alias("n")))
    concept = F.element_at(F.array(*[F.lit(c) for c, _ in terms]), F.col("n") + 1)
    every = reduce(DataFrame.unionByName, found).select("id_tesis", concept.alias("concept"))
    return every.groupBy("id_tesis").agg(F.countDistinct("concept").alias("held")).where(
        F.col("held") == len(tested)).select("id_tesis")
