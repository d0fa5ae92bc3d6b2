"""The stored library: corpus and index as bucketed Parquet tables.

`save` lays out the corpus once by id (one shuffle); the index is then built
from that table and written with the same bucketing, without another shuffle.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.text import fold
from lexspark.operators import index, substrings
from lexspark.session import durable, one_of, small_rows

PARTITION = "epoca_part"
# Layout of a saved library; a reader refuses another version.
VERSION = 2
# Bytes of text that a task indexes: its postings or pieces, 15 times as many, are sorted in memory.
SHARE = 16 << 20
# Tokens whose impacts a task sorts.
TOKENS = 3_000_000
MANIFEST = "version int, buckets int, pieces boolean, bounds boolean"
_TABLES = {
    # table: (sort columns, partitioned)
    "corpus": (("anio", "id_tesis"), True),
    "postings": (("tok", "id_tesis"), False),
    "doc_stats": (("id_tesis",), False),
    "pieces": (("piece", "campo", "id_tesis"), False),
    "blocks": (("id_tesis",), False),
    "impacts": (("tok", "block"), False),
    "bounds": (("tok", "block"), False),
}
_KEY = {"impacts": "block", "bounds": "block"}  # all others: the id
# Tables that a library can do without.
_OPTIONAL = {"pieces": "pieces", "blocks": "bounds", "impacts": "bounds", "bounds": "bounds"}
# Columns of the index tables, which may have no file; the corpus may have columns of its own.
_COLUMNS = {
    # `first` is for the term statistics only; readers do not see it.
    "postings": "id_tesis string, dl int, col string, tok string, pos array<int>, first boolean",
    "doc_stats": "id_tesis string, dl int, content_hash bigint",
    "pieces": "id_tesis string, campo string, piece string",
    "blocks": "id_tesis string, block bigint",
    "impacts": "block bigint, tok string, id_tesis string, dl int, f_todo int, f_rubro int, f_texto int",
    "bounds": "block bigint, tok string, weight double",
}


@dataclass(frozen=True)
class Library:
    """Handle passed to every query."""

    corpus: DataFrame
    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    # For substrings, and for the best by score; a library can do without.
    pieces: DataFrame | None = None
    blocks: DataFrame | None = None
    impacts: DataFrame | None = None
    bounds: DataFrame | None = None

    @cached_property
    def size(self) -> tuple[int, float]:
        """Documents and mean tokens per document, from the one-row statistics table."""
        row = self.corpus_stats.first()
        return row.n_docs, (row.n_tokens / row.n_docs if row.n_docs else 0.0)

    @staticmethod
    def of(corpus: DataFrame) -> "Library":
        """Index computed on the fly; for small corpora and tests."""
        posts = index.postings(corpus)
        stats = index.doc_stats(corpus, posts)
        return Library(corpus, posts, stats, index.term_stats(posts), index.corpus_stats(stats))

    @staticmethod
    def save(corpus: DataFrame, root: str, buckets: int, pieces: bool = False) -> "Library":
        """Write corpus and index under `root`. Aim for buckets of a few GB. With `pieces`
        substrings are indexed, too: scans and reading by part of a code or title then
        read few criteria."""
        spark = corpus.sparkSession
        write_corpus(corpus, root, buckets)
        write_index(spark, root, buckets)
        if pieces:
            write_pieces(spark, root, buckets)
        _write_manifest(spark, root, buckets, pieces, False)
        return Library.open(spark, root)

    @staticmethod
    def save_bounds(spark: SparkSession, root: str) -> "Library":
        """Add score bounds to a saved library: searches by score then read only what can
        reach the best. For corpora in which a query's words match millions of criteria."""
        from lexspark.operators import bounds  # built on the scores, which read libraries

        lib = Library.open(spark, root)
        layout = spark.read.schema(MANIFEST).json(f"{root}/manifest").first()
        _write(bounds.blocks(lib.doc_stats, layout.buckets), root, "blocks", layout.buckets)
        # Several tasks and files for a bucket that is too large to be sorted by one.
        parts = layout.buckets * max(1, -(-int(lib.size[0] * lib.size[1]) // (TOKENS * layout.buckets)))
        counted = bounds.dealt_impacts(lib.corpus, lib.postings, spark.table(_name(root, "blocks")), parts)
        _write(counted, root, "impacts", layout.buckets)
        _write(bounds.bounds(spark.table(_name(root, "impacts")), lib.size[1]), root, "bounds", layout.buckets)
        _write_manifest(spark, root, layout.buckets, layout.pieces, True)
        return Library.open(spark, root)

    @staticmethod
    def open(spark: SparkSession, root: str) -> "Library":
        """Reopen a saved library, also from another application. Its manifest, written
        last, says how it is laid out."""
        layout = spark.read.schema(MANIFEST).json(f"{root}/manifest").first()
        if layout is None or layout.version != VERSION:
            raise ValueError(f"{root}: no library of version {VERSION}")
        tables = [t for t in _TABLES if t not in _OPTIONAL or layout[_OPTIONAL[t]]]
        for table in tables:
            _register(spark, root, table, layout.buckets)
        return Library(
            spark.table(_name(root, "corpus")),
            spark.table(_name(root, "postings")).drop("first"),
            spark.table(_name(root, "doc_stats")),
            spark.read.parquet(f"{root}/term_stats"),
            spark.read.parquet(f"{root}/corpus_stats"),
            *[spark.table(_name(root, t)) if t in tables else None for t in _OPTIONAL],
        )


class OnDemand(Library):
    """A library under `root` whose tables are written when they are first read: a query that
    reads only criteria waits for no index, a search for no pieces. For one application; once
    `complete` it can be reopened."""

    def __init__(self, corpus: DataFrame, root: str, buckets: int) -> None:
        self.__dict__.update(given=corpus, root=root, buckets=buckets, spark=corpus.sparkSession)

    def _read(self, table: str) -> DataFrame:
        return self.spark.table(_name(self.root, table))

    @cached_property
    def corpus(self) -> DataFrame:
        write_corpus(self.given, self.root, self.buckets)
        return self._read("corpus")

    @cached_property
    def _index(self) -> tuple[DataFrame, ...]:
        self.corpus
        write_index(self.spark, self.root, self.buckets)
        statistics = [self.spark.read.parquet(f"{self.root}/{t}") for t in ("term_stats", "corpus_stats")]
        return self._read("postings").drop("first"), self._read("doc_stats"), *statistics

    postings = property(lambda self: self._index[0])
    doc_stats = property(lambda self: self._index[1])
    term_stats = property(lambda self: self._index[2])
    corpus_stats = property(lambda self: self._index[3])

    @cached_property
    def pieces(self) -> DataFrame:
        self.corpus
        write_pieces(self.spark, self.root, self.buckets)
        return self._read("pieces")

    def complete(self, pieces: bool = True) -> Library:
        """Write what has not been written, and the manifest. Without `pieces` their table is left
        to the first query that reads it; the reopened library has it if it is there."""
        self._index
        if pieces:
            self.pieces
        _write_manifest(self.spark, self.root, self.buckets, "pieces" in self.__dict__, False)
        return Library.open(self.spark, self.root)


def shares(stored: DataFrame, buckets: int) -> int:
    """Tasks that index a corpus: a multiple of the buckets, each with about SHARE of text."""
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in index.INDEXED])
    total = stored.agg(F.sum(size.cast("long"))).first()[0] or 0
    return buckets * max(1, -(-total // (SHARE * buckets)))


def _dealt(stored: DataFrame, columns: tuple[str, ...], parts: int) -> DataFrame:
    """Texts to index, dealt out by id into shares of one bucket each: a task sorts what
    fits into its memory and writes one file, however large the buckets are."""
    return stored.select("id_tesis", *columns).repartition(parts, "id_tesis")


def _write_manifest(spark: SparkSession, root: str, buckets: int, pieces: bool, bounds: bool) -> None:
    layout = spark.createDataFrame([(VERSION, buckets, pieces, bounds)], MANIFEST)
    layout.coalesce(1).write.mode("overwrite").json(f"{root}/manifest")


def rows_of(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of a bucketed table for the ids of a result that is cheap to read again.

    Up to a checked number of ids they are pushed down: only their buckets and
    row groups are read. A larger result is joined.
    """
    ids = small_rows(wanted.select("id_tesis").distinct())
    if ids is None:
        return table.join(wanted.select("id_tesis").distinct(), "id_tesis", "left_semi")
    return table.filter(one_of("id_tesis", [r.id_tesis for r in ids if r.id_tesis is not None]))


def containing(lib: Library, concepts: list[list[str]], columns: tuple[str, ...]) -> DataFrame:
    """The criteria to which a substring test of these terms has still to be applied: those
    that the pieces propose, or all of them if the library has no pieces."""
    ids = None if lib.pieces is None else substrings.proposed(lib.pieces, concepts, columns)
    return lib.corpus if ids is None else rows_of(lib.corpus, durable(ids))


def write_corpus(corpus: DataFrame, root: str, buckets: int) -> None:
    """Corpus partitioned by epoch, bucketed by id, sorted by year and id inside a file.

    Row groups carry narrow min/max statistics on `anio`, so a range of years skips
    most of an epoch; an id is found by its bucket, and by the bloom filters on id and
    code in the footers. The partition value is a copy: an empty `epoca` would come
    back as NULL.
    """
    part = F.coalesce(F.nullif(fold(F.col("epoca")), F.lit("")), F.lit("sin epoca"))
    laid_out = corpus.withColumn(PARTITION, part).repartition(buckets, "id_tesis")
    _write(laid_out, root, "corpus", buckets)


def write_index(spark: SparkSession, root: str, buckets: int) -> None:
    """Postings and statistics of the corpus that is stored under `root`."""
    stored = spark.table(_name(root, "corpus")).drop(PARTITION)
    parts = shares(stored, buckets)
    _write(index.marked_postings(_dealt(stored, index.INDEXED, parts)), root, "postings", buckets)
    _write(index.doc_stats(stored, spark.table(_name(root, "postings"))), root, "doc_stats", buckets)
    # Read by files, not by buckets: grouped by token, they may go to any number of tasks.
    marked = spark.read.schema(_COLUMNS["postings"]).parquet(f"{root}/postings")
    (
        index.marked_term_stats(marked, stored)
        .sortWithinPartitions("tok")
        .write.mode("overwrite").parquet(f"{root}/term_stats")
    )
    (
        index.corpus_stats(spark.table(_name(root, "doc_stats")))
        .coalesce(1).write.mode("overwrite").parquet(f"{root}/corpus_stats")
    )


def write_pieces(spark: SparkSession, root: str, buckets: int) -> None:
    """Three-letter pieces of the corpus that is stored under `root`."""
    stored = spark.table(_name(root, "corpus")).drop(PARTITION)
    _write(substrings.pieces(_dealt(stored, substrings.COLUMNS, shares(stored, buckets))), root, "pieces", buckets)


def _name(root: str, table: str) -> str:
    return f"lex_{hashlib.md5(root.encode()).hexdigest()[:12]}_{table}"


def _write(df: DataFrame, root: str, table: str, buckets: int) -> None:
    sort, partitioned = _TABLES[table]
    writer = df.write.format("parquet").mode("overwrite").option("path", f"{root}/{table}")
    if partitioned:
        writer = writer.partitionBy(PARTITION)
        for key in ("id_tesis", "tesis_codigo"):
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.bucketBy(buckets, _KEY.get(table, "id_tesis")).sortBy(*sort).saveAsTable(_name(root, table))


def _register(spark: SparkSession, root: str, table: str, buckets: int) -> None:
    """Put a written table into the catalog, with its bucketing, in place of an entry
    that may be older than the files; the files stay."""
    name = _name(root, table)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    sort, partitioned = _TABLES[table]
    columns = _COLUMNS.get(table) or ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{root}/{table}").schema)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet "
        + (f"PARTITIONED BY ({PARTITION}) " if partitioned else "")
        + f"CLUSTERED BY ({_KEY.get(table, 'id_tesis')}) SORTED BY ({', '.join(sort)}) INTO {buckets} BUCKETS "
        + f"LOCATION '{root}/{table}'"
    )
    if partitioned:
        spark.catalog.recoverPartitions(name)
