"""Incremental load: landed JSON replies into a versioned store, batch or stream.

A batch only ever *adds* files: its criteria, their postings, counts and one log
row go to directories of their own, and one file of the commit log, written last,
publishes them together. Whoever reads takes the log's state once and sees whole
batches only, also while a load runs or after it broke off; a load that is tried
again writes anew. Any earlier version of the log can be read.

Readers take the newest version of each criterion, and postings of that version.
The batches may continue a saved library, which is read as it is, less the
criteria they replace; its statistics are corrected by counting only what went
and what came. `compact` folds all into a new library.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.operators import index
from lexspark.plans import profile
from lexspark.sources import landing
from lexspark.sources.schema import LANDED, TESIS
from lexspark.sources.tables import Library

BATCH = "batch"
NEW_ONLY, UPSERT = "new_only", "upsert"
_POSTINGS = T.StructType(
    [
        T.StructField("id_tesis", T.StringType()), T.StructField("dl", T.IntegerType()),
        T.StructField("col", T.StringType()), T.StructField("tok", T.StringType()),
        T.StructField("pos", T.ArrayType(T.IntegerType())),
    ]
)
_LOG = T.StructType(
    [
        T.StructField("nuevas", T.LongType()), T.StructField("errores", T.LongType()),
        T.StructField("total", T.LongType()), T.StructField("estado", T.StringType()),
        T.StructField("fecha", T.TimestampType()),
    ]
)
_TAKEN = f"stream string, epoch long, {BATCH} long"


#: One row for each table of a batch; the files of one commit appear together.
_COMMIT = f"version long, {BATCH} long, part string, attempt string"
_COUNTS = T.StructType(
    [
        T.StructField("campo", T.StringType()), T.StructField("valor", T.StringType()),
        T.StructField("total", T.LongType()), T.StructField("ultima", T.TimestampType()),
    ]
)


@dataclass(frozen=True)
class Store:
    """Versioned corpus, postings, rejects, counts and run log under one shared folder.

    `version`: the commit to read at; by default the newest. `pinned`: the commits
    of a state that is read several times.
    """

    spark: SparkSession
    root: str
    mode: str = NEW_ONLY
    base: Library | None = None
    version: int | None = None
    pinned: tuple | None = None

    # -- reading ------------------------------------------------------------

    def at(self, version: int) -> "Store":
        """The store as it was when commit `version` was written."""
        return replace(self, version=version, pinned=None)

    def now(self) -> "Store":
        """This store with the commits that are there now: all its tables are of one state."""
        return replace(self, pinned=tuple(self._commits()))

    def versions(self) -> DataFrame:
        """version, batch: the commits, one row each."""
        log = self._read(f"{self.root}/commits", _COMMIT, "json")
        return log.groupBy("version").agg(F.max(F.when(F.col("part") == "corpus", F.col(BATCH))).alias(BATCH))

    def _read(self, path: str, schema, kind: str = "parquet") -> DataFrame:
        try:
            return self.spark.read.schema(schema).format(kind).load(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _commits(self) -> list:
        """Rows of the log, a few for each batch."""
        if self.pinned is not None:
            return list(self.pinned)
        log = self._read(f"{self.root}/commits", _COMMIT, "json")
        return (log if self.version is None else log.where(F.col("version") <= self.version)).collect()

    def _folders(self, table: str) -> dict[int, str]:
        """The folder that holds each batch's part of a table."""
        rows = sorted((r.version, r[BATCH], r.attempt) for r in self._commits() if r.part == table)
        return {batch: self._folder(table, batch, attempt) for _, batch, attempt in rows}

    def _folder(self, table: str, batch: int, attempt: str) -> str:
        return f"{self.root}/{table}/{BATCH}={batch}/attempt={attempt}"

    def _versions(self, table: str, schema: T.StructType) -> DataFrame:
        full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
        folders = self._folders(table)
        if not folders:
            return self.spark.createDataFrame([], full)
        reader = self.spark.read.schema(full).option("basePath", f"{self.root}/{table}")
        return reader.parquet(*folders.values()).select(*full.names)

    def _added(self) -> DataFrame:
        """Newest version of each criterion the batches brought."""
        return landing.latest(self._versions("corpus", TESIS), [F.col(BATCH)])

    def _less_changed(self, table: DataFrame, changed: DataFrame) -> DataFrame:
        # The changed ids are the few: the base table stays in its buckets.
        return table.join(changed.select("id_tesis").distinct(), "id_tesis", "left_anti")

    def corpus(self) -> DataFrame:
        self = self.now()
        added = self._added().drop(BATCH)
        if self.base is None:
            return added
        return self._less_changed(self.base.corpus.select(*TESIS.names), added).unionByName(added)

    def _added_postings(self) -> DataFrame:
        newest = self._versions("corpus", TESIS).groupBy("id_tesis").agg(F.max(BATCH).alias(BATCH))
        return self._versions("postings", _POSTINGS).join(
            newest, ["id_tesis", BATCH], "left_semi"
        ).drop(BATCH)

    def postings(self) -> DataFrame:
        """Postings of the newest version of each criterion."""
        self = self.now()
        added = self._added_postings()
        if self.base is None:
            return added
        return self._less_changed(self.base.postings, self._added()).unionByName(added)

    def library(self) -> Library:
        """The current state as a library to search."""
        self = self.now()
        added, posts = self._added().drop(BATCH), self._added_postings()
        stats = index.doc_stats(added, posts)
        if self.base is None:
            return Library(added, posts, stats, index.term_stats(posts), index.corpus_stats(stats))
        base = self.base
        gone = base.doc_stats.join(added.select("id_tesis"), "id_tesis", "left_semi")
        gone_posts = base.postings.join(added.select("id_tesis"), "id_tesis", "left_semi")
        return Library(
            self.corpus(),
            self.postings(),
            self._less_changed(base.doc_stats, added).unionByName(stats),
            index.merge_counts(base.term_stats, index.term_stats(gone_posts), index.term_stats(posts)),
            index.merge_counts(base.corpus_stats, index.corpus_stats(gone), index.corpus_stats(stats)),
        )

    def run_log(self) -> DataFrame:
        return self._versions("run_log", _LOG)

    def rejects(self) -> DataFrame:
        return self._versions("rejects", LANDED).drop(BATCH)

    def counts(self) -> DataFrame:
        """campo, valor, total, ultima: how often each value of a counted field occurs now,
        from the counts that each batch left, without reading the corpus."""
        self = self.now()
        rows = self._versions("counts", _COUNTS).drop(BATCH)
        return profile.merged_counts(rows if self.base is None else rows.unionByName(self._base_counts()))

    def _base_counts(self) -> DataFrame:
        """The counts of the library that the batches continue, made once."""
        path = f"{self.root}/counts_base"
        try:
            return self.spark.read.schema(_COUNTS).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        profile.kept_counts(self.base.corpus).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(_COUNTS).parquet(path)

    # -- writing ------------------------------------------------------------

    def load(self, replies: DataFrame, batch: int) -> None:
        """One batch of replies: reject, normalise, keep what is new, index, count, log.

        A number may be loaded again, which replaces that batch, but not one that a
        stream has taken. Nothing of a batch is seen before all of it is written.
        """
        if not self._taken().filter(F.col(BATCH) == batch).isEmpty():
            raise ValueError(f"batch {batch} belongs to a stream")
        self._load(replies, batch)

    def _load(self, replies: DataFrame, batch: int) -> None:
        attempt = uuid.uuid4().hex
        old = self.now()
        before = old._ids_before(batch)
        incoming = landing.latest(
            landing.normalized(replies),
            [F.col("fecha_descarga"), F.xxhash64(*[c for c in TESIS.names if c != "fecha_descarga"])],
        )
        if self.mode == NEW_ONLY:
            fresh = landing.new_ids(incoming.select("id_tesis"), before)
            incoming = incoming.join(fresh, "id_tesis", "left_semi").select(*TESIS.names)
        self._add(landing.run_log(replies, before).withColumn("fecha", F.current_timestamp()), "run_log", batch, attempt)
        self._add(landing.rejects(replies), "rejects", batch, attempt)
        self._add(incoming, "corpus", batch, attempt)
        written = self.spark.read.schema(TESIS).parquet(self._folder("corpus", batch, attempt))
        self._add(index.postings(written), "postings", batch, attempt)
        parts = [(batch, t) for t in ("run_log", "rejects", "corpus", "postings")]
        # What a batch replaces depends on those before it: later ones are counted anew.
        planned = {**old._folders("corpus"), batch: self._folder("corpus", batch, attempt)}
        for n in sorted(n for n in planned if n >= batch):
            self._add(self._change(planned, n), "counts", n, attempt)
            parts.append((n, "counts"))
        self._commit(parts, attempt)

    def _change(self, folders: dict[int, str], batch: int) -> DataFrame:
        """Counts of a batch's criteria, less those of the versions that they replace."""
        read = lambda n: self.spark.read.schema(TESIS).parquet(folders[n])
        new, ids = read(batch), read(batch).select("id_tesis")
        earlier = [read(n).withColumn(BATCH, F.lit(n).cast("long")) for n in folders if n < batch]
        if self.base is not None:
            earlier.append(self.base.corpus.select(*TESIS.names).withColumn(BATCH, F.lit(-1).cast("long")))
        counted = profile.kept_counts(new)
        if earlier:
            stored = reduce(DataFrame.unionByName, [e.join(ids, "id_tesis", "left_semi") for e in earlier])
            gone = profile.kept_counts(landing.latest(stored, [F.col(BATCH)]))
            counted = profile.merged_counts(counted.unionByName(gone.withColumn("total", -F.col("total"))), all_rows=True)
        return counted

    def _commit(self, parts: list[tuple[int, str]], attempt: str) -> None:
        """Publish what has been written: one new file of the log, which appears whole."""
        last = max((r.version for r in replace(self, version=None, pinned=None)._commits()), default=0)
        rows = [(last + 1, batch, part, attempt) for batch, part in parts]
        self.spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("append").json(f"{self.root}/commits")

    def _ids_before(self, batch: int) -> DataFrame:
        """Ids stored before this batch, also when the batch is retried."""
        ids = self._versions("corpus", TESIS).filter(F.col(BATCH) < batch).select("id_tesis").distinct()
        if self.base is None:
            return ids
        return self._less_changed(self.base.corpus.select("id_tesis"), ids).unionByName(ids)

    def _add(self, df: DataFrame, table: str, batch: int, attempt: str) -> None:
        df.write.parquet(self._folder(table, batch, attempt))

    def _taken(self) -> DataFrame:
        """Batch numbers that streams have taken: stream, epoch, batch."""
        return self._read(f"{self.root}/streams", _TAKEN, "json")

    def _number(self, stream: str, epoch: int) -> int:
        """The store's number of a stream's micro-batch: the next free one, noted before
        anything is written, so that a repeated micro-batch finds its own again."""
        taken = self._taken()
        own = taken.filter((F.col("stream") == stream) & (F.col("epoch") == epoch)).first()
        if own is not None:
            return own.batch
        known = taken.select(BATCH).unionByName(self._versions("run_log", _LOG).select(BATCH))
        number = (known.agg(F.max(BATCH)).first()[0] or 0) + 1
        self.spark.createDataFrame([(stream, epoch, number)], _TAKEN).coalesce(1).write.mode("append").json(f"{self.root}/streams")
        return number

    def follow(self, landed: str, checkpoint: str):
        """Load every file in `landed` not seen before, then stop.

        A stream is known by the id in its checkpoint folder. Several streams, one after
        the other, and loads may fill the same store; none replaces another's batches.
        One writer at a time.
        """
        replies = self.spark.readStream.schema(LANDED).json(landed)

        def each(df: DataFrame, epoch: int) -> None:
            stream = self.spark.read.json(f"{checkpoint}/metadata").first().id
            self._load(df, self._number(stream, epoch))

        return (
            replies.writeStream.foreachBatch(each)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def compact(self, target: str, buckets: int) -> Library:
        """Write the current corpus as a saved library in a new folder."""
        return Library.save(self.corpus().select(*TESIS.names), target, buckets)
