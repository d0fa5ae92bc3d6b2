"""What the operators share: stored tables, global order, document columns, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.session import shared_dir

# The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Arrow batches handed back to Spark hold about this many bytes.
BATCH_BYTES = 4 << 20
# monotonically_increasing_id(): partition in the upper bits, row in the lower 33.
ROW_BITS = 33
# See spread_join().
HEAVY, SALTS = 1000, 64


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application on the storage that all executors share."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/lexspark/{app}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to shared storage and read back: later reads neither recompute
    the plan nor depend on an executor, and Spark knows the table's size."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what this application has stored; results not yet read become unreadable."""
    root = spark._jvm.org.apache.hadoop.fs.Path(
        f"{shared_dir(spark)}/lexspark/{spark.sparkContext.applicationId}")
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, name: str, column: str = "row") -> DataFrame:
    """`df`, stored, with a gapless 0-based number in the order of its partitions.

    A partition's first number is the sum of the counts before it (one row per
    partition, so that table is small at any size).
    """
    placed = stored(df.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", ROW_BITS)
    firsts = (
        placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    )
    return (
        placed.withColumn("_part", part).join(F.broadcast(firsts), "_part")
        .withColumn(column, F.col("_first") + F.col("_at").bitwiseAND((1 << ROW_BITS) - 1))
        .drop("_part", "_first", "_at")
    )


def ordered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows with their 0-based `rank` in the order of `keys`.

    Rows are dealt by ranges of all keys, so that a frequent value of the first
    key is spread as long as a later one tells its rows apart. No task sees more
    than its range.
    """
    dealt = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    return numbered(dealt, name, "rank")


def spread_join(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of `many` with `few`, which has one row per `key` and, as `n`, the
    number of rows of `many` that have it.

    Keys with more than one row in HEAVY, of which there are less than HEAVY, are named
    in the plan; their rows are dealt out over SALTS by `by`, and their one row of
    `few` is copied as often. A key with a third of all rows is spread that way.
    """
    total = few.agg(F.sum("n")).first()[0] or 0
    heavy = (F.col("n") * HEAVY > total) & (F.col("n") > SALTS)
    hot = [r[0] for r in few.where(heavy).select(key).collect()]
    if not hot:
        return many.join(few.drop("n"), key)
    salts = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = few.withColumn("_salt", F.explode(salts)).drop("n")
    dealt = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)
    return many.withColumn("_salt", dealt).join(copies, [key, "_salt"]).drop("_salt")


def key_of_line(line: Column) -> Column:
    """A line without blanks at both ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def batches(rows: Iterator[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about BATCH_BYTES; weigh(row) is a row's size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row) + 64
        if size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def kept_columns(df: DataFrame, keep: list[str] | None, made: list[str]) -> tuple[list[str], str]:
    """Columns that an operator hands through (all of `df` if None), without those it
    makes itself, and their schema as DDL."""
    names = [c for c in (df.columns if keep is None else keep) if c not in made]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return names, ", ".join(f"`{c}` {kinds[c]}" for c in names)


def with_columns(batch: pa.RecordBatch, keep: list[str], compute, made: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The batch's kept columns and those of compute(text), a few rows at a time."""
    for at in range(0, batch.num_rows, 512):
        part = batch.slice(at, 512)
        columns = list(zip(*[compute(t.as_py()) for t in part.column("text")], strict=True))
        yield pa.RecordBatch.from_arrays(
            [*[part.column(c) for c in keep], *[pa.array(c, f.type) for c, f in zip(columns, made, strict=True)]],
            names=[*keep, *made.names])


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int | None, str | None]]:
    """(doc_id, text) of a batch, one Python string at a time."""
    for n, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
        yield n.as_py(), t.as_py()


def components(links: DataFrame) -> DataFrame:
    """Connected components of `links` (a, b: long): `node`, `root` (smallest node),
    one row per node that has a link; links to itself are ignored.

    Alternates large-star and small-star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond") until nothing changes. Every step is
    joins and aggregations of the link table, stored each time; the driver sees
    a count and a checksum. The joins are plain sort-merge joins, whose large
    partitions Spark splits: the hub of a huge component does not sit in one task.
    """
    pairs = lambda df: df.where("a <> b").distinct()
    edges = stored(pairs(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if not state[0] or state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = pairs(both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        edges = stored(pairs(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(lowest.withColumnRenamed("m", "b"))), "links")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
