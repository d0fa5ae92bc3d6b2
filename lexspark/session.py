"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows up to which a query table (or its ranked result) counts as small enough
# to be broadcast or turned into a pushed-down IN list. Checked, never assumed.
SMALL_ROWS = 20_000


def builder(app_name: str = "lexspark") -> SparkSession.Builder:
    """Settings this library is tuned for; any session works."""
    return (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Checkpoint files go when nothing refers to them any more.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Tables bucketed by id stay in place when joined on the id and more.
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # More than the default 10 tokens of a query reach Parquet as an IN list.
        .config("spark.sql.parquet.pushdown.inFilterThreshold", "500")
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local master may fall back to a temporary folder (tests, notebooks).
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
        named = tempfile.mkdtemp(prefix="run-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder, so that later reads neither
    recompute the plan nor depend on a single executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_rows(df: DataFrame, limit: int = SMALL_ROWS) -> list | None:
    """The rows if there are at most `limit` of them, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def local_table(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """A few rows as a relation held in the plan; no task has to produce them."""
    columns = to_arrow_schema(schema)
    arrays = [pa.array([r[n] for r in rows], f.type) for n, f in enumerate(columns)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=columns), schema)


def one_of(column: str, values: list[str]) -> Column:
    """`column IN (values)` as one parsed expression; thousands of values stay cheap to build."""
    if not values:
        return F.lit(False)
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"`{column}` in ({quoted})")
