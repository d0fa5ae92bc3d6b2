"""Whitened embeddings by distributed block matrices.

The centred rows become an IndexedRowMatrix and its blocks; the blocks' product with
their own transpose is the scatter, one small matrix that is decomposed on the driver;
the product with the whitening matrix projects the rows. Rows never leave the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import numbered, partitions, stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows of a block.
ROWS = 1024
#: Components whose variance is at most this share of the largest one's have no direction
#: that doubles can tell.
FLAT = 1e-12
# Whole numbers up to here are exact as doubles.
EXACT = 1 << 53


@dataclass(frozen=True)
class Whitening:
    """What was learned from the fit list; `directions` has a column per component."""

    n: int
    sums: tuple[int, ...]
    low: tuple[int, ...]
    high: tuple[int, ...]
    variances: np.ndarray
    directions: np.ndarray
    trace: float
    identity_error: float | None


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x: floor(SCALE * c) + SHIFT of each component c, as double. Null vectors and
    those with a null, NaN or infinite component are left out. A component so large that
    its x is no exact double fails the job."""
    c = F.col("embedding").cast("array<double>")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.floor(v * SCALE)
    told = F.raise_error(F.lit(f"an embedding's component is beyond {EXACT // SCALE // 2}"))
    x = F.transform(c, lambda v: F.when(F.abs(v) * SCALE * 2 < EXACT, whole(v) + SHIFT).otherwise(told.cast("long")))
    return vectors.where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long"), x.alias("x"))


def _matrix(rows: DataFrame, n: int, sums: tuple[int, ...], whole: int) -> BlockMatrix:
    """`rows` (row: 0-based and gapless, x) less the mean sums / whole, in blocks of ROWS rows."""
    mean = F.array(*[F.lit(s / whole) for s in sums])
    centred = array_to_vector(F.zip_with("x", mean, lambda v, m: v - m)).alias("vector")
    named = MLUtils.convertVectorColumnsFromML(rows.select(F.col("row").alias("index"), centred), "vector")
    return IndexedRowMatrix(named, n, len(sums)).toBlockMatrix(ROWS, max(1, len(sums)))


def _product(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a * b whose blocks meet in `splits` tasks for each block of the result. Without it
    a scatter, being one block, would be multiplied and summed in a single task."""
    made = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, a.rowsPerBlock, b.colsPerBlock)


def _local(spark, values: np.ndarray) -> BlockMatrix:
    n, k = values.shape
    block = DenseMatrix(n, k, values.ravel(order="F").tolist())
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), n, k)


def _scatter(blocks: BlockMatrix, splits: int) -> np.ndarray:
    return _product(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()


def _rows(blocks: BlockMatrix) -> DataFrame:
    """row, values (array<double>) of a matrix, without a Python worker."""
    found = callMLlibFunc("getIndexedRows", blocks.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return found.toDF("row", "vector").select("row", vector_to_array("vector").alias("values"))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct x of `vectors`; None without one, or of empty ones. All vectors must
    have as many components. Each variance is an eigenvalue of the covariance of x
    (divisor: their number); at most `components` are kept, the largest first."""
    spark = vectors.sparkSession
    splits = partitions(spark)
    distinct = stored(vectors.select("x").distinct(), "distinct")
    sizes = [r[0] for r in distinct.select(F.size("x")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} components")
    if not sizes or not sizes[0]:
        return None
    of = lambda f: [f(F.element_at("x", i + 1)) for i in range(sizes[0])]
    total = lambda c: F.sum(c.cast("decimal(20,0)"))
    row = distinct.agg(F.count(F.lit(1)), F.array(*of(total)), F.array(*of(F.min)), F.array(*of(F.max))).first()
    n, sums = row[0], tuple(int(s) for s in row[1])
    blocks = _matrix(numbered(distinct, "rows"), n, sums, n)
    covariance = _scatter(blocks, splits) / n
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1][:components]
    values, directions = np.maximum(values[order], 0.0), directions[:, order]
    told = values > FLAT * max(values[0], 1e-300)
    error = None
    if told.any():
        made = _product(blocks, _local(spark, directions[:, told] / np.sqrt(values[told])), splits)
        means = np.array(_rows(made).agg(*[F.avg(F.element_at("values", i + 1)) for i in range(int(told.sum()))]).first())
        spread = _scatter(made, splits) / n - np.outer(means, means)
        error = float(np.abs(spread - np.eye(int(told.sum()))).max())
    return Whitening(n, sums, tuple(row[2]), tuple(row[3]), values, directions, float(np.trace(covariance)), error)


def _deviation(model: Whitening) -> Column:
    """sum((n * x - sum) ** 2) as an exact long; null if it doesn't fit one."""
    sides = zip(model.low, model.high, model.sums, strict=True)
    most = sum(max(abs(model.n * a - s), abs(model.n * b - s)) ** 2 for a, b, s in sides)
    largest = max(most, *[model.n * max(abs(a), abs(b)) for a, b in zip(model.low, model.high, strict=True)])
    if largest >= 10 ** 38:
        return F.lit(None).cast("long")
    kind = "long" if largest < 1 << 63 else "decimal(38,0)"
    sums = F.array(*[F.lit(str(s)).cast(kind) for s in model.sums])
    away = F.zip_with("x", sums, lambda x, s: (F.lit(model.n).cast(kind) * x - s).cast(kind))
    whole = F.aggregate(away, F.lit(0).cast(kind), lambda a, d: (a + d * d).cast(kind))
    return whole if kind == "long" else whole.try_cast("long")


_RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1, by falling variance), n, deviation, whitened, explained,
    identity_error for each usable row of `vectors` (vec_id, embedding; other columns are
    not read) and each component.

    Rows with a null vector, or a null, NaN or infinite component, give nothing; a null
    vec_id stays null; rows that are equal in all columns are rows of their own, while the
    whitening is fitted on each distinct x once, so a vector that a third of all rows hold
    weighs as any other. Vectors of different lengths raise ValueError. A component
    without variance (a constant dimension, a single vector, fewer vectors than
    dimensions) has null as whitened and does not count in identity_error, which is null
    if no component counts. Empty vectors and an empty table give no rows.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "vectors")
    model = fit(rows, components)
    if model is None:
        return spark.createDataFrame([], _RESULT)
    placed = numbered(rows, "rows")
    scale = np.where(model.variances > FLAT * max(model.variances[0], 1e-300), np.sqrt(model.variances), np.nan)
    projection = np.nan_to_num(model.directions / scale)
    blocks = _matrix(placed, placed.count(), model.sums, model.n)
    projected = _rows(_product(blocks, _local(spark, projection), partitions(spark)))
    told = F.array(*[F.lit(bool(np.isfinite(s))) for s in scale])
    shares = F.array(*[F.lit(float(v / model.trace) if model.trace else 0.0) for v in model.variances])
    one = placed.select("row", "vec_id", _deviation(model).alias("deviation")).join(projected, "row")
    return one.select("vec_id", "deviation", F.posexplode("values").alias("at", "value")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.when(F.get(told, F.col("at")), F.col("value")).alias("whitened"), F.get(shares, F.col("at")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"))
