"""Shards along a Hilbert curve through several metadata columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm.common import ordered

#: Cells of a dimension are 2**BITS: one for nulls, the others about equally filled.
BITS = 6


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points (one row each, coordinates below 2**bits).

    From the highest bit down, a set bit mirrors the first axis below it, a clear
    one swaps it there with its own axis; then the Gray code over the axes is undone
    and the bits are read off across the axes (Skilling, "Programming the Hilbert
    curve", 2004).
    """
    x = [cells[:, i].astype(np.int64).copy() for i in range(cells.shape[1])]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for axis in x:
            mirrored = axis >> b & 1 == 1
            swap = np.where(mirrored, 0, (x[0] ^ axis) & low)
            if axis is x[0]:
                x[0] ^= np.where(mirrored, low, 0)
            else:
                x[0] ^= np.where(mirrored, low, swap)
                axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> b & 1 == 1, (1 << b) - 1, 0)
    index = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            index = index << 1 | ((axis ^ flip) >> b & 1)
    return index


def _scale(df: DataFrame, name: str) -> Column:
    """A dimension as a number: numbers keep their order, other values are hashed."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)
    # 52 bits of the hash fit a double exactly.
    return F.when(F.col(name).isNotNull(), F.shiftrightunsigned(F.xxhash64(name), 12).cast("double"))


def cell_bounds(df: DataFrame, dims: list[str], bits: int = BITS) -> list[np.ndarray]:
    """Upper bounds of each dimension's cells, from quantiles over all rows: a few
    numbers, whatever the size of the table."""
    shares = [i / ((1 << bits) - 1) for i in range(1, (1 << bits) - 1)]
    row = df.agg(*[F.percentile_approx(_scale(df, d), shares, 10_000).alias(f"q{i}") for i, d in enumerate(dims)]).first()
    return [np.unique(np.array(q or [], float)) for q in row]


def hilbert(df: DataFrame, dims: list[str], bounds: list[np.ndarray], bits: int = BITS) -> DataFrame:
    """`df` with `cells` (one per dimension; null is cell 0) and `curve`."""
    if len(dims) * bits > 62:
        raise ValueError("more bits than a curve index holds")

    @F.pandas_udf("cells array<int>, curve long")
    def place(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in parts:
            columns = columns if isinstance(columns, tuple) else (columns,)
            cells = np.stack([
                np.where(c.isna(), 0, 1 + np.searchsorted(b, c.to_numpy(float, na_value=0.0), "left"))
                for c, b in zip(columns, bounds, strict=True)], 1)
            yield pd.DataFrame({"cells": list(cells.astype(np.int32)), "curve": curve_index(cells, bits)})

    return df.withColumn("_place", place(*[_scale(df, d) for d in dims])).withColumns(
        {"cells": F.col("_place.cells"), "curve": F.col("_place.curve")}).drop("_place")


def shard(df: DataFrame, dims: list[str], shards: int, bits: int = BITS) -> DataFrame:
    """`df` with `shard` and `slot` (0-based in its shard), `cells` and `curve`.

    The rows are put in the order of the curve and cut into `shards` runs whose row
    counts are at most one apart; the first ones hold the extra rows. Rows of one
    cell (a third of all may share it) are ordered by doc_id and by a hash of the
    whole row, so that they too are spread over the ranges of the sort. Nulls have a
    cell of their own, rows equal in all columns are kept, an empty table gives no
    rows. Columns named shard, slot, cells, curve or rank, or beginning with _, are replaced.
    """
    keep = [c for c in df.columns if c not in ("shard", "slot", "cells", "curve", "rank") and not c.startswith("_")]
    df = df.select(*[F.col(f"`{c}`") for c in keep])
    placed = hilbert(df, dims, cell_bounds(df, dims, bits), bits).withColumn("_tie", F.xxhash64(*[f"`{c}`" for c in keep]))
    ranked = ordered(placed, ["curve", "doc_id", "_tie"], "curve").drop("_tie")
    size, larger = divmod(ranked.count(), shards)
    rank = F.col("rank")
    edge = larger * (size + 1)
    late = (rank - edge) % max(size, 1), larger + F.floor((rank - edge) / max(size, 1))
    return ranked.withColumns({
        "shard": F.when(rank < edge, F.floor(rank / (size + 1))).otherwise(late[1]).cast("int"),
        "slot": F.when(rank < edge, rank % (size + 1)).otherwise(late[0]),
    }).drop("rank")


def manifest(sharded: DataFrame, dims: list[str], run: int = 65_536) -> DataFrame:
    """One row per run of `run` rows of a shard (a file): the range of cells it holds
    in each dimension. A reader that wants some cells skips all other runs."""
    at = F.col("cells")
    return sharded.groupBy("shard", F.floor(F.col("slot") / run).alias("run")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[f(at[i]).alias(f"{name}_{d}") for i, d in enumerate(dims) for name, f in (("min", F.min), ("max", F.max))])


def write(sharded: DataFrame, path: str, run: int = 65_536) -> None:
    """Each run as a Parquet file of its shard's folder, in the order of the curve."""
    n = F.floor(F.col("slot") / run)
    spread = sharded.withColumn("run", n)
    (
        spread.repartition("shard", "run").sortWithinPartitions("shard", "run", "slot")
        .write.partitionBy("shard", "run").parquet(path)
    )
