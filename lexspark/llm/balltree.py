"""Exact top-k by inner product: a ball tree per shard, branch and bound."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import stored

K = 20
#: Rows of a shard and queries of a block at most (about): what one task holds.
SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
LEAF = 64
CELLS = 256
#: Cells follow centres fitted on at most this many vectors; every vector is indexed.
FIT_ROWS = 4096
LEAST = -2 ** 63


def usable(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v (array<long>): floor(scale * x) of each component, as double.

    Null vectors and those with a null, NaN or infinite component take no part, nor
    does a null vec_id. Rows that are equal in id and vector count once.
    """
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long"), x.cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & x.isNotNull()).where(F.coalesce(whole, F.lit(False)))
        .select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale)).alias("v")).distinct()
    )


class BallTree:
    """Balls over rows sorted by tree position: `begin:end`, centre, radius, and the
    smallest id inside, which decides among equal scores.

    `whole`: the rows as 64-bit integers, where doubles are too short for their scores;
    the balls and their bounds stay in doubles.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int = K, leaf: int = LEAF, whole: np.ndarray | None = None):
        order, self.k = np.argsort(ids, kind="stable"), k
        self.ids, self.rows = ids[order], rows[order]
        self.whole = None if whole is None else whole[order]
        self.begin, self.end, self.centre, self.radius, self.least, self.child = [], [], [], [], [], []
        if len(ids):
            self._ball(0, len(ids), leaf)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _ball(self, begin: int, end: int, leaf: int) -> int:
        me, rows = len(self.begin), self.rows[begin:end]
        centre = rows.mean(0, dtype=np.float64)
        away = ((rows - centre) ** 2).sum(1)
        self.begin.append(begin)
        self.end.append(end)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(away.max())))
        self.least.append(int(self.ids[begin:end].min()))
        self.child.append(None)
        # Integers that doubles cannot tell apart are told apart here.
        same = away.max() == 0 and (self.whole is None or (self.whole[begin:end] == self.whole[begin]).all())
        if same:
            # Equal rows stand in the order of their ids: the others cannot be results.
            self.end[me] = min(end, begin + self.k + 1)
        elif end - begin > leaf:
            # Towards the two ends of a long axis of the ball, in equal halves.
            far = rows[int(away.argmax())]
            other = rows[int(((rows - far) ** 2).sum(1).argmax())]
            side = np.argsort(rows @ (far - other), kind="stable")
            self.rows[begin:end], self.ids[begin:end] = rows[side], self.ids[begin:end][side]
            if self.whole is not None:
                self.whole[begin:end] = self.whole[begin:end][side]
            middle = (begin + end) // 2
            self.child[me] = self._ball(begin, middle, leaf), self._ball(middle, end, leaf)
        return me

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int,
               whole: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(query position, vec_id, score) of up to k rows per query with a score of at
        least `floor`, the query's own id left out.

        Balls are taken in the order of their greatest bound over the block; a ball is
        entered by the queries whose bound reaches their current k-th score. `whole`: the
        queries as integers, for a tree that has its rows so.
        """
        n = len(queries)
        exact = self.whole is not None
        rows_, queries_ = (self.whole, whole) if exact else (self.rows, queries)
        none = LEAST if exact else -np.inf
        best = np.full((n, k), none, np.int64 if exact else np.float64)
        best_id = np.full((n, k), np.iinfo(np.int64).max)
        # A floor that a double rounded up must not lose its ties.
        kth = np.array([max(LEAST, int(np.nextafter(f, -np.inf))) for f in floor], np.int64) if exact else floor.astype(np.float64)
        if not n or not len(self.rows):
            return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        norm = np.sqrt((queries ** 2).sum(1))
        # Bounds are raised by far more than double precision can be off.
        slack = 1e-9 * (1 + norm * max(1.0, float(np.abs(self.rows).max()) * np.sqrt(self.rows.shape[1])))
        bounds = queries @ self.centre.T + np.outer(norm, self.radius) + slack[:, None]
        heap = [(-float(bounds[:, 0].max()), 0)]
        while heap:
            _, ball = heapq.heappop(heap)
            go = np.flatnonzero(bounds[:, ball] >= kth)
            if not len(go):
                continue
            if self.child[ball]:
                for c in self.child[ball]:
                    heapq.heappush(heap, (-float(bounds[go, c].max()), c))
                continue
            for at in range(self.begin[ball], self.end[ball], LEAF):
                rows = slice(at, min(self.end[ball], at + LEAF))
                score = queries_[go] @ rows_[rows].T
                score[ids[go][:, None] == self.ids[rows][None, :]] = none
                score[score < kth[go][:, None]] = none
                some = score.max(1) > none
                if not some.any():
                    continue
                who = go[some]
                all_score = np.concatenate([best[who], score[some]], 1)
                all_id = np.concatenate([best_id[who], np.broadcast_to(self.ids[rows], score[some].shape)], 1)
                all_id = np.where(all_score > none, all_id, np.iinfo(np.int64).max)
                order = np.lexsort((all_id, ~all_score if exact else -all_score))[:, :k]
                best[who] = np.take_along_axis(all_score, order, 1)
                best_id[who] = np.take_along_axis(all_id, order, 1)
                kth[who] = np.maximum(kth[who], best[who, -1])
        query, place = np.nonzero(best > none)
        return query, best_id[query, place], best[query, place]


def _matrix(column: pa.ChunkedArray, dim: int, kind: type = np.float64) -> np.ndarray:
    """Vectors as doubles, or integers, shorter ones filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    if len(sizes) and (sizes == dim).all():
        rows = flat.reshape(-1, dim).astype(kind)
    else:
        rows = np.zeros((len(sizes), dim), kind)
        rows[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return rows


def _greatest(rows: np.ndarray, queries: np.ndarray) -> float:
    """Bound on the size of an inner product."""
    return float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(rows.shape[1], 1)


def _centres(vectors: DataFrame, dim: int, wanted: int) -> np.ndarray:
    """Up to CELLS centres, by a few rounds of k-means on at most FIT_ROWS vectors."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(FIT_ROWS, 64 * wanted)).collect()
    points = _matrix(pa.array([r.v for r in sample], pa.list_(pa.int64())), dim)
    centres = np.unique(points, axis=0)[: min(wanted, CELLS)].copy()
    for _ in range(8 if len(centres) else 0):
        nearest, _ = _nearest(points, centres)
        for c in range(len(centres)):
            if (nearest == c).any():
                centres[c] = points[nearest == c].mean(0)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, and the distance to it."""
    cell = ((centres ** 2).sum(1) - 2 * points @ centres.T).argmin(1)
    return cell, np.sqrt(((points - centres[cell]) ** 2).sum(1))


def _placed(vectors: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("cell", pa.int32()), ("away", pa.float64())])

    def run(parts):
        for b in parts:
            if b.num_rows:
                cell, away = _nearest(_matrix(b.column("v"), dim), centres)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("v").cast(pa.list_(pa.int64())), pa.array(cell, pa.int32()), pa.array(away)],
                    schema=schema)

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, cell int, away double")


def _bounds(queries: DataFrame, centres: np.ndarray, cells: dict[int, tuple[float, int]], dim: int) -> DataFrame:
    """query_id, cell, subs, bound, home: for each cell the greatest inner product that
    one of its vectors can have with the query; home is the cell with the highest."""
    numbers = sorted(cells)
    centre, radius = centres[numbers], np.array([cells[c][0] for c in numbers])
    subs = np.array([cells[c][1] for c in numbers], np.int64)
    schema = pa.schema([("query_id", pa.int64()), ("cell", pa.int32()), ("subs", pa.int64()),
                        ("bound", pa.float64()), ("home", pa.bool_())])

    def run(parts):
        for b in parts:
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), 1024):
                q = _matrix(b.column("v").slice(at, 1024), dim)
                norm = np.sqrt((q ** 2).sum(1))
                bound = q @ centre.T + np.outer(norm, radius)
                bound += 1e-6 * (1 + np.abs(bound)) + 1e-9 * np.outer(norm, radius + np.sqrt((centre ** 2).sum(1)))
                home = np.arange(len(numbers)) == bound.argmax(1)[:, None]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids[at: at + 1024], len(numbers))), pa.array(np.tile(np.array(numbers, np.int32), len(q))),
                    pa.array(np.tile(subs, len(q))), pa.array(bound.ravel()), pa.array(home.ravel())], schema=schema)

    return queries.select("vec_id", "v").mapInArrow(run, "query_id long, cell int, subs long, bound double, home boolean")


def _search(shards: DataFrame, asked: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """query_id, vec_id, score: up to k results of each asked (query_id, cell, sub, floor).

    The queries of a shard are dealt out to blocks, and the shard is repeated for
    each, so no task holds more than about a shard and a block.
    """
    key = ["cell", "sub"]
    asked = stored(asked, "asked")
    blocks = asked.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("_blocks"))
    left = (
        asked.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("_blocks")).cast("int"))
        .join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    )
    right = shards.join(blocks, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))

    def run(asked_: pa.Table, rows: pa.Table) -> pa.Table:
        ids = asked_.column("query_id").to_numpy()
        v, q = _matrix(rows.column("v"), dim), _matrix(asked_.column("q"), dim)
        # Sums of products are exact in doubles below 2**53, and a score is a long.
        greatest = _greatest(v, q)
        if greatest >= 2 ** 63:
            raise ValueError("components too large: an inner product may exceed a long")
        large = greatest >= 2 ** 53
        tree = BallTree(rows.column("vec_id").to_numpy(), v, k, whole=_matrix(rows.column("v"), dim, np.int64) if large else None)
        at, found, score = tree.search(ids, q, asked_.column("floor").to_numpy(), k,
                                       _matrix(asked_.column("q"), dim, np.int64) if large else None)
        return pa.table({"query_id": ids[at], "vec_id": found, "score": score.astype(np.int64)})

    key = [*key, "block"]
    return left.select("query_id", "q", "floor", *key).groupBy(*key).cogroup(
        right.select("vec_id", "v", *key).groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `vectors` with the highest inner
    product for each of `queries`, exact, ties to the smaller vec_id. Both have the
    columns of `usable`; a query's own vec_id is no candidate.

    Vectors lie in cells around fitted centres, a cell in shards of about
    `shard_rows`. A query first searches one shard of the cell with the highest
    bound; its k-th score there is shared with all other shards, and it enters only
    those whose bound reaches it. Inside a shard a ball tree goes on the same way.
    Scores are computed in doubles where these are exact, else in 64-bit integers; a
    shard and a block whose scores might exceed a long fail the job. Fewer candidates give fewer rows, none give none; a vec_id with several vectors
    appears once for each score, a query_id with several is answered by their best
    scores. Shorter vectors count as filled up with zeros. The driver holds one row
    per cell, CELLS at most.
    """
    vectors, queries = stored(vectors, "vectors"), stored(queries, "queries")
    width = F.coalesce(F.max(F.size("v")), F.lit(0))
    n, dim = vectors.agg(F.count(F.lit(1)), width).first()
    dim = max(dim, queries.agg(width).first()[0])
    centres = _centres(vectors, dim, max(1, -(-n // shard_rows)))
    if not len(centres):
        return queries.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    placed = stored(_placed(vectors, centres, dim), "placed")
    cells = {r.cell: (r.radius, r.subs) for r in placed.groupBy("cell").agg(
        F.max("away").alias("radius"), F.ceil(F.count(F.lit(1)) / shard_rows).alias("subs")).collect()}
    subs = F.element_at(F.create_map(*[F.lit(x) for c, (_, s) in cells.items() for x in (c, s)]), F.col("cell"))
    shards = placed.withColumn("sub", F.pmod(F.xxhash64("vec_id"), subs))
    bounds = stored(_bounds(queries, centres, cells, dim), "bounds")

    least = float(LEAST)
    home = F.pmod(F.xxhash64("query_id"), F.col("subs"))
    first = bounds.where("home").select("query_id", "cell", home.alias("sub"), F.lit(least).alias("floor"))
    first = stored(_search(shards, first, queries, dim, k), "first")
    kth = _best(first, k).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    rest = (
        bounds.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(least)))
        .where("bound >= floor")
        .withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))
        .where(~(F.col("home") & (F.col("sub") == home))).select("query_id", "cell", "sub", "floor")
    )
    found = first.unionByName(_search(shards, rest, queries, dim, k))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
