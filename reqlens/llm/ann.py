"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

A shard is the cell of a pivot: the vectors to which this pivot is the nearest, dealt out further by hash where they are
too many for one tree. A query is first searched in one shard of its own pivot's cell. The distance of the k-th found
bounds all that is still to come, and a second round searches only the cells whose ball it reaches, with that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from reqlens.llm.common import cut, ship, spread

#: Rows of a shard and queries of a block at most (hashing deals them out evenly), and the least and most pivots.
SHARD_ROWS, BLOCK_ROWS, LEAST_SHARDS, MOST_PIVOTS = 100_000, 20_000, 64, 4096
#: Points of a leaf of a tree.
LEAF = 64
#: Points of a leaf whose distances to the queries are computed at once.
CHUNK = 4096


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances, queries by points, in double precision; squares are added in the order of the components."""
    total = np.zeros((len(queries), len(points)))
    for j in range(queries.shape[1]):
        d = queries[:, j, None] - points[None, :, j]
        d *= d
        total += d
    return np.sqrt(total)


class VPTree:
    """A vantage-point tree: inner nodes split their points at the median distance from one of them."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # the farthest point from the first one lies at the rim, and so splits well; both choices are deterministic
        far = distances(self.points[rows[:1]], self.points[rows])[0]
        at = int(far.argmax())
        own, rest = rows[at], np.delete(rows, at)
        d = distances(self.points[[own]], self.points[rest])[0]
        middle = float(np.median(d))
        inner = d <= middle
        if inner.all():  # more than half at one distance, the largest: split below it, or stop if there is none below
            inner = d < middle
            if not inner.any():
                return rows
            middle = float(d[inner].max())
        return own, middle, self._build(rest[inner]), self._build(rest[~inner])

    def search(self, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, factor: float = 1.0, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances, nearest first and ties by id, of the k nearest ids other than the query's, each at its nearest point.

        A child is passed over when the triangle inequality puts all of it beyond the k-th distance so far; factor > 1
        shrinks that distance in the test, which passes over more, and factor 1 is exact. Unfilled places hold inf.
        bound: distances beyond which nothing is wanted, for each query.
        """
        self.q, self.qid, self.id, self.k, self.factor = queries, query_ids, ids, k, factor
        self.repeated = len(np.unique(ids)) < len(ids)
        self.bound = np.full(len(queries), np.inf) if bound is None else bound
        self.best_d, self.best_i = np.full((len(queries), k), np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
        if len(self.points) and len(queries):
            self._visit(self.root, np.arange(len(queries)))
        return self.best_i, self.best_d

    def _offer(self, active: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
        """Merge points into the active queries' lists."""
        d = np.where(self.id[rows][None, :] == self.qid[active][:, None], np.inf, d)
        d = np.where(d <= np.minimum(self.best_d[active, -1], self.bound[active])[:, None], d, np.inf)
        some = np.isfinite(d).any(1)
        if not some.any():
            return
        active, d = active[some], d[some]
        all_d = np.concatenate([self.best_d[active], d], 1)
        all_i = np.concatenate([self.best_i[active], np.where(np.isinf(d), np.iinfo(np.int64).max, np.broadcast_to(self.id[rows], d.shape))], 1)
        if self.repeated:  # of an id's points the nearest stays, so that the list holds k ids
            order = np.lexsort((all_d, all_i), axis=1)
            all_d, all_i = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
            again = all_i[:, 1:] == all_i[:, :-1]
            all_d[:, 1:][again], all_i[:, 1:][again] = np.inf, np.iinfo(np.int64).max
        order = np.lexsort((all_i, all_d), axis=1)[:, : self.k]
        self.best_d[active], self.best_i[active] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            for start in range(0, len(node), CHUNK):
                rows = node[start : start + CHUNK]
                step = max(1, 4_000_000 // len(rows))
                for a in range(0, len(active), step):
                    part = active[a : a + step]
                    self._offer(part, rows, distances(self.q[part], self.points[rows]))
            return
        own, middle, inner, outer = node
        d = distances(self.q[active], self.points[[own]])[:, 0]
        self._offer(active, np.array([own]), d[:, None])
        near_inner = d <= middle
        self._visit(inner, active[near_inner])
        self._visit(outer, active[~near_inner])
        # ties at the k-th distance must be seen: a child is passed over only if strictly beyond it. The slack covers rounding.
        reach = _reach(np.minimum(self.best_d[active, -1], self.bound[active]), d, self.factor)
        self._visit(outer, active[near_inner & (middle - d <= reach)])
        self._visit(inner, active[~near_inner & (d - middle <= reach)])


def _reach(found: np.ndarray, d: np.ndarray, factor: float) -> np.ndarray:
    """How far from a query something of interest can be: the k-th distance found, relaxed by the factor, with slack for rounding."""
    reach = found / factor
    return reach + 1e-9 * (1 + np.where(np.isinf(reach), 0, reach) + d)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows that take part: an id, and a vector that is not null, zero, or holding null or non-finite components."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    return vectors.select(id_col, vec_col).where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & ~zero)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """The k nearest vectors of each query: query_id, rank (from 1), vec_id, score (Euclidean distance, double).

    Nearest first, ties to the smaller id; rows with the query's own id are not its candidates. With factor 1 the result
    is exact; larger factors prune more and may miss some. Vectors must be of one length; those that cannot take part
    (see `usable`) give and get nothing. Of rows with equal id and vector one counts; of rows with equal id and other
    vectors the nearest. Fewer candidates than k give fewer rows, an empty table none; other columns are not read.

    The pivots, at most MOST_PIVOTS of them and one for each `shard_rows` vectors, are the vectors with the least hashes;
    with their cells' radii and sizes they are all that reaches the driver. Vectors are dealt into the shards of a cell by a
    hash of id and vector, so that neither an id with many vectors nor a crowded cell has a task of its own, and the
    queries of a shard into blocks. Each task joins one shard with one block, and gives k ids a query. Neither side is
    collected or broadcast.
    """
    ship(vectors.sparkSession)
    shape = lambda df: usable(df, id_col, vec_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    vectors, queries = shape(vectors), shape(queries)
    n = vectors.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    least = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(min(max(least_shards, -(-n // shard_rows)), MOST_PIVOTS))
    pivots = np.array(least.toPandas()["v"].tolist())
    squares = (pivots * pivots).sum(1)

    def matrix(lists: pa.ListArray) -> np.ndarray:
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.slice(start, 4096)
                v = matrix(part.column(1))
                cell = (squares - 2 * (v @ pivots.T)).argmin(1)
                far = np.sqrt(((v - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "v", "cell", "far"])

    placed = cut(vectors.mapInArrow(cells, "id long, v array<double>, cell int, far double"))
    stats = placed.groupBy("cell").agg(F.max("far").alias("radius"), F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards")).toPandas()
    radius, shards = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    radius[stats["cell"]], shards[stats["cell"]] = stats["radius"], stats["shards"]
    each = F.broadcast(vectors.sparkSession.createDataFrame([(int(c), int(s)) for c, s in enumerate(shards)], "cell int, shards int"))  # a row a pivot
    pick = lambda seed, of, *by: F.pmod(F.xxhash64(*by, F.lit(seed)), of).cast("int")
    points = placed.join(each, "cell").select("cell", pick(1, F.col("shards"), "id", "v").alias("shard"), "id", "v")

    own = queries.mapInArrow(cells, "id long, v array<double>, cell int, far double").join(each, "cell").where("shards > 0")
    own = own.select("cell", pick(2, F.col("shards"), "id").alias("shard"), "id", "v", F.lit(float("inf")).alias("bound"))
    first = cut(_search(points, own, k, factor, block_rows))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    kth = first.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    bounds = kth.select(F.col("query_id").alias("id"), F.col("score").alias("bound"))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                v, bound = matrix(part.column(1)), part.column(2).to_numpy()
                d = distances(v, pivots)
                row, cell = np.nonzero((shards > 0) & (d - radius <= _reach(bound[:, None], d, factor)))
                row = np.repeat(row, shards[cell])
                shard = np.arange(len(row)) - np.repeat(np.cumsum(shards[cell]) - shards[cell], shards[cell])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cell, shards[cell]).astype(np.int32)), pa.array(shard.astype(np.int32)), *(part.column(i).take(take) for i in range(3))], ["cell", "shard", "id", "v", "bound"])

    bounded = queries.join(bounds, "id", "left").select("id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    routed = bounded.mapInArrow(reached, "cell int, shard int, id long, v array<double>, bound double")
    found = first.unionByName(_search(points, routed, k, factor, block_rows))
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(points: DataFrame, queries: DataFrame, k: int, factor: float, block_rows: int) -> DataFrame:
    """The k nearest ids of each query in the shard it is sent to: query_id, vec_id, score. Both sides have cell, shard, id, v."""
    blocks = cut(queries.groupBy("cell", "shard").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")))
    q = spread(queries, blocks, ["cell", "shard"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    v = spread(points, blocks, ["cell", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        points, pid, _ = _distinct(left)
        qs, qid, first = _distinct(right)
        found_i, found_d = VPTree(points).search(qs, qid, pid, k, factor, right["bound"].to_numpy()[first])
        here = np.isfinite(found_d)
        return pd.DataFrame({"query_id": np.repeat(qid, here.sum(1)), "vec_id": found_i[here], "score": found_d[here]})

    return v.groupBy("cell", "shard", "block").cogroup(q.groupBy("cell", "shard", "block")).applyInPandas(search, "query_id long, vec_id long, score double")


def _distinct(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points and ids in order of id, without rows equal in both, and the rows' places."""
    points, ids = np.stack(rows["v"].to_numpy()).astype(np.float64), rows["id"].to_numpy(np.int64)
    whole = np.column_stack([ids.view(np.float64), points])
    _, first = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1] * 8}").ravel(), return_index=True)
    first = first[np.argsort(ids[first], kind="stable")]
    return points[first], ids[first], first
