"""Exact top-k search by inner product: tiled matrix products and a tree of merges.

Queries are taken in blocks of a fixed number, each broadcast (bounded: ``block`` vectors); every task
multiplies its shard with the block tile by tile, selects each query's best k of the tile partially, and merges them
with its best so far, so it emits at most k rows a query. Lists are merged in two levels: by query and group of tasks,
then by query. Beyond one block, each block's answers are written before the next is read, so neither plan nor driver
grows with the number of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, is_finite_vector

#: Base rows and queries of one product: scores, keys and their order take some 25 MB.
TILE_ROWS, TILE_QUERIES = 4096, 256
FAN_IN = 64


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id long, v array<long>): floor(scale * x), x as double. Rows whose id or vector is null, empty, or holds a
    null or non-finite component take no part."""
    ok = vectors.where(F.col(id_col).isNotNull() & is_finite_vector(F.col(vec_col)))
    return ok.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k highest scores, ties to the smaller id; ``ids`` by row."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _tile_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Of each row the columns of the k highest scores, ties to the first column; in no order."""
    rows, n = scores.shape
    if n <= k:
        return np.broadcast_to(np.arange(n), (rows, n))
    high, low = int(scores.max()), int(scores.min())
    if (high - low + 1) * n < 2**62:  # score and column as one number, so that a partial selection breaks ties
        keys = (scores - low) * n + np.arange(n - 1, -1, -1)
        return np.argpartition(keys, n - k, axis=1)[:, n - k :]
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def top_k(base: DataFrame, queries: DataFrame, k: int = 5, block: int = 16384) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long) for ``base`` and ``queries`` of (id long, v array<long>).

    Each query's k highest integer inner products over all rows of base but those with its own id; ties to
    the smaller id; all candidates where there are fewer. A candidate of another length than the query is
    none. Repeated ids: each base row is a candidate, a repeated query is answered once a row. Sums are
    exact: products of float64 that stay below 2**53 as integers, int64 otherwise; sums that int64 might not hold raise.
    Null, empty and non-finite vectors are left out by ``quantised``; empty tables give no rows.
    """
    spark = base.sparkSession
    queries = queries.select("id", "v").orderBy("id", F.xxhash64("v"))
    at, total, parts = 0, queries.count(), []
    rows = queries.toLocalIterator() if total > block else iter(queries.collect())
    while at < total:
        chunk = [r for _, r in zip(range(min(block, total - at)), rows)]
        part = _merged(_block(spark, base, chunk, k, at), k)
        parts.append(cut(part, "block") if total > block else part)
        at += len(chunk)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if len(parts) == 1:
        return parts[0]
    return spark.read.schema(parts[0].schema).parquet(*(p._cut_at for p in parts))


def _merged(out: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("q", "task").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def _block(spark, base: DataFrame, chunk: list, k: int, first: int) -> DataFrame:
    by_dim: dict[int, list[int]] = {}
    for i, r in enumerate(chunk):
        by_dim.setdefault(len(r["v"]), []).append(i)
    ids = np.array([r["id"] for r in chunk], np.int64)
    groups = {d: (np.array(at), np.array([chunk[i]["v"] for i in at], np.int64)) for d, at in by_dim.items()}
    shared = spark.sparkContext.broadcast((ids, groups))

    def tiles(batches):
        own, by_size = shared.value
        lowest, none = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
        state = {d: (np.full((len(at), k), lowest), np.full((len(at), k), none)) for d, (at, _) in by_size.items()}
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(lo, TILE_ROWS)
                part = part.take(pa.array(np.argsort(part.column("id").to_numpy(), kind="stable")))  # columns in order of ids
                names, lists = part.column("id").to_numpy(), part.column("v")
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy()
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
                for d in set(sizes.tolist()) & set(by_size):
                    rows = np.flatnonzero(sizes == d)
                    tile, them = flat[starts[rows][:, None] + np.arange(d)], names[rows]
                    at, every = by_size[d]
                    most = float(np.abs(every).max()) * float(np.abs(tile).max()) * d
                    wide = tile.T.astype(float) if most < 2**53 else tile.T
                    s, i = state[d]
                    for q in range(0, len(every), TILE_QUERIES):
                        mine = slice(q, q + TILE_QUERIES)
                        scores = (every[mine].astype(wide.dtype) @ wide).astype(np.int64)
                        theirs = them == own[at[mine]][:, None]  # a query's own rows are no candidates
                        if most >= 2**63 and (np.abs(every[mine].astype(float) @ tile.T.astype(float))[~theirs] >= 2**62).any():
                            raise ValueError("an inner product may not fit 64 bits")
                        if theirs.any():
                            scores[theirs] = scores[~theirs].min(initial=0) - 1
                        best = _tile_best(scores, k)
                        value, name = np.take_along_axis(scores, best, 1), them[best]
                        self_ = name == own[at[mine]][:, None]
                        value, name = np.where(self_, lowest, value), np.where(self_, none, name)
                        s[mine], i[mine] = _best(np.hstack([s[mine], value]), np.hstack([i[mine], name]), k)
        for d, (s, i) in state.items():
            q, c = np.nonzero(s != lowest)
            at = by_size[d][0][q]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) + first), pa.array(own[at]), pa.array(i[q, c]), pa.array(s[q, c]), pa.array(np.full(len(q), task // FAN_IN, np.int32))], names=["q", "query_id", "vec_id", "score", "task"])

    return base.select("id", "v").mapInArrow(tiles, "q long, query_id long, vec_id long, score long, task int")


def exact_search(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``top_k`` of the rows of ``vectors`` for which the condition ``is_query`` holds, against all rows."""
    base = quantised(vectors, scale, id_col, vec_col)
    return top_k(base, quantised(vectors.where(is_query), scale, id_col, vec_col), k)
