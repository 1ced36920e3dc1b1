"""Approximate nearest neighbours by shifted space-filling curves.

Each of several curves projects the vectors on a few random orthonormal directions, shifts them, and orders
them by the Hilbert key of that point. Spark range-partitions the rows by (curve, key), so ranks along each curve are
exact; a query meets the rows of the rank window around it, in blocks of a fixed number of rows, and the
lists of all curves are merged and ranked by exact distance. The window is a share of the rows, so recall
does not fall as a table grows; on data without structure that share has to be large.

A row of the curves is a class: one vector with the k + 1 smallest ids that hold it, as many as any query can
need of it. Exact copies thus take one place, and a class is searched once for all the queries in it. Classes of
one key have an order of their own on each curve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, is_finite_vector

CURVES, DIRECTIONS, BITS = 16, 4, 12
WINDOW = 0.07
BLOCK_ROWS = 2048
#: Queries that meet in one block at most; more are dealt to copies of the block.
BLOCK_QUERIES = 1024
#: Vectors whose projections fix the range of the keys: a bounded sample, taken by hash of the id.
FIT_ROWS = 4096


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of non-negative whole numbers below 2**bits
    (Skilling 2004: undo the excess work of the transform from the highest bit down, then Gray-encode)."""
    x = points.T.astype(np.uint64)
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low, bit = np.uint64((1 << b) - 1), np.uint64(b)
        for i in range(n):
            set_ = (x[i] >> bit) & one == one
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, np.uint64(0)) ^ swap
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> np.uint64(b)) & one == one, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | x[i] >> np.uint64(b) & one
    return key.astype(np.int64)


def directions(dim: int, curves: int, per_curve: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions, as many bases as needed, and each curve's shift as a share of the range."""
    rng = np.random.default_rng([seed, dim])
    bases = [np.linalg.qr(rng.normal(size=(dim, dim)))[0].T for _ in range(-(-curves * per_curve // dim))]
    return np.concatenate(bases)[: curves * per_curve].reshape(curves, per_curve, dim), rng.uniform(0, 0.5, (curves, per_curve))


def nearest(vectors: DataFrame, is_query, k: int = 10, curves: int = CURVES, window: float = WINDOW, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): for each row that fits the condition ``is_query`` its k
    nearest rows found, by Euclidean distance in double precision on the original vectors, ties to the smaller id.

    Rows whose id or vector is null, or whose vector is empty, zero or holds null or non-finite components take no
    part. The query's own id is no candidate, nor are vectors of another length. Rows that repeat id and vector count
    once. All candidates where there are fewer than k. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    narrow = isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType)
    dtype = np.dtype("<f4" if narrow else "<f8")
    ok = vectors.where(F.col(id_col).isNotNull() & is_finite_vector(F.col(vec_col)) & F.exists(vec_col, lambda x: x != 0))
    base = ok.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if narrow else "array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    base = base.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast("float" if narrow else "double")))  # -0.0 is 0.0
    marks = {"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(1), "v")}  # two hashes of the vector name its class
    asking = base.where("asks").select("id", "v").distinct()
    least = base.select("id", "v").distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = classes.join(asking.select("v", F.lit(True).alias("asks")).distinct(), "v", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    classes = cut(classes.withColumns(marks), "classes")

    fit = {}
    for r in classes.select("v").orderBy("a", "b").limit(FIT_ROWS).collect():
        fit.setdefault(len(r["v"]), []).append(r["v"])
    frames = {d: (a := directions(d, curves, DIRECTIONS, seed), lo := (p := np.einsum("cpd,nd->cpn", a[0], np.array(v, float))).min(2), np.maximum(p.max(2) - lo, 1e-300)) for d, v in fit.items()}

    mixers = np.random.default_rng(seed).integers(-(2**62), 2**62, curves) * 2 + 1

    def keys(batches):
        known = dict(frames)
        for batch in batches:
            lists = batch.column("v")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(int)
            a_, b_ = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                x = flat[starts[rows][:, None] + np.arange(d)]
                if d not in known:  # a length that the sample did not hold: the range of unit vectors
                    known[d] = (directions(d, curves, DIRECTIONS, seed), np.full((curves, DIRECTIONS), -1.0), np.full((curves, DIRECTIONS), 2.0))
                (a, shift), lo, span = known[d]
                raw = [v.tobytes() for v in x.astype(dtype)]
                for c in range(curves):
                    p = np.clip((x.astype(float) @ a[c].T - lo[c]) / span[c], 0, 1) / 1.5 + shift[c] / 1.5
                    key = hilbert_keys((p * (2**BITS - 1)).astype(np.int64), BITS)
                    mix = a_[rows] * mixers[c]  # wraps; the order within a key differs between curves
                    same = [batch.column(n).take(pa.array(rows)) for n in ("ids", "asks")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), c, np.int32)), pa.array(np.full(len(rows), d, np.int32)), pa.array(key), pa.array(mix), pa.array(a_[rows]), pa.array(b_[rows]), *same, pa.array(raw, pa.binary())], names=["curve", "dim", "key", "mix", "a", "b", "ids", "asks", "v"])

    counts = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).count().withColumnRenamed("count", "n").collect()}  # a row a length
    asked = classes.where("asks").count()
    parts = max(1, -(-sum(counts.values()) * curves // (4 * BLOCK_ROWS)))
    order = ["curve", "dim", "key", "mix", "b"]
    rows = classes.mapInArrow(keys, "curve int, dim int, key long, mix long, a long, b long, ids array<long>, asks boolean, v binary").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()), "curves")

    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part"), "curve", "dim").agg(F.count(F.lit(1)).alias("n")).collect()  # as many rows as partitions, and lengths times curves
    before, first, total = {}, {}, 0
    for r in sorted(sizes, key=lambda r: (r["part"], r["curve"], r["dim"])):
        before.setdefault(r["part"], total)
        first.setdefault((r["curve"], r["dim"]), total)
        total += r["n"]
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    offsets = spark.createDataFrame(sorted(before.items()), "part long, before long")
    firsts = spark.createDataFrame([(c, d, n, counts[d]) for (c, d), n in first.items()], "curve int, dim int, first long, rows long")
    ranked = rows.withColumn("part", part).join(F.broadcast(offsets), "part").join(F.broadcast(firsts), ["curve", "dim"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("first"))
    half = F.ceil(F.col("rows") * F.lit(window / 2))
    block = F.floor(F.col("rank") / BLOCK_ROWS)
    copies = max(1, -(-int(max(counts.values()) * window + 2 * BLOCK_ROWS) * asked // (sum(counts.values()) * BLOCK_QUERIES)))
    here = ranked.select("curve", "dim", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "a", "b", "ids", F.lit(False).alias("asks"), "v")
    reach = F.sequence(F.floor(F.greatest(F.col("rank") - half, F.lit(0)) / BLOCK_ROWS), F.floor(F.least(F.col("rank") + half, F.col("rows") - 1) / BLOCK_ROWS))
    seek = ranked.where("asks").select("curve", "dim", F.explode(reach).alias("block"), F.pmod("a", F.lit(copies)).cast("int").alias("copy"), "a", "b", F.expr("cast(array() as array<long>)").alias("ids"), F.lit(True).alias("asks"), "v")

    def near(tab: pa.Table) -> pa.Table:
        """For each asking class the pairs (id, class) up to its k + 1 nearest ids, of an id the k nearest pairs:
        whichever id asks, its own pairs can go and k are left."""
        asks = tab.column("asks").to_numpy()
        x = np.frombuffer(b"".join(tab.column("v").to_pylist()), dtype).reshape(len(asks), -1).astype(float)
        a, b = tab.column("a").to_numpy(), tab.column("b").to_numpy()
        ids, base_x, base_a, out = tab.column("ids").filter(pa.array(~asks)).to_pylist(), x[~asks], a[~asks], ([], [], [], [], [])
        for qa, qb, v in zip(a[asks].tolist(), b[asks].tolist(), x[asks]):
            gap = base_x - v
            dist = np.sqrt((gap * gap).sum(1))
            most = k + 1
            while True:
                keep = np.flatnonzero(dist <= np.partition(dist, most - 1)[most - 1]) if most < len(dist) else np.arange(len(dist))
                pairs = sorted((dist[c], i, base_a[c]) for c in keep.tolist() for i in ids[c])
                if most >= len(dist) or len({i for _, i, _ in pairs}) > k:
                    break
                most *= 4
            seen = {}
            for d, i, h in pairs:
                if i not in seen and len(seen) > k:
                    break
                seen[i] = seen.get(i, 0) + 1
                if seen[i] <= k:
                    for o, c in zip(out, (qa, qb, i, h, d)):
                        o.append(c)
        cat = [pa.array(o, pa.float64() if n == 4 else pa.int64()) for n, o in enumerate(out)]
        return pa.table(cat, names=["a", "b", "vec_id", "h", "score"])

    # Lists of all blocks: an id once with its k nearest pairs, a class's k + 1 nearest ids, in one row.
    found = here.unionByName(seek).groupBy("curve", "dim", "block", "copy").applyInArrow(near, "a long, b long, vec_id long, h long, score double")
    found = found.groupBy("a", "b", "vec_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id", "h"))), 1, k).alias("pairs"))
    best = Window.partitionBy("a", "b").orderBy(F.col("pairs")[0]["score"], "vec_id")
    lists = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).groupBy("a", "b").agg(F.array_sort(F.flatten(F.collect_list("pairs"))).alias("pairs"))

    # The ids that ask each take their class's list without themselves; those of a common vector are many, so nothing is grouped by class here.
    answers = asking.select(F.col("id").alias("query_id"), *[c.alias(n) for n, c in marks.items()]).join(lists, ["a", "b"])
    answers = answers.select("query_id", F.explode(F.slice(F.filter("pairs", lambda p: p["vec_id"] != F.col("query_id")), 1, k)).alias("p")).distinct()
    nearest_ = Window.partitionBy("query_id").orderBy("p.score", "p.vec_id")
    return answers.withColumn("rank", F.row_number().over(nearest_)).where(F.col("rank") <= k).select("query_id", "rank", F.col("p.vec_id").alias("vec_id"), F.col("p.score").alias("score"))
