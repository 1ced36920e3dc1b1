"""Connected components of a distributed edge list by alternating large-star and small-star steps
(Kiveris et al. 2014): no component and no list of links beyond FEW ever meets in one task, none on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, merged

#: A node with at least one in HOT of all edges is a hub, of which there are at most HOT; its edges are dealt to SALTS tasks.
HOT, LEAST_HOT, SALTS = 1000, 1000, 32
#: So many distinct edges (1 MB) are united by one task; rounds over the cluster would take some ten jobs each.
FEW = 1 << 16


def hot_keys(counts: DataFrame, key: str, total: int) -> list[int]:
    """The keys of a table (key, c) that hold at least one in HOT of ``total`` rows: at most HOT of them."""
    return [r[0] for r in counts.where(F.col("c") >= max(LEAST_HOT, -(-total // HOT))).select(key).collect()]


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: list[int], by: str) -> DataFrame:
    """``many`` joined to the rows of ``one`` by ``key``. Rows of a hot key are dealt to SALTS tasks by the column ``by``, and
    that key's row of ``one`` goes to each of them."""
    if not hot:
        return many.join(one, key)
    is_hot, none = F.col(key).isin(hot), F.lit(0)
    dealt = many.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(none))
    every = F.array(*map(F.lit, range(SALTS)))
    copies = one.withColumn("salt", F.explode(F.when(is_hot, every).otherwise(F.array(none))))
    return dealt.join(copies.hint("merge"), [key, "salt"]).drop("salt")


def _star(edges: DataFrame, large: bool, hubs: list[int]) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:  # each node with its smaller neighbours
        both = both.where(F.col("v") < F.col("u"))
    # partial minima go first, so a hub costs a row a task here
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    far = both.where(F.col("v") > F.col("u")) if large else both
    out = spread_join(far, least, "u", hubs, "v").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _united(batches):
    """(node, component) of all edges of a task, by union and find; the smaller root stays a root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    for at in range(0, len(nodes), 8192):
        part = nodes[at : at + 8192]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(map(root, part), pa.int64())], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW, rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node that each node of an edge list of longs can reach. Self-loops, repeats
    and null ends add nothing; nodes without edges are not listed. At most ``few`` distinct edges are united by one
    task, more by steps over the cluster, with the same result. ``rows``: about how many edges there are at most, if known."""
    small = (lambda df: merged(df, rows)) if rows is not None else (lambda df: df)
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(small(ends.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()), "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state is None and now[0] <= few:
            return edges.coalesce(1).mapInArrow(_united, "node long, component long").repartition(1)  # a stage of its own, see cut
        if now == state or not now[0]:
            break
        state = now
        hubs = hot_keys(edges.groupBy("b").agg(F.count(F.lit(1)).alias("c")), "b", now[0]) if now[0] >= LEAST_HOT else []
        # a hub's edges lead to larger nodes; after the large star a node has few smaller neighbours
        after = cut(small(_star(_star(edges, True, hubs), False, [])), "edges")
        forget(edges)
        edges = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
