"""Operators 2 and 4 against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoquilt.llm import ann, queries, topk

NAN, INF = float("nan"), float("inf")


def odd(spark):
    rows = [(0, [0.5, 0.25], "a"), (50, [0.5, 0.25], "b"), (1, [0.5, 0.25], "c"), (2, None, "d"), (3, [], "e"), (4, [1.0, None], "f"), (100, [NAN, 1.0], "g"), (5, [INF, 0.0], "h"), (6, [1.0, 2.0, 3.0], "i"), (None, [1.0, 1.0], "j"), (7, [0.0, 0.0], "k"), (8, [-0.001, 0.9], "l"), (8, [-0.001, 0.9], "m"), (200, [1.0, 0.0, 0.0], "n")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")


def clean(rows, zero):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    return ok if zero else [(i, v) for i, v in ok if any(v)]


def brute_top(rows, every, k):
    rows = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in clean(rows, True)]
    out = []
    for q, v in rows:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_op2(spark, sf_dir):
    for docs in (odd(spark), queries.table(spark, sf_dir, "embeddings")):
        rows = [tuple(r) for r in docs.select("vec_id", "embedding").collect()]
        got = topk.exact_search(docs, F.col("vec_id") % 50 == 0, 5)
        assert sorted(map(tuple, got.collect())) == brute_top(rows, 50, 5)


def test_op2_many_blocks_and_big_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [int(x) for x in rng.integers(-5, 5, 3)]) for i in range(300)] + [(1000, [2**40, 1, -(2**40)]), (1001, [2**20 + 1, 7, 3])]
    base = spark.createDataFrame(rows, "id long, v array<long>").repartition(5)
    got = topk.top_k(base, base.where("id % 10 = 0"), 4, block=7)
    want = []
    for q, v in rows:
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:4]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(base, base.limit(0), 4).count() == 0 and topk.top_k(base.limit(0), base.limit(3), 4).count() == 0


def test_op2_thousands_of_queries_and_ties(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (6000, 8))
    x[::3] = x[0]  # a third of all rows are one vector
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<long>").repartition(4)
    got = {}
    for r in topk.top_k(base, base.where("id < 5000"), 5, block=3000).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    scores = x[:5000] @ x.T
    assert len(got) == 5000
    for q in range(5000):
        order = np.lexsort((np.arange(6000), -scores[q]))
        order = order[order != q][:5]
        assert sorted(got[q]) == [(n + 1, int(i), int(scores[q, i])) for n, i in enumerate(order)]


def test_hilbert_keys_are_a_curve():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(2**bits)] * n, indexing="ij"), -1).reshape(-1, n)
        key = ann.hilbert_keys(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_op4_small_tables_are_exact(spark, sf_dir):
    for docs in (odd(spark), queries.table(spark, sf_dir, "embeddings")):
        rows = sorted({(i, tuple(v)) for i, v in clean([tuple(r) for r in docs.select("vec_id", "embedding").collect()], False)})
        want = {}
        for q, v in rows:
            if q % 100 == 0:
                want[q] = sorted((math.dist(v, w), i) for i, w in rows if i != q and len(w) == len(v))[:10]
        got = ann.nearest(docs, F.col("vec_id") % 100 == 0).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted((q, n + 1, i) for q, b in want.items() for n, (_, i) in enumerate(b))
        assert all(r["score"] == pytest.approx(want[r["query_id"]][r["rank"] - 1][0], rel=1e-12) for r in got)
    assert ann.nearest(odd(spark).limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_op4_recall_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    x[:700] = x[0]  # a third share a vector, nearly
    x[:700] += rng.normal(size=(700, 32)) * 1e-3
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(docs, F.col("vec_id") % 100 == 0).collect()
    hit = total = 0
    for q in range(0, 3000, 100):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        want = set(np.argsort(d)[:10].tolist())
        hit += len(want & {r["vec_id"] for r in got if r["query_id"] == q})
        total += 10
    assert hit >= 0.9 * total


def test_op4_repeated_rows_do_not_crowd_out(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows + rows[7:8] * 100 + rows[50:51] * 30, "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(docs, F.col("vec_id") % 10 == 0).collect()
    for q in range(0, 500, 10):
        want = sorted((math.dist(x[q], w), i) for i, w in enumerate(x) if i != q)[:10]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in want]


def test_op4_exact_copies_in_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    copies = rng.permutation(3000)[:1000]
    x[copies] = x[copies[0]]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(docs, F.col("vec_id") % 50 == 0).collect()
    hit, total, among = 0, 0, set(copies.tolist())
    for q in range(0, 3000, 50):
        d = np.linalg.norm(x - x[q], axis=1)
        want = [i for i in np.lexsort((np.arange(3000), d)).tolist() if i != q][:10]
        found = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert len(found) == 10
        if q in among:
            assert found == want  # the smallest ids of its copies
        hit += len(set(want) & set(found))
        total += 10
    assert hit >= 0.9 * total
