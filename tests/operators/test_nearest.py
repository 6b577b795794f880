"""The nearest rows of stated queries against a comparison of all pairs."""

from __future__ import annotations

import random

import numpy as np

from pyspark.sql import functions as F

from quillstone.operators import search

VECTORS = "vec_id long, embedding array<float>, label long"


def brute(rows, k):
    out = {}
    dot = lambda a, b: sum((float(x) * float(y) for x, y in zip(a, b)), 0.0)
    whole = lambda e: e is not None and None not in e
    for q, e, _ in rows:
        if q % 10 or e is None:
            continue
        near = []
        for v, f, _ in rows:
            if v != q:
                s = round(dot(f, e) / dot(f, f) ** 0.5 / dot(e, e) ** 0.5, 6) if whole(e) and whole(f) and len(e) == len(f) else None
                near.append((s is None, -s if s is not None else 0, v, s))
        out[q] = [(v, s) for _, _, v, s in sorted(near)[:k]]
    return out


def test_nearest_equals_all_pairs(spark):
    r = random.Random(1)
    base = [[float(r.randrange(-4, 5)) + 0.5 for _ in range(6)] for _ in range(40)]
    rows = [(i, base[i % 40] if i % 3 else [x + r.random() for x in base[i % 40]], i % 4) for i in range(700)]  # many copies, so ties go by vec_id
    rows = [(i, [float(x) for x in np.float32(e)], n) for i, e, n in rows]
    rows += [(1000, [1.0, 2.0], 0), (1001, [2.0, 1.0], 1), (1003, None, 1), (1005, [1.0, None, 3.0, 1.0, 1.0, 1.0], 2), (1010, [None, 1.0], 2)]
    vectors = spark.createDataFrame(rows, VECTORS)
    queries = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))
    got = {}
    for x in search.nearest(vectors, queries, 7).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute(rows, 7)
    assert {q: [(v, s) for _, v, s in sorted(g)] for q, g in got.items()} == want
    assert {n for g in got.values() for n in (len(g),)} == {7}


def test_what_is_handed_on_grows_with_queries(spark):
    """Of all pairs a task hands on k a query, before ranks are given."""
    vectors = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"), (F.col("id") % 3).alias("label"))
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))
    plan = search.nearest(vectors, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
