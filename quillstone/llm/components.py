"""Connected components: union-find within tasks, then large-star and small-star steps on edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.store import stash


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges ``(a, b)`` with a > b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    large = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("n")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    large = large.union(least.where(F.col("n") != F.col("m")).select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
    below = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    small = large.join(below, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
    return small.union(below.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


#: Nodes that one task's union-find holds before it hands on its stars and begins anew.
HELD = 200_000


def _contract(held: int):
    """Edges ``(a, b)`` of the task's own components as stars around their least node."""
    return lambda batches: _stars(batches, held)


def _stars(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def stars() -> pa.RecordBatch:
        leaves = [x for x in up if up[x] != x]
        return pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(list(map(root, leaves)), pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((root(a), root(b)))
            up[high] = low
        if len(up) > held:
            yield stars()
            up.clear()
    yield stars()


def _settled(edges: DataFrame) -> bool:
    """Whether each node is the leaf of one star or a centre, and none is both."""
    leaf, centre = F.lit(1).alias("leaf"), F.lit(0).alias("leaf")
    ends = edges.select(F.col("a").alias("n"), leaf).union(edges.select(F.col("b").alias("n"), centre))
    seen = ends.groupBy("n").agg(F.sum("leaf").alias("leaves"), F.min("leaf").alias("least"))
    return not seen.where("leaves > 1 or (leaves = 1 and least = 0)").take(1)


def components(edges: DataFrame, a: str, b: str, held: int = HELD) -> DataFrame:
    """``(node, component)`` of every node with an edge; a component is named by its least node.

    Each task contracts the edges it has, in bounded memory. Then union-find goes on as joins: in each round every
    node is linked to the least node that it knows of, until each component is a star around its least node. The rounds
    grow with the logarithm of the longest path. Minima are aggregated before
    the shuffle, and joins carry the rest, so a node with very many edges may
    be split. Self-links and repeated edges don't matter; nulls are left out.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    given = edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    now = stash(given.mapInArrow(_contract(held), "a long, b long").distinct(), "edges")
    while not _settled(now):
        now = stash(_star(now), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
