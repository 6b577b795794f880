"""Co-occurrence, closure and numbering over tables of nodes and edges."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a part that ``dealt`` makes.
SHARE = 500_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows``, of which there are about ``n``, by key in so many parts that a task's share stays the same when the table grows.

    Parts that are told by their compressed bytes alone hold millions of rows where keys are alike, and each operator of a task keeps them.
    """
    return rows.repartition(max(n // SHARE + 1, rows.sparkSession.sparkContext.defaultParallelism), *keys)


def cooccurrence(rows: DataFrame, group: str, member: str, least: int) -> DataFrame:
    """``first_id, second_id, n_outcomes``: pairs of members by the groups that hold both.

    Groups with fewer than ``least`` rows or one member are left out before any pair
    is made. Members are gathered per group, so the rows meet in one shuffle, dealt by their number, and pairs
    are counted in each task before the next.
    """
    held = dealt(rows.select(group, member), rows.count(), group).groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("m"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & (F.size("m") > 1))
    pairs = held.select(F.posexplode("m").alias("i", "first_id"), "m").select("first_id", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("second_id"))
    return pairs.groupBy("first_id", "second_id").agg(F.count(F.lit(1)).alias("n_outcomes"))


# Names that go into the digests of mined records.
PREDICATE = "shared_governance_outcome_with"
MINING = "graph_connection_mining"


def supported(rows: DataFrame, group: str, member: str, claim: str) -> DataFrame:
    """``group, members, claims``: the different members and claims of each group that has two of both. Rows meet in one shuffle, dealt by their number."""
    some = rows.select(group, member, claim).where(F.col(group).isNotNull())
    held = dealt(some, rows.count(), group).groupBy(group).agg(F.collect_set(member).alias("members"), F.collect_set(claim).alias("claims"))
    return held.where((F.size("members") > 1) & (F.size("claims") > 1))


def proposed(outcomes: DataFrame) -> DataFrame:
    """``id, kind, record_id, subject_id, object_id, outcome_id, confidence``: what is proposed for review of ``outcomes(outcome_id, organizations, assertions)``, arrays of different ids.

    Each two organisations of an outcome are a candidate that all of the outcome's assertions support. A candidate proposes an assertion that relates
    the two, a relationship, which has no confidence of its own, and an edge of argument from each supporting assertion to the new one. Records are named
    by the candidate's digest, proposals by their labels. Nothing here is shuffled: a candidate's records are made where its outcome is.
    """
    name = lambda prefix, digest: F.concat(F.lit(prefix + "_"), F.substring(digest, 1, 24))
    digest = lambda *parts: F.sha2(F.concat_ws(":", *parts), 256)
    held = outcomes.select("outcome_id", F.array_sort("organizations").alias("o"), F.array_sort("assertions").alias("a"))
    first = held.select("outcome_id", "a", F.posexplode("o").alias("i", "subject"), "o")
    pairs = first.select("outcome_id", "a", "subject", F.explode(F.slice("o", F.col("i") + 2, F.size("o"))).alias("object"))
    candidates = pairs.withColumn("digest", digest("subject", F.lit(PREDICATE), "object", "outcome_id", F.array_join("a", ":")))
    # The first two records are of the candidate as a whole, the others of one supporting assertion each.
    rows = candidates.withColumn("assertion", name("ast", F.col("digest"))).select("*", F.posexplode(F.concat(F.array(F.lit(None).cast("string"), F.lit(None).cast("string")), "a")).alias("at", "support")).drop("a")
    by_kind = lambda assertion, relationship, edge: F.when(F.col("at") == 0, assertion).when(F.col("at") == 1, relationship).otherwise(edge)
    kind = by_kind(F.lit("assertion"), F.lit("relationship"), F.lit("argument_edge"))
    edge = name("arg", digest("support", F.lit(PREDICATE), "assertion"))
    rows = rows.withColumn("kind", kind).withColumn("record_id", by_kind(F.col("assertion"), name("rel", F.col("digest")), edge))
    label = F.concat_ws("_", "kind", "subject", F.lit(PREDICATE), "object", "outcome_id", F.when(F.col("at") > 1, F.col("record_id")))
    record_type = by_kind(F.lit("Assertion"), F.lit("Relationship"), F.lit("ArgumentEdge"))
    return rows.select(
        name("pcg", digest(F.lit(MINING), record_type, label)).alias("id"), "kind", "record_id", F.coalesce("support", "subject").alias("subject_id"),
        F.when(F.col("at") > 1, F.col("assertion")).otherwise(F.col("object")).alias("object_id"), "outcome_id", by_kind(F.lit(0.5), F.lit(None), F.lit(0.7)).cast("double").alias("confidence"),
    )


def closure(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """``node, depth`` of all that ``links(src, dst)`` lead to from ``seeds(node)``.

    Breadth first: each round joins the last round's nodes alone, and is
    checkpointed to the shared folder, so plans stay short and lost executors do no harm.
    """
    seen = seeds.select("node", F.lit(0).cast("long").alias("depth")).distinct()
    front = seen
    depth = 0
    while True:
        depth += 1
        found = front.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = durable(found.join(seen.select(F.col("node").alias("old")), F.col("node") == F.col("old"), "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if front.isEmpty():
            return seen
        seen = seen.union(front)


def cyclic(edges: DataFrame, group: str) -> DataFrame:
    """``group, cyclic`` of each group of ``edges(group, src, dst)``: whether some path comes back to where it began.

    Paths are doubled: after round k there is a row for each pair of nodes with a path of exactly 2 ** k edges, and each pair's
    paths are counted once. A group without a cycle runs out of pairs by the time paths are longer than it has
    nodes, so the rounds are the logarithm of the largest group. Self-links are cycles.
    """
    nodes = edges.select(group, F.explode(F.array("src", "dst")).alias("n")).groupBy(group).agg(F.count_distinct("n").alias("size"))
    pairs = durable(edges.select(group, "src", "dst").where("src is not null and dst is not null").distinct())
    most = nodes.agg(F.max("size")).first()[0] or 0
    length = 1
    while length <= most and not pairs.isEmpty():
        onward = pairs.select(F.col(group).alias("__g"), F.col("src").alias("__mid"), F.col("dst").alias("__end"))
        pairs = durable(pairs.join(onward, (F.col(group) == F.col("__g")) & (F.col("dst") == F.col("__mid"))).select(group, "src", F.col("__end").alias("dst")).distinct())
        length *= 2
    left = pairs.select(F.col(group).alias("__g")).distinct()
    return nodes.join(left, F.col(group) == F.col("__g"), "left").select(group, F.col("__g").isNotNull().alias("cyclic"))


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint in ``spark.checkpoint.dir``. Where that is unset, local sessions get a temporary folder; a cluster must name one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 1 in this order, without sorting all rows in one task.

    Rows are dealt into ranges, numbered within each, and shifted by the count of the ranges
    before; only one count for each range meets in one place.
    """
    dealt = durable(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__shift"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(F.broadcast(shifts), F.col("__range") == F.col("__r")).withColumn(name, (place + F.col("__shift")).cast("long")).drop("__range", "__r", "__n", "__shift")
