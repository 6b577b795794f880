"""Typed references between records: what a selection needs to be complete, and trees of parents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.graph import durable


@dataclass(frozen=True)
class Link:
    """References ``rows(src, dst)`` from records of one type to records of another."""

    src_type: str
    dst_type: str
    rows: DataFrame


class DanglingReference(LookupError):
    """A record that is needed isn't there."""


def closure(records: dict[str, DataFrame], links: dict[str, Link], seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``reached(type, id, depth)`` and ``missing(link, src, dst_type, dst)`` from ``seeds(type, id)``.

    ``records`` has a table ``id`` for each type. Semi-naive: a round has a delta of the records found in the round before, by type, and joins
    each kind of link with the delta of its source type alone; links whose source type found nothing new are not read. A record is found once, so
    cycles end. A reference to a record that isn't there is told once for each record that makes it, and leads no further; a seed that isn't there has
    the link ``seed`` and no source. Null references are none. Each delta is written to the shared folder, so plans stay short.
    """
    wanted = durable(seeds.select("type", "id").where("id is not null").distinct())
    found = wanted.select(F.lit("seed").alias("link"), F.lit(None).cast("string").alias("src"), "type", "id")
    reached = missing = None
    depth = 0
    while True:
        checked = durable(_checked(found, records))
        absent = checked.where("not there").select("link", "src", F.col("type").alias("dst_type"), F.col("id").alias("dst"))
        new = checked.where("there").select("type", "id").distinct()
        if reached is not None:
            old = reached.select(F.col("type").alias("o_type"), F.col("id").alias("o_id"))
            new = new.join(old, (F.col("type") == F.col("o_type")) & (F.col("id") == F.col("o_id")), "left_anti")
        delta = durable(new.withColumn("depth", F.lit(depth).cast("long")))
        reached = delta if reached is None else reached.union(delta)
        missing = absent if missing is None else missing.union(absent)
        types = {r["type"] for r in delta.select("type").distinct().collect()}  # of the types at hand
        steps = [_step(delta, name, link) for name, link in links.items() if link.src_type in types]
        if not steps:
            return reached, missing
        found = reduce(DataFrame.union, steps)
        depth += 1


def _step(delta: DataFrame, name: str, link: Link) -> DataFrame:
    """What one kind of link leads to from the records that were just found."""
    own = delta.where(F.col("type") == link.src_type).select(F.col("id").alias("from_id"))
    rows = link.rows.where("dst is not null").join(own, F.col("src") == F.col("from_id"), "left_semi")
    return rows.select(F.lit(name).alias("link"), F.col("src").cast("string").alias("src"), F.lit(link.dst_type).alias("type"), F.col("dst").alias("id")).distinct()


def _checked(found: DataFrame, records: dict[str, DataFrame]) -> DataFrame:
    """``found`` with whether each record is ``there``; each type's records are joined by themselves."""
    parts = []
    for name, rows in records.items():
        known = rows.select(F.col("id").alias("known")).distinct()
        mine = found.where(F.col("type") == name)
        parts.append(mine.join(known, F.col("id") == F.col("known"), "left").select("link", "src", "type", "id", F.col("known").isNotNull().alias("there")))
    other = found.where(~F.col("type").isin(*records)).withColumn("there", F.lit(False))
    return reduce(DataFrame.union, [*parts, other])


def require(missing: DataFrame) -> None:
    """Raise DanglingReference with the first few of these references, if there are any."""
    rows = missing.orderBy("link", "src", "dst").limit(5).collect()
    if rows:
        raise DanglingReference("; ".join(f"{r['link']}: {r['src']} -> {r['dst_type']} {r['dst']}" for r in rows))


def rooted(nodes: DataFrame, by: str) -> DataFrame:
    """``by, id, top, depth, state, n_rows`` of each node of ``nodes(by, id, parent)``, where ``by`` names its tree.

    ``state``: ``root`` (no parent), ``orphan`` (its parent is not in the tree), ``child`` (``top`` is the root or orphan above it, ``depth`` steps up) or
    ``cyclic`` (no way up ends; ``top`` and ``depth`` are null). Pointer jumping: in each round every node that hasn't arrived takes over the
    pointer of the node it points to, so pointers double and the rounds are the logarithm of the depth. A round in which nobody arrives
    leaves cycles and what hangs on them. No pairs of nodes are made. Repeated ids count as one with their least parent, and ``n_rows`` says how many there were.
    """
    plain = nodes.where("id is not null").groupBy(by, "id").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n_rows"))
    ids = plain.select(F.col(by).alias("p_by"), F.col("id").alias("p_id"))
    own = plain.join(ids, F.col(by).eqNullSafe(F.col("p_by")) & (F.col("parent") == F.col("p_id")), "left")
    state = F.when(F.col("parent").isNull(), "root").when(F.col("p_id").isNull(), "orphan").otherwise("child")
    ends = state != "child"
    at = durable(own.select(by, "id", "n_rows", state.alias("state"), F.when(ends, F.col("id")).otherwise(F.col("parent")).alias("top"), F.when(ends, 0).otherwise(1).cast("long").alias("depth"), ends.alias("there")))
    open_ = at.where("not there").count()
    while open_:
        via = at.select(F.col(by).alias("v_by"), F.col("id").alias("v_id"), F.col("top").alias("v_top"), F.col("depth").alias("v_depth"), F.col("there").alias("v_there"))
        moved = at.where("not there").join(via, F.col(by).eqNullSafe(F.col("v_by")) & (F.col("top") == F.col("v_id")))
        moved = moved.select(by, "id", "n_rows", "state", F.col("v_top").alias("top"), (F.col("depth") + F.col("v_depth")).alias("depth"), F.col("v_there").alias("there"))
        at = durable(at.where("there").union(moved))
        left = at.where("not there").count()
        if left == open_:
            break
        open_ = left
    arrived = lambda c: F.when(F.col("there"), F.col(c))
    return at.select(by, "id", arrived("top").alias("top"), arrived("depth").alias("depth"), F.when(F.col("there"), F.col("state")).otherwise("cyclic").alias("state"), "n_rows")


def trees(nodes: DataFrame, by: str) -> DataFrame:
    """``by, n_nodes, n_roots, n_orphans, n_cyclic, n_repeated, depth, valid`` of each tree: valid ones have one root, which all nodes reach, and no id twice."""
    at = rooted(nodes, by)
    is_ = lambda s: F.count_if(F.col("state") == s)
    out = at.groupBy(by).agg(F.count(F.lit(1)).alias("n_nodes"), is_("root").alias("n_roots"), is_("orphan").alias("n_orphans"), is_("cyclic").alias("n_cyclic"), F.sum(F.col("n_rows") - 1).alias("n_repeated"), F.max("depth").alias("depth"))
    return out.withColumn("valid", (F.col("n_roots") == 1) & (F.col("n_orphans") == 0) & (F.col("n_cyclic") == 0) & (F.col("n_repeated") == 0))


def replied_to(turns: DataFrame, by: str, order: str, role: str) -> DataFrame:
    """``by, id, parent``: each turn's parent is the latest earlier turn of another role.

    In a run of turns of one role that is the turn before the run, which one running value holds.
    """
    w = Window.partitionBy(by).orderBy(order)
    begins = F.lag(role).over(w).isNull() | (F.lag(role).over(w) != F.col(role))
    rows = turns.select(by, F.col(order).alias("id"), F.when(begins, F.struct(F.lag(order).over(w).alias("at"))).alias("run"))
    return rows.select(by, "id", F.last("run", ignorenulls=True).over(Window.partitionBy(by).orderBy("id").rowsBetween(Window.unboundedPreceding, 0))["at"].alias("parent"))
