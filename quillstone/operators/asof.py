"""As-of joins: each row with the latest row of a history at its own time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days that are put in order in one task.
GRAIN_DAYS = 32


def _grain(at: Column) -> Column:
    return F.floor(F.date_diff(at, F.lit("1970-01-01")) / GRAIN_DAYS)


def asof(rows: DataFrame, history: DataFrame, by: str, at: str, since: str) -> DataFrame:
    """``rows`` with a struct ``then``: the row of ``history`` of the same ``by`` with the greatest ``since`` that is not after ``at``; null if there is none.

    One pass instead of a range join: both sides are put in order of time, and a running last value carries the history to the rows. Keys are dealt with
    their time, GRAIN_DAYS in a task, so a key of a third of all rows is many tasks; what holds at the start of each stretch is one row a key and stretch, carried
    over by a window of its own. Of several history rows of one time the greatest counts. Nulls in ``by`` or a time match nothing; rows that have them
    stay. History columns may have any names but ``by``.
    """
    names = [c for c in history.columns if c != by]
    known = history.where(F.col(by).isNotNull() & F.col(since).isNotNull())
    fact = F.struct(F.col(since).alias("since"), F.struct(*[F.col(c).alias(c) for c in names]).alias("is"))
    facts = known.select(F.col(by).alias("k"), _grain(F.col(since)).alias("g"), F.col(since).alias("t"), fact.alias("fact"))
    own = rows.select(F.col(by).alias("k"), _grain(F.col(at)).alias("g"), F.col(at).alias("t"), F.struct(*[F.col(c) for c in rows.columns]).alias("row"))
    # What holds when a stretch begins: the last fact of the stretches before it.
    last = facts.groupBy("k", "g").agg(F.max("fact").alias("fact"))
    asked = last.unionByName(own.where("k is not null and t is not null").select("k", "g").distinct(), allowMissingColumns=True).groupBy("k", "g").agg(F.max("fact").alias("fact"))
    held = asked.select("k", "g", F.last("fact", ignorenulls=True).over(Window.partitionBy("k").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)).alias("fact")).where("fact is not null")
    lists = [held.select("k", "g", F.lit(None).cast(rows.schema[at].dataType).alias("t"), "fact"), facts, own]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)
    w = Window.partitionBy("k", "g").orderBy(F.col("t").asc_nulls_first(), F.col("row").isNotNull(), "fact").rowsBetween(Window.unboundedPreceding, 0)
    told = both.select("k", "t", "row", F.last("fact", ignorenulls=True).over(w).alias("then")).where("row is not null")
    return told.select("row.*", F.when(F.col("k").isNotNull() & F.col("t").isNotNull(), F.col("then")["is"]).alias("then"))
