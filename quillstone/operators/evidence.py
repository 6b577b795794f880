"""Evidence targets: replayed against their text views, attempted, verified and anchored anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import record_id

SELECTOR = ("start_char", "end_char", "exact_text", "prefix_text", "suffix_text")


def target_digest() -> Column:
    """The digest of a target's identity and selectors."""
    return F.sha2(F.concat_ws("|", "target_id", *[F.col(c).cast("string") for c in SELECTOR], "view_digest"), 256)


def replay(targets: DataFrame, views: DataFrame) -> DataFrame:
    """``targets`` with ``issue``: the first check that fails on the pinned view, or null.

    ``targets(target_id, view_id, start_char, end_char, exact_text, prefix_text, suffix_text, view_digest, node_start, node_end)``;
    ``views(view_id, text)``. A view's targets meet its text in one row, so that no text is copied for each of them.
    """
    names = targets.columns
    own = targets.groupBy(F.col("view_id").alias("t_view")).agg(F.collect_list(F.struct(*names)).alias("targets"))
    rows = own.join(views.select("view_id", "text"), F.col("t_view") == F.col("view_id"), "left").select("targets", "text", F.sha2("text", 256).alias("digest"), F.length("text").alias("length"))
    part = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))

    def issue(t: Column) -> Column:
        before, after = t["start_char"] - F.length(t["prefix_text"]), t["end_char"] + F.length(t["suffix_text"])
        return (
            F.when(F.col("text").isNull(), "missing_view")
            .when(t["view_digest"] != F.col("digest"), "stale_view")
            .when(t["end_char"] > F.col("length"), "outside_view")
            .when(part(t["start_char"], t["end_char"]) != t["exact_text"], "exact_text")
            .when((before < 0) | (part(before, t["start_char"]) != t["prefix_text"]), "prefix")
            .when(part(t["end_char"], after) != t["suffix_text"], "suffix")
            .when(t["node_start"].isNull(), "no_node")
            .when((t["node_start"] > t["start_char"]) | (t["node_end"] < t["end_char"]), "outside_node")
        )

    checked = rows.select(F.explode(F.transform("targets", lambda t: F.struct(*[t[c].alias(c) for c in names], issue(t).alias("issue")))).alias("t"))
    return checked.select("t.*")


def attempts(targets: DataFrame, views: DataFrame) -> DataFrame:
    """One validation attempt for each target: ``attempt_id, target_id, target_digest, status, error``."""
    done = replay(targets, views)
    digest = target_digest()
    status = F.when(F.col("issue").isNull(), "succeeded").otherwise("failed")
    return done.select(record_id("eva", "target_id", digest).alias("attempt_id"), "target_id", digest.alias("target_digest"), status.alias("status"), F.col("issue").alias("error"))


def verify(targets: DataFrame, recorded: DataFrame, views: DataFrame) -> DataFrame:
    """``target_id, attempt_id, valid, error`` of each recorded attempt ``(for_target, attempt_id, target_id, target_digest, status)``.

    An attempt that was recorded for a target must belong to it, must have succeeded on what the target says now, and must still replay.
    """
    now = replay(targets, views).select(F.col("target_id").alias("own_id"), target_digest().alias("own_digest"), "issue")
    rows = now.join(recorded, F.col("own_id") == F.col("for_target"))
    error = (
        F.when(F.col("target_id") != F.col("own_id"), "other_target")
        .when(F.col("status") != "succeeded", "not_succeeded")
        .when(F.col("target_digest") != F.col("own_digest"), "stale_target")
        .otherwise(F.col("issue"))
    )
    return rows.select(F.col("own_id").alias("target_id"), "attempt_id", error.isNull().alias("valid"), error.alias("error"))


def reanchored(targets: DataFrame, within: str) -> DataFrame:
    """``relation_id, earlier_id, later_id``: each target after the first of those with the same text ``within`` a source, tied to that first one.

    The first is an aggregate, so a text that very many targets share is summed up in each task before anything meets.
    """
    key = [F.col(within).alias("w"), F.sha2("exact_text", 256).alias("d")]
    place = F.struct("view_id", "start_char", "target_id")
    first = targets.groupBy(*key).agg(F.min(place).alias("first"))
    rows = targets.select(*key, place.alias("own")).join(first.select(F.col("w").alias("f_w"), F.col("d").alias("f_d"), "first"), (F.col("w") == F.col("f_w")) & (F.col("d") == F.col("f_d")))
    earlier, later = F.col("first.target_id"), F.col("own.target_id")
    return rows.where(F.col("own") > F.col("first")).select(record_id("err", earlier, later).alias("relation_id"), earlier.alias("earlier_id"), later.alias("later_id"))
