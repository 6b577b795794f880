"""What a text may be used for: profiles from a provider's signals, and decisions as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.asof import asof

# The purposes, those that stay under an embargo or a restriction, and the purpose that each signal takes away.
PURPOSES = ("archive", "body_text", "log", "diagnostic", "public_fixture", "export", "search_index", "embedding", "model_context", "review", "briefing", "graph_publication")
HELD_BACK = ("archive", "diagnostic", "review")
WITHDRAWN = {"no-model": "model_context", "no-body": "body_text", "no-log": "log", "no-export": "export", "no-index": "search_index", "no-embed": "embedding", "no-review": "review", "no-briefing": "briefing", "no-graph": "graph_publication"}
OPEN = ("public-fixture", "redistributable")
CLOSED = ("restricted", "withheld")
POLICY = "rights-policy-v1"


def _texts(values) -> Column:
    return F.array(*map(F.lit, values))


def suffixes(signals: Column) -> Column:
    """The signals in lower case, without what stands before their last colon."""
    return F.transform(F.coalesce(signals, F.array().cast("array<string>")), lambda s: F.lower(F.substring_index(s, ":", -1)))


def allowed(signals: Column, embargoed: Column) -> Column:
    """The purposes that signals leave, sorted, by set algebra."""
    given = suffixes(signals)
    left = F.when(F.arrays_overlap(given, _texts(OPEN)), _texts(PURPOSES)).otherwise(F.array_except(_texts(PURPOSES), _texts(["public_fixture"])))
    closed = F.coalesce(embargoed, F.lit(False)) | F.coalesce(F.arrays_overlap(given, _texts(CLOSED)), F.lit(False))
    left = F.when(closed, F.array_intersect(left, _texts(HELD_BACK))).otherwise(left)
    gone = F.filter(F.transform(given, lambda s: F.element_at(F.create_map(*[F.lit(x) for pair in WITHDRAWN.items() for x in pair]), s)), lambda p: p.isNotNull())
    return F.array_sort(F.array_except(left, gone))


def profiles(facts: DataFrame) -> DataFrame:
    """``facts`` with ``refused`` and ``purposes``.

    ``facts`` has ``archive_permitted, signals, embargo_until, entitlement_expires_at, evaluated_at``. A profile is refused, and has no purposes, where archiving isn't
    permitted (null counts so) or the entitlement has expired when it is evaluated; an embargo holds until after its time.
    """
    expired = F.coalesce(F.col("entitlement_expires_at") <= F.col("evaluated_at"), F.lit(False))
    refused = F.when(~F.coalesce("archive_permitted", F.lit(False)), "archive_not_permitted").when(expired, "entitlement_expired")
    embargoed = F.col("embargo_until") > F.col("evaluated_at")
    return facts.withColumn("refused", refused).withColumn("purposes", F.when(F.col("refused").isNull(), allowed(F.col("signals"), embargoed)).otherwise(F.array().cast("array<string>")))


def decision(profile: Column, purpose: Column, at: Column, policy: str = POLICY) -> Column:
    """The first reason that holds for a use of a profile ``struct<policy, purposes, embargo_until, entitlement_expires_at>``, or ``permitted``.

    An entitlement has expired at its time and after; an embargo holds before its time. Without a profile nothing is permitted.
    """
    return (
        F.when(profile.isNull(), "no_profile")
        .when(~F.coalesce(profile["policy"] == policy, F.lit(False)), "rights_policy_mismatch")
        .when(profile["entitlement_expires_at"] <= at, "entitlement_expired")
        .when((profile["embargo_until"] > at) & ~purpose.isin(*HELD_BACK), "embargo_active")
        .when(~F.coalesce(F.array_contains(profile["purposes"], purpose), F.lit(False)), "purpose_not_permitted")
        .otherwise("permitted")
    )


def authorize(uses: DataFrame, history: DataFrame, by: str = "provider") -> DataFrame:
    """``uses(by, purpose, at, ...)`` with ``decision``, each by the profile of ``history(by, evaluated_at, policy, purposes, ...)`` that was valid at its time."""
    met = asof(uses, history, by, "at", "evaluated_at")
    return met.select(*uses.columns, decision(F.col("then"), F.col("purpose"), F.col("at")).alias("decision"))
