"""Profiles and decisions before, at and after each bound."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstone.operators import asof as A
from quillstone.operators import rights

AT = datetime(2024, 5, 1)
FACTS = "name string, archive_permitted boolean, signals array<string>, embargo_until timestamp_ntz, entitlement_expires_at timestamp_ntz, evaluated_at timestamp_ntz"
ALL = set(rights.PURPOSES) - {"public_fixture"}


@pytest.mark.parametrize(
    "signals, embargo, expires, archive, refused, purposes",
    [
        ([], None, None, True, None, ALL),
        (None, None, None, True, None, ALL),
        (["x:Redistributable"], None, None, True, None, set(rights.PURPOSES)),
        (["sig:RESTRICTED"], None, None, True, None, set(rights.HELD_BACK)),
        (["a:b:no-model", "no-export"], None, None, True, None, ALL - {"model_context", "export"}),
        (["withheld", "no-review"], None, None, True, None, {"archive", "diagnostic"}),
        ([], AT, None, True, None, ALL),
        ([], AT + timedelta(seconds=1), None, True, None, set(rights.HELD_BACK)),
        ([], None, AT, True, "entitlement_expired", set()),
        ([], None, AT + timedelta(seconds=1), True, None, ALL),
        ([], None, None, False, "archive_not_permitted", set()),
        ([], None, None, None, "archive_not_permitted", set()),
        (["unknown", ""], None, None, True, None, ALL),
    ],
)
def test_profiles(spark, signals, embargo, expires, archive, refused, purposes):
    row = rights.profiles(spark.createDataFrame([("x", archive, signals, embargo, expires, AT)], FACTS)).first()
    assert (row.refused, row.purposes) == (refused, sorted(purposes))


def test_decisions_as_of_a_time(spark):
    second = timedelta(seconds=1)
    history = [
        ("p", AT, rights.POLICY, ["archive", "export"], AT + 10 * second, AT + 20 * second),
        ("p", AT + 30 * second, "other", ["archive"], None, None),
        ("p", AT + 40 * second, rights.POLICY, ["archive"], None, None),
    ]
    profiles = spark.createDataFrame(history, "provider string, evaluated_at timestamp_ntz, policy string, purposes array<string>, embargo_until timestamp_ntz, entitlement_expires_at timestamp_ntz")
    asked = [(-1, "export", "no_profile"), (0, "export", "embargo_active"), (0, "archive", "permitted"), (0, "review", "purpose_not_permitted"), (9, "export", "embargo_active"), (10, "export", "permitted"), (11, "export", "permitted"), (19, "export", "permitted"), (20, "export", "entitlement_expired"), (29, "archive", "entitlement_expired"), (30, "archive", "rights_policy_mismatch"), (39, "archive", "rights_policy_mismatch"), (40, "archive", "permitted"), (41, "export", "purpose_not_permitted")]
    uses = [("p", p, AT + s * second, i) for i, (s, p, _) in enumerate(asked)] + [("q", "archive", AT, 90), (None, "archive", AT, 91), ("p", "archive", None, 92)]
    got = rights.authorize(spark.createDataFrame(uses, "provider string, purpose string, at timestamp_ntz, n int"), profiles)
    assert got.columns == ["provider", "purpose", "at", "n", "decision"]
    assert {r.n: r.decision for r in got.collect()} == {i: d for i, (*_, d) in enumerate(asked)} | {90: "no_profile", 91: "no_profile", 92: "no_profile"}


def test_asof_equals_a_search(spark, monkeypatch):
    """A hot key over many stretches, ties, and rows before the first fact."""
    monkeypatch.setattr(A, "GRAIN_DAYS", 5)
    r = random.Random(8)
    day = lambda: AT + timedelta(days=r.randrange(120), hours=6 * r.randrange(4))
    history = [(r.choice("hhhk"), day(), i) for i in range(60)] + [(None, AT, 70), ("h", None, 71)]
    rows = [(r.choice("hhhkz"), day(), i) for i in range(300)]
    got = A.asof(spark.createDataFrame(rows, "k string, at timestamp_ntz, n int"), spark.createDataFrame(history, "k string, since timestamp_ntz, v int"), "k", "at", "since")
    want = {n: max(((s, v) for hk, s, v in history if hk == k and s is not None and s <= at), default=(None, None))[1] for k, at, n in rows}
    assert {x.n: x["then"]["v"] if x["then"] else None for x in got.collect()} == want
    assert got.select(F.count("*")).first()[0] == 300
