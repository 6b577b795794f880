"""Evidence records, each breaking one rule, and verification of attempts."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quillstone.operators import evidence

TEXT = "Alpha beta. Gamma delta. Gamma delta end"
SCHEMA = "target_id string, view_id long, start_char long, end_char long, exact_text string, prefix_text string, suffix_text string, view_digest string, node_start long, node_end long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def target(name, view=1, a=12, b=17, exact="Gamma", prefix="beta. ", suffix=" del", digest=None, node=(12, 24)):
    return (name, view, a, b, exact, prefix, suffix, digest or sha(TEXT), *node)


CASES = [
    (target("good"), None),
    (target("no view", view=9), "missing_view"),
    (target("stale", digest=sha("other")), "stale_view"),
    (target("outside", a=30, b=99), "outside_view"),
    (target("exact", exact="gamma"), "exact_text"),
    (target("prefix", prefix="Beta. "), "prefix"),
    (target("before", a=0, b=5, exact="Alpha", prefix="x", suffix=" ", node=(0, 11)), "prefix"),
    (target("suffix", suffix=" end"), "suffix"),
    (target("no node", node=(None, None)), "no_node"),
    (target("other node", node=(13, 24)), "outside_node"),
    (target("bare", prefix="", suffix=""), None),
    (target("empty view", view=2, a=0, b=0, exact="", prefix="", suffix="", digest=sha(""), node=(0, 0)), None),
]


def frames(spark):
    targets = spark.createDataFrame([c for c, _ in CASES], SCHEMA).withColumn("text", F.lit("clash"))
    return targets, spark.createDataFrame([(1, TEXT), (2, "")], "view_id long, text string")


def test_first_failing_check(spark):
    targets, views = frames(spark)
    assert {r.target_id: r.issue for r in evidence.replay(targets, views).collect()} == {c[0]: issue for c, issue in CASES}
    assert evidence.replay(targets.limit(0), views).count() == 0


def test_attempts_are_recorded_either_way(spark):
    out = {r.target_id: r for r in evidence.attempts(*frames(spark)).collect()}
    assert all((out[c[0]].status, out[c[0]].error) == ("failed" if issue else "succeeded", issue) for c, issue in CASES)
    assert len({r.attempt_id for r in out.values()}) == len(CASES)


def test_verification(spark):
    targets, views = frames(spark)
    made = {r.target_id: r for r in evidence.attempts(targets, views).collect()}
    record = lambda target, attempt, digest=None: (target, attempt.attempt_id, attempt.target_id, digest or attempt.target_digest, attempt.status)
    rows = [record("good", made["good"]), record("bare", made["good"]), record("exact", made["exact"]), record("good", made["good"], sha("old"))]
    rows.append(("stale", "x", "stale", made["stale"].target_digest, "succeeded"))
    out = evidence.verify(targets, spark.createDataFrame(rows, "for_target string, attempt_id string, target_id string, target_digest string, status string"), views)
    got = sorted((r.target_id, r.valid, r.error or "") for r in out.collect())
    assert got == [("bare", False, "other_target"), ("exact", False, "not_succeeded"), ("good", False, "stale_target"), ("good", True, ""), ("stale", False, "stale_view")]


def test_reanchoring_ties_to_the_first(spark):
    rows = [(f"t{i}", i, 0, 1, text, "", "", "", 0, 1) for i, text in [(3, "a"), (1, "a"), (2, "b"), (5, "a"), (7, "c")]]
    targets = spark.createDataFrame(rows, SCHEMA).withColumn("source", F.lit("s"))
    assert sorted((r.earlier_id, r.later_id) for r in evidence.reanchored(targets, "source").collect()) == [("t1", "t3"), ("t1", "t5")]
