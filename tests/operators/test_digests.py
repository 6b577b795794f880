"""Digests of whole ordered lists, however batches are cut."""

from __future__ import annotations

import hashlib

from quillstone.operators.digests import list_digest


def test_groups_go_on_over_batches(spark):
    rows = [(g, i) for g in (1, 2, None) for i in range(25_000 if g == 1 else 3)] + [(7, None), (8, None), (8, 5)]
    got = {r.g: (r.n, r.digest) for r in list_digest(spark.createDataFrame(rows, "g long, i long"), "g", "i").collect()}
    sha = lambda ids: hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    assert got == {1: (25_000, sha(range(25_000))), 2: (3, sha(range(3))), None: (3, sha(range(3))), 7: (1, None), 8: (2, sha([5]))}


def test_equal_sums_are_told_apart(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "23"), ("b", "12"), ("b", "3")], "g string, i string")
    assert len({r.digest for r in list_digest(rows, "g", "i").collect()}) == 2
    assert list_digest(rows.limit(0), "g", "i").isEmpty()
