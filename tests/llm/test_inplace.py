"""Rows that a join leaves alone are not shuffled, and those that it finds are the same by either way."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontam, inplace, neardup, pii, store


@pytest.fixture(scope="module")
def texts(spark):
    """Long texts, hardly compressible: each twentieth a near copy, with a benchmark item or with an address; rows without doc_id or text."""
    r = random.Random(3)
    word = lambda: f"w{r.getrandbits(40):010x}w"
    item = [word() for _ in range(12)]
    rows, words = [], []
    for i in range(400):
        words = [*words[:-2], word()] if i % 20 == 1 else [word() for _ in range(900)]
        own = words + (item if i % 20 == 5 else []) + (["someone@example.org"] if i % 20 == 9 else [])
        rows.append((i, " ".join(own)))
    rows += [(None, rows[0][1]), (None, rows[5][1]), (None, rows[9][1]), (1000, None), (None, None)]
    return rows, store.stash(spark.createDataFrame(rows, "doc_id long, text string"), "texts"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")


def shuffled(spark):
    """Bytes that this application's stages have written for shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    jvm = context._jvm
    stages = context._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("most", [store.BROADCAST_BYTES, 1])
@pytest.mark.parametrize("name", ["keep_first", "clean", "with_text"])
def test_texts_without_a_match_stay_in_their_tasks(spark, texts, monkeypatch, name, most):
    rows, docs, benchmark = texts
    spans = store.stash(pii.sanitise(docs), "spans")
    monkeypatch.setattr(store, "BROADCAST_BYTES", most)
    stage, want = {
        "keep_first": (neardup.keep_first, [(i, t) for i, t in rows if i is None or i % 20 != 1]),
        "clean": (lambda d: decontam.clean(d, benchmark), [(i, t) for i, t in rows if t != rows[5][1] and (i is None or i % 20 != 5)]),
        "with_text": (lambda d: pii.with_text(d, spans), [(i, t and t.replace("someone@example.org", "[EMAIL]")) for i, t in rows]),
    }[name]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 1)
    try:
        before = shuffled(spark)
        out = store.stash(stage(docs), "out")
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    order = lambda them: sorted(map(tuple, them), key=str)
    assert order(out.collect()) == order(want)
    assert moved < 0.5 * sum(len(t or "") for _, t in rows)


def test_both_ways_find_the_same(spark, monkeypatch):
    """Strings and numbers, without keys, with a filter that has few bits for them, and null keys of rows."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 50 > 0, F.col("id") % 1000).alias("k"))
    for kind in ("long", "string"):
        own = rows.withColumn("k", F.col("k").cast(kind))
        for share in (7, 10**6):
            keys = spark.range(1, 5000).where(F.col("id") % share == 0).select(F.col("id").cast(kind).alias("key"))
            held = {r.key for r in keys.collect()}
            for most, least in ((store.BROADCAST_BYTES, inplace.LEAST_BITS), (1, inplace.LEAST_BITS), (1, 64)):
                monkeypatch.setattr(store, "BROADCAST_BYTES", most)
                monkeypatch.setattr(inplace, "LEAST_BITS", least)
                found = {r.id for r in inplace.among(own, F.col("k"), keys, F.lit(16)).collect()}
                left = {r.id for r in inplace.without(own, F.col("k"), keys, F.lit(16)).collect()}
                want = {r.id for r in own.collect() if r.k in held}
                assert found == want and left == set(range(3000)) - want
            monkeypatch.undo()
