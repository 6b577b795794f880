"""Streaming folds over a folder of files against the batch answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstone.plans.harness import repair_history
from quillstone.streaming import folds

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def events(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.select("event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).sortWithinPartitions("ts", "event_id").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(folds.EVENT).parquet(str(tmp_path / "in"))


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_repairs_equal_the_batch_fold(spark, events):
    out = run(folds.repairs(events), "repairs", "update")
    last = {r.user_id: r.n_repairs for r in out.groupBy("user_id").agg(F.max("n_repairs").alias("n_repairs")).collect()}
    want = {r.user_id: r.n_repairs for r in repair_history(spark, SF).collect()}
    assert {u: n for u, n in last.items() if n} == {u: n for u, n in want.items() if n}


def test_replays_are_dropped(spark, events):
    out = run(folds.without_replays(events.union(events)), "once", "append")
    assert out.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_windows_add_up(spark, events):
    out = run(folds.windowed_counts(events), "windows", "append")
    assert 0 < out.agg(F.sum("n")).first()[0] <= spark.read.parquet(f"{SF}/events.parquet").count()


def test_unclosed_starts(events):
    out = run(folds.unclosed_starts(events), "unclosed", "append")
    assert out.columns == ["start_id", "start_user", "started_at"]
