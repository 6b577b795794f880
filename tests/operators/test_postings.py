"""The persistent index: scores, pruned reads, republication and failures."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import postings, search

UNITS = "representation string, unit long, text string"


def made(spark, seed, per=30):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["Straße", "café", "the", "the"]
    rows = [(rep, 100 * k + i, " ".join(r.choice(words) for _ in range(r.randrange(0, 60)))) for k, rep in enumerate(["a", "b/c", "5", None]) for i in range(per)]
    return spark.createDataFrame(rows + [("a", 999, None)], UNITS)


def files(folder):
    return {p: os.path.getmtime(p) for p in glob.glob(f"{folder}/postings/**/*.parquet", recursive=True)}


def scores(df):
    return {r.unit: r.score for r in df.collect()}


def test_scores_are_those_of_a_scan(spark, tmp_path):
    units = made(spark, 1)
    folder = str(tmp_path / "index")
    assert {r.outcome for r in postings.publish(units, folder).collect()} == {"created"}
    for words in (["the"], ["the", "cafe", "w3", "the"], ["straße", "absent"], ["absent"]):
        assert scores(postings.bm25(spark, folder, words)) == scores(search.bm25(units.select("unit", F.coalesce("text", F.lit("")).alias("text")), words))
    held = {r.representation: (r.n_units, r.total_size) for r in postings.manifests(spark, folder).collect()}
    assert held.keys() == {"a", "b/c", "5", None} and held["a"][0] == 31


def test_a_search_reads_the_bands_of_its_terms(spark, tmp_path):
    folder = str(tmp_path / "index")
    postings.publish(made(spark, 2), folder)
    plan = postings.lookup(spark, folder, ["the"])._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "Scan parquet" in line and "band" in line)
    assert "PartitionFilters: [" in scan and "band" in scan.split("PartitionFilters")[1] and "term" in scan.split("PushedFilters")[1]
    assert {r.band for r in postings.lookup(spark, folder, ["the"]).select("band").distinct().collect()} == {r.b for r in spark.range(1).select(postings.band_of(F.lit("the")).alias("b")).collect()}


def test_republishing_rewrites_one_representation(spark, tmp_path):
    folder = str(tmp_path / "index")
    units = made(spark, 3)
    postings.publish(units, folder)
    before = files(folder)
    assert {r.outcome for r in postings.publish(units, folder).collect()} == {"reused"} and files(folder) == before
    changed = units.where("representation = 'b/c'").withColumn("text", F.concat_ws(" ", "text", F.lit("fresh")))
    assert [(r.representation, r.outcome) for r in postings.publish(changed, folder, bands=3).collect()] == [("b/c", "replaced")]
    after = files(folder)
    mine = lambda p: "representation=b%2Fc" in p
    assert {p: t for p, t in before.items() if not mine(p)} == {p: t for p, t in after.items() if not mine(p)}
    assert not {p for p in before if mine(p)} & after.keys() and any(map(mine, after))
    now = units.where("not representation <=> 'b/c'").union(changed).select("unit", F.coalesce("text", F.lit("")).alias("text"))
    assert scores(postings.bm25(spark, folder, ["fresh", "the"])) == scores(search.bm25(now, ["fresh", "the"]))


def test_a_failed_publication_leaves_the_old_index(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "index")
    units = made(spark, 4)
    postings.publish(units, folder)
    old = scores(postings.bm25(spark, folder, ["the", "w1"]))
    whole = postings._posted
    monkeypatch.setattr(postings, "_posted", lambda u, bands: whole(u, bands).where("unit % 3 = 0"))
    with pytest.raises(postings.IncompleteIndex):
        postings.publish(units.withColumn("text", F.lit("the other text")), folder)
    assert scores(postings.bm25(spark, folder, ["the", "w1"])) == old


def test_no_index_and_no_units(spark, tmp_path):
    assert postings.bm25(spark, str(tmp_path / "none"), ["the"]).isEmpty()
    folder = str(tmp_path / "empty")
    assert postings.publish(spark.createDataFrame([], UNITS), folder).isEmpty() and postings.bm25(spark, folder, ["the"]).isEmpty()
    postings.publish(spark.createDataFrame([("a", 1, "")], UNITS), folder)
    assert postings.bm25(spark, folder, ["the"]).isEmpty() and postings.manifests(spark, folder).first().n_units == 1


def test_publishing_shuffles_postings_once(spark):
    units = made(spark, 5).withColumn("index_id", F.lit("i"))
    rows = postings._posted(units.withColumn("text", F.coalesce("text", F.lit(""))), 4)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("regexp_extract_all") == 1
    want = {}
    for r in units.collect():
        words = [w.lower().replace("é", "e") for w in (r.text or "").split()]
        for w in words:
            want[r.unit, w] = (words.count(w), len(words))
    assert {(r.unit, r.term): (r.tf, r.size) for r in rows.collect()} == want
