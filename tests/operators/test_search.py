"""Anchors, BM25 and digests against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillstone.operators import report, search
from quillstone.operators.digests import set_digest

WORDS = ["art", "of", "part", "the", "smart", "ofthe", "x", "end"]


def test_anchors_are_literals(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(WORDS) for _ in range(30)) + r.choice(["", ".", "--"]) for _ in range(40)] + ["", None, "--"]
    anchors = ["art of", "part of the", "art of the x", "--", "the", "no such words here", "t o", "x end x", ".", "art  of the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("word", F.lit("clash"))
    out = search.occurrences(docs, spark.createDataFrame(list(enumerate(anchors)), "item_id long, text string")).collect()
    want = {i: (sum(a in (t or "") for t in texts), sum((t or "").count(a) for t in texts)) for i, a in enumerate(anchors)}
    assert {x.item_id: (x.n_documents, x.n_occurrences) for x in out} == want


def test_bm25(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 40))) for _ in range(60)]
    query = ["art", "end", "art"]
    tokens = [Counter(re.findall(r"\w+", t)) for t in texts]
    mean = sum(map(lambda c: c.total(), tokens)) / len(texts)
    want = {}
    for i, c in enumerate(tokens):
        score = 0.0
        for w, n in Counter(query).items():
            df = sum(w in d for d in tokens)
            idf = math.log((len(texts) - df + 0.5) / (df + 0.5))
            score -= n * (idf if idf > 0 else 1e-6) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean))
        if any(c[w] for w in query):
            want[i] = round(score, 6)
    got = {x.unit: x.score for x in search.bm25(spark.createDataFrame(list(enumerate(texts)), "unit long, text string"), query).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)


def test_terms_have_no_diacritics(spark):
    docs = spark.createDataFrame([(1, "Un café noir"), (2, "the CAFE\u0301 bar"), (3, "cafes"), (4, None), (5, "Łódź naïve")], "unit long, text string")
    assert {x.unit for x in search.bm25(docs, ["cafe"]).collect()} == {1, 2}
    assert {x.unit for x in search.bm25(docs, ["naive", "łodz"]).collect()} == {5}


def test_set_digests_follow_the_multiset(spark):
    rows = [("a", str(i)) for i in range(500)] + [("b", str(i)) for i in range(499, -1, -1)] + [("c", str(i)) for i in range(500)] + [("c", "0")] + [("d", "7")]
    df = spark.createDataFrame(rows, "g string, v string").select("g", F.sha2("v", 256).alias("d"))
    out = {r.g: r.digest for r in set_digest(df.repartition(7), ["g"], "d").collect()}
    assert out["a"] == out["b"] and len(set(out.values())) == 3
    assert out == {r.g: r.digest for r in set_digest(df.repartition(2, "d"), ["g"], "d").collect()}


def test_reports(spark):
    reports = spark.createDataFrame([(1, ["# One", ""]), (2, ["# Two", ""])], "report long, head array<string>")
    rows = spark.createDataFrame([(1, 2, "- b"), (1, 1, "- a")], "report long, at long, line string")
    out = {r.report: r.markdown for r in report.render(reports, [("First", ["| h |"], rows), ("Last", [], rows.limit(0))]).collect()}
    assert out[1] == "# One\n\n## First\n\n| h |\n- a\n- b\n\n## Last\n\n- None\n"
    assert out[2] == "# Two\n\n## First\n\n- None\n\n## Last\n\n- None\n"
    assert spark.range(1).select(report.citations(F.array(F.lit(1), F.lit(2))).alias("c")).first().c == "[1][2]"
