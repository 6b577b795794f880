"""Batches that go through Python in slices give what whole ones give."""

from __future__ import annotations

import unicodedata

import pyarrow as pa

from quillstone.functions import text as X
from quillstone.operators import news

GOOD = '<newsItem guid="g{0}" version="1"><contentSet><inlineXML><p>text {0}</p><hl1>head</hl1></inlineXML></contentSet></newsItem>'


def test_slices_hold_a_bounded_size():
    texts = pa.array(["a" * 400_000, None, "b" * 500_000, "c" * 200_000, "d" * 3_000_000, "", "e"])
    cuts = list(X.text_slices(texts))
    assert cuts == [(0, 3), (3, 4), (4, 6), (6, 7)] or cuts[0] == (0, 3) and cuts[-1][1] == 7
    assert [i for a, b in cuts for i in range(a, b)] == list(range(7))
    assert all(b - a == 1 or sum(len(t or "") for t in texts[a:b].to_pylist()) <= X.SLICE for a, b in cuts)
    assert list(X.text_slices(texts[:0])) == []


def test_items_come_slice_by_slice():
    payloads = [GOOD.format(i) + " " * 300_000 for i in range(10)] + [None, "<x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(payloads)], ["id", "payload"])
    out = list(news._read(iter([batch])))
    assert len(out) >= 4 and [i for b in out for i in b.column(0).to_pylist()] == list(range(12))
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["error"] for r in rows] == [None] * 10 + ["malformed"] * 2
    assert rows[3]["body"] == [{"kind": "paragraph", "path": "p[1]", "text": "text 3"}, {"kind": "heading", "path": "hl1[1]", "text": "head"}]


def test_read_equals_the_column_function(spark):
    rows = spark.createDataFrame([(1, GOOD.format(1)), (2, None), (3, "<x"), (4, "<newsItem/>")], "id long, payload string")
    want = rows.select("id", news.newsml("payload").alias("i")).select("id", "i.*")
    got = news.read(rows, "payload")
    assert got.schema.simpleString() == want.schema.simpleString() and sorted(got.collect()) == sorted(want.collect())


def test_normal_form_in_slices(spark):
    texts = ["é" * 10, None, "", "plain", "가" * 600_000, "Å" * 400_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    assert {r.i: r.text for r in X.with_nfc(rows, "text").collect()} == {i: t and unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}
