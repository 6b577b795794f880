"""Pairs of words that open no line of their document go before any row is shuffled."""

from __future__ import annotations

from quillstone.plans import documents

TEXT = "red fox ran\nthe red fox sat\nx\nblue jay saw the red fox"


def _rows(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "saw the"), (3, None)], "doc_id long, text string")
    return sorted((r.doc, r.order_index, r.at, r.label) for r in documents._mentions(docs).collect())


def test_only_pairs_that_open_a_line_are_kept(spark):
    assert _rows(spark) == [(1, 0, 0, "red fox"), (1, 1, 0, "the red"), (1, 1, 1, "red fox"), (1, 3, 0, "blue jay"), (1, 3, 3, "the red"), (1, 3, 4, "red fox"), (2, 0, 0, "saw the")]


def test_a_document_with_very_many_openings_keeps_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(documents, "OPENINGS", 2)
    assert len(_rows(spark)) == 2 + 3 + 5 + 1
