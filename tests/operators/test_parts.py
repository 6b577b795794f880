"""What one task holds: rows are dealt by their number, and texts stay where they are digested."""

from __future__ import annotations

import hashlib

from quillstone.operators import bundles, graph, layout


def test_parts_grow_with_the_rows(spark):
    rows = spark.range(10).withColumnRenamed("id", "key")
    assert graph.dealt(rows, 12 * graph.SHARE, "key").rdd.getNumPartitions() == 13


def test_digests_of_nodes_within_over_and_beyond_pieces(spark):
    text = "".join(chr(97 + i % 23) for i in range(3 * bundles.PIECE))
    spans = {"all": (0, len(text)), "beyond": (0, len(text) + 5), "within": (10, 20), "over": (bundles.PIECE - 3, bundles.PIECE + 4), "end": (len(text) - 2, len(text) + 9)}
    views = spark.createDataFrame([("b", "v", text)], "bundle string, view string, text string")
    nodes = spark.createDataFrame([("b", "v", n, a, z) for n, (a, z) in spans.items()], "bundle string, view string, node string, start_char long, end_char long")
    got = {r.s_node: r.span_digest for r in bundles.digests(views, nodes).collect()}
    assert got == {n: hashlib.sha256(text[a:z].encode()).hexdigest() for n, (a, z) in spans.items()}


def test_pages_are_dealt_by_the_number_of_their_items(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARE", 2)
    items = spark.createDataFrame([(p, f"i{n}", "text", float(n), 0.0, 10.0, 10.0) for p in range(4) for n in range(5)], "page int, item string, kind string, top_edge double, left_edge double, width double, height double")
    ordered = layout.reading_order(items)
    assert ordered.rdd.getNumPartitions() == 11
    assert sorted((r.page, r.item, r.place) for r in ordered.collect()) == [(p, f"i{n}", n) for p in range(4) for n in range(5)]


def test_groups_are_dealt_by_the_number_of_their_rows(spark, monkeypatch, capsys):
    monkeypatch.setattr(graph, "SHARE", 2)
    rows = spark.createDataFrame([(g, m) for g in range(4) for m in range(5)], "g int, m int")
    pairs = graph.cooccurrence(rows, "g", "m", least=2)
    pairs.explain()
    assert "hashpartitioning(g" in (plan := capsys.readouterr().out) and ", 11), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, pairs.collect())) == [(a, b, 4) for a in range(5) for b in range(a + 1, 5)]
