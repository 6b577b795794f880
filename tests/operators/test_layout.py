"""Reading order, references and cycles on small pages and graphs."""

from __future__ import annotations

import random

from quillstone.operators import graph, layout


def test_reading_order_by_headings_and_columns(spark):
    items = [("top", "furniture", 2, 10), ("foot", "furniture", 95, 10), ("h1", "heading", 20, 10), ("h2", "heading", 60, 10), ("before", "text", 10, 50)]
    items += [("right 1", "text", 25, 60), ("left 2", "text", 40, 11), ("left 1", "text", 30, 10), ("right 2", "text", 50, 61), ("level", "text", 60, 80), ("after", "text", 80, 10)]
    rows = [(page, n, k, float(t), float(x), 100.0, 100.0) for page in (1, 2) for n, k, t, x in items] + [(3, "alone", "text", 1.0, 1.0, 100.0, 100.0)]
    out = layout.reading_order(spark.createDataFrame(rows, "page int, item string, kind string, top_edge double, left_edge double, width double, height double").repartition(3)).collect()
    want = ["top", "before", "h1", "left 1", "left 2", "right 1", "right 2", "h2", "after", "level", "foot"]
    for page in (1, 2):
        assert [r.item for r in sorted((r for r in out if r.page == page), key=lambda r: r.place)] == want
    assert [(r.item, r.place) for r in out if r.page == 3] == [("alone", 0)]


def test_nearest_target_but_never_oneself(spark):
    targets = spark.createDataFrame([(1, "table 1", 4, 4), (1, "table 1", 10, 10), (1, "note", 6, 6), (2, "table 1", 1, 1)], "doc long, label string, node long, order_index long")
    markers = [(1, "table 1", 6, 6, 0, 7), (1, "table 1", 7, 7, 0, 7), (1, "table 1", 4, 4, 3, 9), (1, "note", 6, 6, 0, 4), (2, "table 2", 5, 5, 0, 7)]
    out = layout.cross_references(targets, spark.createDataFrame(markers, "doc long, label string, node long, order_index long, start_char long, end_char long"))
    assert sorted((r.doc, r.node, r.target) for r in out.collect()) == [(1, 4, 10), (1, 6, 4), (1, 7, 4)]


def test_cycles_against_a_walk(spark):
    r = random.Random(4)
    edges = [(g, r.randrange(8), r.randrange(8)) for g in range(60) for _ in range(r.randrange(1, 9))]
    edges += [(100, i, i + 1) for i in range(40)] + [(101, i, (i + 1) % 40) for i in range(40)] + [(102, 5, 5)] + [(103, 1, None)]

    def walk(pairs):
        left = {(a, b) for a, b in pairs if b is not None}
        while True:
            ends = {b for _, b in left}
            fewer = {(a, b) for a, b in left if a in ends}
            if fewer == left:
                return bool(left)
            left = fewer

    out = {x.g: x.cyclic for x in graph.cyclic(spark.createDataFrame(edges, "g int, src int, dst int"), "g").collect()}
    assert out == {g: walk([(a, b) for h, a, b in edges if h == g]) for g in {e[0] for e in edges}}
    assert graph.cyclic(spark.createDataFrame([], "g int, src int, dst int"), "g").count() == 0


def test_closure_goes_as_deep_as_there_are_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(12)], "src int, dst int")
    out = graph.closure(spark.createDataFrame([(0,)], "node int"), links)
    assert sorted((r.node, r.depth) for r in out.collect()) == [(i, i) for i in range(13)]


def test_columns_part_at_gaps(spark):
    items = [(1, "a", 10.0, 5.0), (1, "b", 20.0, 1.0), (1, "c", 200.0, 9.0), (1, "d", 210.0, 2.0), (1, "e", 290.0, 1.0), (2, "z", 1.0, 1.0)]
    df = spark.createDataFrame([(*i, 600.0) for i in items], "page int, item string, left_edge double, top_edge double, width double")
    got = {r.item: (r.column, r.place) for r in layout.columns(df).collect()}
    assert got == {"b": (0, 0), "a": (0, 1), "e": (1, 0), "d": (1, 1), "c": (1, 2), "z": (0, 0)}


def test_levels_by_height_or_as_declared(spark):
    rows = [("h", "a", "heading", 24.04, None), ("h", "b", "heading", 12.0, None), ("h", "c", "heading", 23.96, None), ("h", "d", "heading", None, 2), ("h", "t", "text", 99.0, None), ("d", "x", "heading", 9.0, 1), ("d", "y", "heading", 9.0, 3), ("d", "z", "heading", 99.0, None)]
    df = spark.createDataFrame(rows, "doc string, item string, kind string, text_height double, declared int")
    assert {r.item: r.level for r in layout.heading_levels(df).collect()} == {"a": 1, "c": 1, "b": 2, "d": 3, "x": 1, "y": 3, "z": 1}
