"""Bundles with each rule broken once, hits against their texts, and quotes with their contexts."""

from __future__ import annotations

import hashlib

import pytest

from quillstone.operators import bundles, quotes

TEXT = "Heading\né line 😀 two\n\nlast"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
NODES = "bundle string, node string, view string, parent string, node_type string, start_char long, end_char long, regions array<string>, pages array<int>, digest string"
SCHEMAS = {
    "views": "bundle string, view string, kind string, text string",
    "nodes": NODES,
    "regions": "bundle string, region string, page int, left double, top double, right double, bottom double",
    "edges": "bundle string, edge string, src string, dst string",
    "selectors": "bundle string, node string, digest string",
    "bundles": "bundle string",
}


def valid(b="b"):
    return {
        "views": [(b, "l", "logical", TEXT), (b, "d", "display", TEXT)],
        "nodes": [(b, "root", "l", None, "document", 0, 26, [], [], None), (b, "h", "l", "root", "heading", 0, 7, ["r1"], [1], sha("Heading")), (b, "p", "l", "root", "paragraph", 8, 20, ["r2", "r3"], [1, 2], sha("é line 😀 two"))],
        "regions": [(b, "r1", 1, 0.0, 0.0, 5.0, 1.0), (b, "r2", 1, 0.0, 1.0, 5.0, 2.0), (b, "r3", 2, 0.0, 0.0, 5.0, 1.0)],
        "edges": [(b, "e", "h", "p")],
        "selectors": [(b, "h", sha("Heading"))],
        "bundles": [(b,)],
    }


def told(spark, tables):
    frames = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in tables.items()}
    return sorted((r.rule, r.child) for r in bundles.violations(**frames).collect())


def changed(name, index, **values):
    tables = valid()
    names = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
    row = dict(zip(names, tables[name][index])) | values
    tables[name][index] = tuple(row.values())
    return tables


CASES = {
    "other_digest": ("nodes", 1, {"digest": sha("heading")}),
    "digest_without_regions": ("nodes", 0, {"digest": sha(TEXT)}),
    "out_of_range": ("nodes", 0, {"end_char": 27}),
    "unknown_view": ("nodes", 0, {"view": "x"}),
    "unknown_parent": ("nodes", 1, {"parent": "x"}),
    "other_pages": ("nodes", 2, {"pages": [1]}),
    "furniture_in_logical_view": ("nodes", 1, {"node_type": "furniture"}),
    "unknown_end": ("edges", 0, {"dst": "x"}),
    "edge_to_itself": ("edges", 0, {"dst": "h"}),
    "selector_without_node": ("selectors", 0, {"node": "x"}),
    "other_selector_digest": ("selectors", 0, {"digest": sha("x")}),
    "edges_without_bundle": ("edges", 0, {"bundle": "x"}),
}


def test_a_valid_bundle_breaks_nothing(spark, monkeypatch):
    assert told(spark, valid()) == []
    monkeypatch.setattr(bundles, "PIECE", 3)
    assert told(spark, valid()) == []


@pytest.mark.parametrize("rule", sorted(CASES))
def test_each_rule(spark, rule):
    name, index, values = CASES[rule]
    assert rule in [r for r, _ in told(spark, changed(name, index, **values))]


def test_rules_over_several_children(spark):
    tables = valid()
    tables["nodes"].append(tables["nodes"][1])
    tables["views"].append(("b", "m", "logical", ""))
    tables["regions"].append(("b", "r4", 2, 0.0, 0.0, 5.0, 1.0))
    tables["nodes"][2] = (*tables["nodes"][2][:7], ["r2", "r3", "r4", "r9"], [1, 2], tables["nodes"][2][9])
    tables["bundles"].append(("empty",))
    assert told(spark, tables) == [("no_view", None), ("nodes_repeated", "h"), ("not_one_logical_view", None), ("not_one_logical_view", None), ("one_place_twice", "p"), ("repeated_kind", None), ("unknown_region", "p")]


def test_hits(spark):
    tables = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in valid().items()}
    hits = spark.createDataFrame([(1, "b", "h", sha("Heading")), (2, "b", "p", sha("old")), (3, "b", "x", sha("")), (4, "c", "h", sha("Heading"))], "hit int, bundle string, node string, digest string")
    got = {r.hit: r.fault for r in bundles.hit_faults(hits, tables["views"], tables["nodes"]).collect()}
    assert got == {1: None, 2: "hit_digest_mismatch", 3: "hit_source_missing", 4: "hit_source_missing"}


def test_quotes(spark):
    text = "x" * 40 + "é needle 😀" + "y" * 40 + "aaaa"
    nodes = spark.createDataFrame([("n", 100, text), ("s", 0, "needle")], "node string, begin long, text string")
    asked = [("once", "n", "needle", None, "grounded"), ("said", "n", "x", 3, "grounded"), ("wrong", "n", "needle", 41, "mismatch"), ("before", "n", "x", -1, "mismatch"), ("beyond", "n", "x", 900, "mismatch"), ("gone", "n", "haystack", None, "missing"), ("often", "n", "y", None, "ambiguous"), ("over", "n", "aaa", None, "ambiguous"), ("none", "n", "", None, "empty"), ("null", "n", None, None, "empty"), ("lost", "z", "x", None, "unknown_node"), ("whole", "s", "needle", 0, "grounded")]
    rows = {r.quote: r for r in quotes.grounded(spark.createDataFrame([a[:4] for a in asked], "quote string, node string, exact string, start long"), nodes).collect()}
    assert {q: r.status for q, r in rows.items()} == {a[0]: a[4] for a in asked}
    once, whole = rows["once"], rows["whole"]
    assert (once.start_char, once.end_char, once.prefix, once.suffix) == (142, 148, "x" * 30 + "é ", " 😀" + "y" * 30)
    assert (whole.start_char, whole.end_char, whole.prefix, whole.suffix) == (0, 6, "", "") and rows["gone"].start_char is None
