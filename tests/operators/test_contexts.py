"""Contexts: roles, budgets, segments to the byte, and manifests that are checked again."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quillstone.operators import contexts

NODES = "doc long, node string, order_index long, node_type string, parent string, text string"
UNITS = "unit string, doc long, focus array<string>, dependencies array<string>"
PROMPT = "Find é."


@pytest.fixture
def nodes(spark):
    rows = [
        ("root", 0, "document", None, ""), ("h1", 1, "heading", "root", "Top"), ("h2", 2, "heading", "h1", "Sub one"), ("p1", 3, "paragraph", "h2", "First é words"), ("f1", 4, "furniture", "h2", "page 1"), ("p2", 5, "paragraph", "h2", "Second"),
        ("d1", 6, "paragraph", "h1", "World Food Programme (WFP)"), ("c1", 7, "table_column_header", "root", "Year"), ("n1", 8, "table_note", "root", "in tons"), ("v1", 9, "table_cell", "root", "42"), ("x1", 10, "paragraph", "x2", "loop"), ("x2", 11, "heading", "x1", "loop"),
    ]
    return spark.createDataFrame([(1, *r) for r in rows], NODES)


@pytest.fixture
def units(spark):
    rows = [("u1", 1, ["p1", "p2"], []), ("u2", 1, ["v1"], ["c1", "n1", "d1"]), ("u3", 1, ["p1", "h2"], ["h1"]), ("u4", 1, ["x1"], ["f1", "gone"])]
    return spark.createDataFrame(rows, UNITS)


def roles(df, unit):
    return [(r.node, r.role, r.priority) for r in df.where(F.col("unit") == unit).orderBy("priority", "order_index", "node").collect()]


def test_roles_by_precedence(units, nodes):
    got = contexts.candidates(units, nodes)
    assert roles(got, "u1") == [("p1", "focus", 1), ("p2", "focus", 1), ("h1", "heading", 3), ("h2", "heading", 3)]
    assert roles(got, "u2") == [("v1", "focus", 1), ("c1", "table_header", 2), ("n1", "table_context", 3), ("d1", "definition", 4)]
    assert roles(got, "u3") == [("h2", "focus", 1), ("p1", "focus", 1), ("h1", "definition", 4)]  # a focus is no heading, a dependency is
    assert roles(got, "u4") == [("x1", "focus", 1), ("x2", "heading", 3)]  # a cycle of parents ends, furniture is never required
    assert [tuple(r) for r in contexts.issues(units, nodes).collect()] == [("u4", "gone")]


def test_ready_contexts_to_the_byte(units, nodes):
    row = {r.unit: r for r in contexts.manifests(units, nodes, PROMPT, 100).collect()}
    want = "Find é.\n\n[paragraph:p1]\nFirst é words\n\n[paragraph:p2]\nSecond\n\n[heading:h1]\nTop\n\n[heading:h2]\nSub one"
    u1 = row["u1"]
    assert (u1.status, u1.rendered, u1.n_selected, u1.excluded, u1.children) == ("ready", want, 4, 1, "")
    assert u1.input_tokens == len(want.split()) and u1.rendered_digest == hashlib.sha256(want.encode()).hexdigest()
    for part in u1.segments.split(","):
        node, a, b = part.split(":")
        assert want.encode()[int(a) : int(b)].startswith(f"[{'heading' if node[0] == 'h' else 'paragraph'}:{node}]\n".encode())


@pytest.mark.parametrize("budget, u1, u2", [(15, "ready", "ready"), (14, "ready", "blocked"), (13, "ready", "blocked"), (12, "split", "blocked"), (0, "blocked", "blocked")])
def test_budgets(units, nodes, budget, u1, u2):
    row = {r.unit: r for r in contexts.manifests(units, nodes, PROMPT, budget).collect()}
    need = {"u1": 2 + 4 + 2 + 2 + 3, "u2": 2 + 2 + 2 + 3 + 5}
    want = {u: "blocked" if budget <= 0 else "ready" if need[u] <= budget else ("split" if u == "u1" else "blocked") for u in need}
    assert {u: row[u].status for u in need} == want
    for u in need:
        assert (row[u].blocked_reason is not None) == (want[u] == "blocked") and (row[u].rendered == "") == (want[u] != "ready")
        assert len(row[u].children.split(",")) == (2 if want[u] == "split" else 1)


def test_ids_are_of_the_content_and_faults_are_found(spark, units, nodes):
    stored = contexts.manifests(units, nodes, PROMPT, 100)
    again = contexts.manifests(units, nodes, PROMPT, 100)
    assert {r.manifest_id for r in stored.collect()} == {r.manifest_id for r in again.collect()} and stored.select("manifest_id").distinct().count() == 4
    faults = lambda s, n=nodes, b=100: {r.fault for r in contexts.verified(s.where("unit = 'u1'"), units, n, PROMPT, b).collect()}
    assert faults(stored) == {None}
    assert faults(stored.withColumn("input_tokens", F.col("input_tokens") + 1)) == {"identity"}
    assert faults(stored.withColumn("rendered", F.concat("rendered", F.lit("!")))) == {"rendered_digest"}
    reid = lambda s: s.withColumn("manifest_id", contexts.identity(*[F.col(c) for c in contexts.IDENTITY]))
    assert faults(reid(stored.withColumn("unit", F.when(F.col("unit") == "u1", "u1")).withColumn("unit", F.coalesce("unit", F.lit("zz"))).withColumn("segments", F.lit("p1:0:1")))) == {"segments"}
    assert faults(reid(stored.withColumn("input_tokens", F.lit(3).cast("long")))) == {"tokens"}
    other = nodes.withColumn("text", F.when(F.col("node") == "p2", "Changed").otherwise(F.col("text")))
    assert faults(stored, other) == {"input"}
    assert faults(stored, nodes.where("node <> 'f1'")) == {None}  # furniture is not in the input
    gone = contexts.verified(stored.where("unit = 'u1'"), units.where("unit <> 'u1'"), nodes, PROMPT, 100).first().fault
    assert gone == "unit"
    tight = contexts.manifests(units, nodes, PROMPT, 12)
    assert {r.fault for r in contexts.verified(reid(tight.withColumn("children", F.lit("unit_x"))).where("unit = 'u1'"), units, nodes, PROMPT, 12).collect()} == {"children"}
    assert faults(stored, nodes, 12) == {"input"}
