"""Typed closures and trees of parents, on fixtures with cycles and dangling ids."""

from __future__ import annotations

import random

import pytest

from quillstone.operators import references
from quillstone.operators.references import Link


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "src string, dst string")


@pytest.fixture
def ledger(spark):
    """Five types of records; events and actors refer to each other in a cycle, one place and one claim are missing."""
    records = {"outcome": ids(spark, "o1", "o2"), "claim": ids(spark, "c1", "c2"), "event": ids(spark, "e1", "e2"), "actor": ids(spark, "a1", "a2"), "place": ids(spark, "p1")}
    links = {
        "outcome_claim": Link("outcome", "claim", pairs(spark, ("o1", "c1"), ("o1", "c9"), ("o2", "c2"))),
        "claim_event": Link("claim", "event", pairs(spark, ("c1", "e1"), ("c1", None))),
        "event_actor": Link("event", "actor", pairs(spark, ("e1", "a1"), ("e2", "a2"))),
        "actor_event": Link("actor", "event", pairs(spark, ("a1", "e2"), ("a2", "e1"))),
        "event_place": Link("event", "place", pairs(spark, ("e1", "p1"), ("e2", "p7"), ("e2", "p7"))),
    }
    return records, links


def test_closure_over_types_with_a_cycle(spark, ledger):
    seeds = spark.createDataFrame([("outcome", "o1"), ("outcome", "o1"), ("outcome", None)], "type string, id string")
    reached, missing = references.closure(*ledger, seeds)
    assert {(r.type, r.id, r.depth) for r in reached.collect()} == {("outcome", "o1", 0), ("claim", "c1", 1), ("event", "e1", 2), ("actor", "a1", 3), ("place", "p1", 3), ("event", "e2", 4), ("actor", "a2", 5)}
    assert reached.count() == 7
    assert {tuple(r) for r in missing.collect()} == {("outcome_claim", "o1", "claim", "c9"), ("event_place", "e2", "place", "p7")}
    with pytest.raises(references.DanglingReference, match="event_place: e2 -> place p7"):
        references.require(missing)


def test_closure_of_what_is_complete_or_not_there(spark, ledger):
    reached, missing = references.closure(*ledger, spark.createDataFrame([("claim", "c2")], "type string, id string"))
    assert [tuple(r) for r in reached.collect()] == [("claim", "c2", 0)] and missing.isEmpty()
    references.require(missing)
    reached, missing = references.closure(*ledger, spark.createDataFrame([("place", "px"), ("planet", "x")], "type string, id string"))
    assert reached.isEmpty() and {tuple(r) for r in missing.collect()} == {("seed", None, "place", "px"), ("seed", None, "planet", "x")}


def test_closure_equals_a_walk_on_random_links(spark):
    r = random.Random(4)
    kinds = ["a", "b", "c"]
    records = {k: ids(spark, *[f"{k}{i}" for i in range(12)]) for k in kinds}
    edges = {f"{s}{d}": [(f"{s}{r.randrange(12)}", f"{d}{r.randrange(14)}") for _ in range(6)] for s in kinds for d in kinds}
    links = {n: Link(n[0], n[1], pairs(spark, *e)) for n, e in edges.items()}
    reached, missing = references.closure(records, links, spark.createDataFrame([("a", "a0"), ("b", "b3")], "type string, id string"))
    depth, front, gone = {"a0": 0, "b3": 0}, ["a0", "b3"], set()
    while front:
        step = {(n, s, d) for n, e in edges.items() for s, d in e if s in front}
        gone |= {(n, s, n[1], d) for n, s, d in step if int(d[1:]) >= 12}
        front = {d for *_, d in step if int(d[1:]) < 12 and d not in depth}
        depth |= {d: max(depth.values()) + 1 for d in front}
    assert {x.id: x.depth for x in reached.collect()} == depth and {tuple(x) for x in missing.collect()} == gone


TREES = [
    *[("good", i, (i - 1) // 2 if i else None) for i in range(40)],
    *[("long", i, i - 1 if i else None) for i in range(300)],
    ("two roots", 1, None), ("two roots", 2, None), ("two roots", 3, 1),
    ("cycle", 1, None), ("cycle", 2, 3), ("cycle", 3, 4), ("cycle", 4, 2), ("cycle", 5, 4), ("cycle", 6, 1),
    ("itself", 1, 1), ("itself", 2, 1),
    ("orphan", 1, None), ("orphan", 2, 99), ("orphan", 3, 2),
    ("twice", 1, None), ("twice", 2, 1), ("twice", 2, 1), ("twice", None, 1),
]


def test_trees(spark):
    nodes = spark.createDataFrame(TREES, "tree string, id long, parent long").repartition(3)
    got = {r.tree: (r.n_nodes, r.n_roots, r.n_orphans, r.n_cyclic, r.n_repeated, r.depth, r.valid) for r in references.trees(nodes, "tree").collect()}
    assert got == {
        "good": (40, 1, 0, 0, 0, 5, True), "long": (300, 1, 0, 0, 0, 299, True), "two roots": (3, 2, 0, 0, 0, 1, False), "cycle": (6, 1, 0, 4, 0, 1, False),
        "itself": (2, 0, 0, 2, 0, None, False), "orphan": (3, 1, 1, 0, 0, 1, False), "twice": (2, 1, 0, 0, 1, 1, False),
    }


def test_nodes_know_their_top(spark):
    nodes = spark.createDataFrame(TREES, "tree string, id long, parent long")
    got = {(r.tree, r.id): (r.top, r.depth, r.state) for r in references.rooted(nodes, "tree").collect()}
    assert got["good", 39] == (0, 5, "child") and got["long", 299] == (0, 299, "child") and got["orphan", 3] == (2, 1, "child") and got["orphan", 2] == (2, 0, "orphan")
    assert got["cycle", 5] == (None, None, "cyclic") and got["cycle", 6] == (1, 1, "child")
    assert references.rooted(nodes.where("false"), "tree").isEmpty()


def test_replies_go_to_another_role(spark):
    rows = [(1, t, r) for t, r in enumerate("suuaau")] + [(2, 0, "u"), (2, 4, "u"), (2, 7, "a")]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string")
    got = {(r.conv, r.id): r.parent for r in references.replied_to(turns, "conv", "turn", "role").collect()}
    assert got == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 2, (1, 4): 2, (1, 5): 4, (2, 0): None, (2, 4): None, (2, 7): 4}
