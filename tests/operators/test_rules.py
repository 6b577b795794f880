"""Keys at any depth, paths under rules, and state machines."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import machines, rules


def keys_of(value):
    if isinstance(value, dict):
        return [k for key, v in value.items() for k in [key, *keys_of(v)]]
    return [k for v in value for k in keys_of(v)] if isinstance(value, list) else []


def made(r, depth):
    text = lambda: r.choice(["plain", 'a "quoted": b', "back\\slash", "Cookie", "é ", "", "\\\":", "x" * 50])
    if depth == 0 or r.random() < 0.2:
        return r.choice([1, None, True, 2.5, text()])
    if r.random() < 0.4:
        return [made(r, depth - 1) for _ in range(r.randrange(4))]
    return {text(): made(r, depth - 1) for _ in range(r.randrange(4))}


def test_keys_at_any_depth(spark):
    r = random.Random(3)
    values = [made(r, 6) for _ in range(200)] + [{"a": [{"SET-Cookie": 1}]}, {"note": '{"cookie": 1}'}, {"n" * 20_000: ["\\" * 20_000, {"z": 1}]}]
    texts = [json.dumps(v, ensure_ascii=i % 2 == 0, indent=[None, 1][i % 2]) for i, v in enumerate(values)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, json string").select("i", rules.keys(F.col("json")).alias("keys"), rules.has_key(F.col("json"), ["cookie", "set-cookie"]).alias("has"))
    for x in df.collect():
        assert x["keys"] == keys_of(values[x.i]) and x.has == any(k.lower() in ("cookie", "set-cookie") for k in keys_of(values[x.i]))


def test_keys_of_what_is_no_json(spark):
    df = spark.createDataFrame([(None,), ("",), ("{",), ('{"cookie": }',), ("3",), ("[]",)], "json string")
    assert [r[0] for r in df.select(rules.has_key(F.col("json"), ["cookie"])).collect()] == [None, None, None, None, False, False]


@pytest.mark.parametrize(
    "path, rule",
    [("src/a/b.py", "src/a/"), ("src/b.py", "src/"), ("src", None), ("src/", "src/"), ("docs/x.md", "docs/x.md"), ("docs/x.md2", None), ("docs/x.md/y", None), ("lib", "lib"), ("lib/x", None), ("/abs/x", "/"), ("", None), (None, None)],
)
def test_longest_rule(spark, path, rule):
    table = spark.createDataFrame([("src/", "allow"), ("src/a/", "block"), ("src/a/", "warn"), ("docs/x.md", "allow"), ("lib", "allow"), ("/", "block")], "rule string, verdict string")
    got = rules.longest_rule(spark.createDataFrame([(1, path)], "id int, path string"), table).collect()
    assert [(r.path, r.rule, r.verdict) for r in got] == [(path, rule, {"src/a/": "block", "/": "block", None: None}.get(rule, "allow"))]


def test_first_broken_rule(spark):
    rows = spark.createDataFrame([(1, 1), (1, -1), (None, 1), (-1, -1)], "a int, b int")
    issue = rules.first_broken({"a": F.col("a") > 0, "b": F.col("b") > 0})
    assert [r[0] for r in rows.select(issue).collect()] == ["none", "b", "a", "a"]


def walked(facts, machine):
    state, off = machine.start, 0
    for f in facts:
        to = machine.steps.get((state, f))
        state, off = to or state, off + (to is None)
    return state, len(facts), off


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_runs_are_folded_in_stretches(spark, stretch):
    r = random.Random(stretch)
    names = ["called", "archived", "parsed", "published", "failed", "abstained", "noise", None]
    logs = {i: [r.choice(names) for _ in range(r.randrange(1, 60))] for i in range(40)}
    logs |= {100: ["called", "archived", "parsed", "published"], 101: ["failed"], 102: ["called", "failed"], 103: ["called", "archived", "abstained"], 104: ["called", "archived", "failed"], 105: ["called", "archived", "parsed", "failed", "called"], 106: ["published"]}
    rows = [(run, at, f) for run, log in logs.items() for at, f in enumerate(log)]
    facts = spark.createDataFrame(rows, "run int, at int, fact string").repartition(5)
    got = machines.final_states(facts, machines.EXTRACTION, "run", ["at"], "fact", F.floor(F.col("at") / stretch))
    want = {run: walked(log, machines.EXTRACTION) for run, log in logs.items()}
    assert {x.run: (x.state, x.n_facts, x.n_out_of_order) for x in got.collect()} == want
    assert [want[i][0] for i in range(100, 107)] == ["succeeded", "runtime_failed", "archive_failed", "abstained", "invalid_output", "running", "planned"]
