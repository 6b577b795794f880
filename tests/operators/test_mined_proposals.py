"""What mined connections propose: all records of every candidate, named by their digests."""

from __future__ import annotations

import hashlib
from itertools import combinations

import duckdb

import __spark_entry__
from quillstone.operators import graph

SHARED = "shared_governance_outcome_with"


def short(prefix, *parts):
    return f"{prefix}_{hashlib.sha256(':'.join(parts).encode()).hexdigest()[:24]}"


def expected(outcome, organizations, assertions):
    """Proposals by the rules of the method, one candidate after the other."""
    assertions, rows = sorted(assertions), []
    for s, o in combinations(sorted(organizations), 2):
        parts = (s, SHARED, o, outcome, *assertions)
        new = short("ast", *parts)
        records = [("Assertion", "assertion", new, s, o, 0.5, ""), ("Relationship", "relationship", short("rel", *parts), s, o, None, "")]
        for a in assertions:
            edge = short("arg", a, SHARED, new)
            records.append(("ArgumentEdge", "argument_edge", edge, a, new, 0.7, edge))
        for record_type, kind, record, source, target, confidence, suffix in records:
            label = "_".join(filter(None, (kind, s, SHARED, o, outcome, suffix)))
            rows.append((short("pcg", "graph_connection_mining", record_type, label), kind, record, source, target, outcome, confidence))
    return rows


def test_each_candidate_gives_all_its_records(spark):
    outcomes = [("out_b", ["org_z", "org_10", "org_9"], ["ast_2", "ast_10"]), ("out_a", ["org_9", "org_10"], ["ast_1", "ast_4", "ast_3"])]
    got = graph.proposed(spark.createDataFrame(outcomes, "outcome_id string, organizations array<string>, assertions array<string>"))
    want = [r for x in outcomes for r in expected(*x)]
    assert len(want) == 3 * 4 + 1 * 5
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_query_over_lines(spark, tmp_path):
    # Pairs of one outcome count, lines said twice count once, outcomes of one supplier or one line propose nothing.
    lines = [(1, 10, 1), (1, 9, 2), (1, 9, 2), (1, 10, 3), (2, 5, 1), (2, 5, 2), (3, 5, 4), (3, 6, 4), (4, 7, 1), (4, 8, 2), (4, None, 3), (None, 1, 1), (None, 2, 2)]
    columns = "l_orderkey long, l_suppkey long, l_linenumber int"
    more = ["1L AS l_partkey", "'R' AS l_returnflag", "'O' AS l_linestatus", "0.0D AS l_discount", "timestamp_ntz'2020-01-01' AS l_shipdate"]
    spark.createDataFrame(lines, columns).selectExpr("*", *more).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = __spark_entry__.queries()["graph_mine_proposals"](spark, str(tmp_path))
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(expected("out-1", {"org-10", "org-9"}, {"ast-1-1", "ast-1-2", "ast-1-3"}) + expected("out-4", {"org-7", "org-8"}, {"ast-4-1", "ast-4-2", "ast-4-3"}))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()['graph_mine_proposals']})").fetchall()) == rows
