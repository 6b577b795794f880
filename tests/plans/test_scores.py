"""Scores on the edge between two tenths, and places of those that share them."""

from __future__ import annotations

import duckdb

import __spark_entry__


def test_weights_add_up_in_tenths(spark, tmp_path):
    # 32 events, one purchase and 14 errors: 27.25 points before rounding, so that a weight of 0.8999999999999999 rounds up what 0.9 doesn't.
    kinds = ["purchase"] + ["error"] * 14 + ["click"] * 17
    events = [(i, 1, k) for i, k in enumerate(kinds)] + [(100, 2, "signup"), (101, 2, "view"), (102, 3, "error")]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").selectExpr("*", "timestamp_seconds(event_id) as ts", "1.0D as value").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, "A"), (2, "A")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("scorecard", "scorecard_compare"):
        got = __spark_entry__.queries()[name](spark, str(tmp_path))
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r.user_id: r.score_tenths for r in __spark_entry__.queries()["scorecard"](spark, str(tmp_path)).collect()}[1] == 272
