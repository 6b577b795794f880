"""Scores whose activity counts in exact decimals."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__

#: Events of a user by kind: click, purchase, error, signup, view. As doubles, 0.2 of 96 and of 56 rounds these up.
COUNTS = {1: (61, 31, 0, 3, 1), 2: (54, 37, 0, 3, 1), 3: (40, 3, 1, 7, 5), 4: (19, 24, 1, 7, 5), 5: (91, 0, 4, 1, 0), 6: (120, 7, 1, 0, 0)}


@pytest.mark.parametrize("name", ["scorecard", "scorecard_compare"])
def test_activity_is_an_exact_decimal(spark, tmp_path, name):
    kinds = ("click", "purchase", "error", "signup", "view")
    events = [(user, kind) for user, counts in COUNTS.items() for kind, n in zip(kinds, counts) for _ in range(n)]
    spark.createDataFrame([(i, *x) for i, x in enumerate(events)], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(user, "A") for user in COUNTS], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
