"""The tables define no acronyms, so this query has a fixture of its own."""

from __future__ import annotations

import duckdb

import __spark_entry__


def test_latest_earlier_definition(spark, tmp_path):
    texts = [
        (1, "World Bank (WB)\nthe WB said\nWorkers' Board (WB)\nWB and WB again\nNATO"),
        (2, "the WB\n(WB) later"),
        (3, None),
        (4, ""),
    ]
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'en' as lang", "'a' as source", "0L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["acronym_definitions"](spark, str(tmp_path)).collect()
    want = [(1, 1, "WB", 0), (1, 2, "WB", 0), (1, 3, "WB", 2)]
    assert sorted((r.doc_id, r.order_index, r.acronym, r.defined_at) for r in got) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rows = con.sql(f"SELECT doc_id, order_index, acronym, defined_at FROM ({__spark_entry__.oracle_sql()['acronym_definitions']}) ORDER BY ALL").fetchall()
    assert rows == want
