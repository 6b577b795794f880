"""First letters whose upper case is spelt out as several letters."""

from __future__ import annotations

import duckdb

import __spark_entry__

LETTERS = [c for c in map(chr, range(0x20, 0x10000)) if len(c.upper()) > 1] + ["ä", "x", "Σ", "\U00010428"]


def test_a_first_letter_stays_one_letter(spark, tmp_path):
    rows = [(i, f"{c}{c} word") for i, c in enumerate(LETTERS)] + [(-1, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.sentence for r in __spark_entry__.queries()["sentence_text"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.sql(f"SELECT doc_id, sentence FROM ({__spark_entry__.oracle_sql()['sentence_text']})").fetchall())
    assert got[LETTERS.index("ß")] == "ẞß word."
