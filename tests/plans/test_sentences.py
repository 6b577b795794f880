"""The tables have no very long first lines, so this query has a fixture of its own."""

from __future__ import annotations

import __spark_entry__


def test_long_first_lines_stay_whole(spark, tmp_path):
    texts = [(1, "a" + "b" * 1_200_000 + "\nnext"), (2, ""), (3, "x"), (4, "y  z!")]
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'en' as lang", "'a' as source", "0L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.sentence for r in __spark_entry__.queries()["sentence_text"](spark, str(tmp_path)).collect()}
    assert got == {1: "A" + "b" * 1_200_000 + ".", 2: "", 3: "X.", 4: "Y z!"}
