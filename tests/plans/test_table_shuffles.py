"""Cells of tables are dealt once, as lines, and not again with their headers."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from quillstone.operators import graph

NAN = float("nan")
#: Lines said twice, the least value of which counts; values of all signs, none and not a number; tables of one line and of many.
LINES = [
    (1, 1, 70, 0.0, 5.0, None, 0.1), (1, 1, 60, 3.0, -5.0, None, 0.0), (1, 2, 50, -0.0, NAN, NAN, 0.0), (1, 2, 50, 1.0, NAN, 0.0, -0.5), (1, 9, 40, None, None, 2.0, None),
    (2, 1, 30, 1.0, 1.0, 1.0, 1.0), *[(3, n, n, float(n % 3 - 1), 1.0, 0.0, 0.0) for n in range(1, 30)],
]


@pytest.mark.parametrize("name", ["header_ancestry", "table_cell_plan"])
def test_one_shuffle_of_lines(spark, tmp_path, monkeypatch, capsys, name):
    monkeypatch.setattr(graph, "SHARE", 100)
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(LINES, columns).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    got.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange ") == 1
    # Parts grow with the number of lines: 35 of up to 12 cells, 100 to a part.
    assert "hashpartitioning(table" in plan and ", 5), REPARTITION_BY_NUM" in plan
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert len(want) == 5 * 33 + 7 * 3
    assert sorted(map(tuple, got.collect())) == sorted(want)
