"""Every registered query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__
from quillstone.plans import ORACLES as SQL

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, columns):
    value = lambda v: None if v is None else round(v, 9) if isinstance(v, float) else str(v)
    return sorted((tuple(value(r[c]) for c in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert canonical([r.asDict() for r in got.collect()], columns) == canonical([dict(zip(want.columns, r)) for r in want.fetchall()], columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
