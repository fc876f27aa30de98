import os

import duckdb
import pytest

from archlens.plans import rules, trees

QUERIES, SQL = trees.queries() | rules.queries(), trees.oracle_sql() | rules.oracle_sql()
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_queries_equal_sql(spark, key):
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    sql = SQL[key]
    columns = sorted(con.sql(sql).columns)
    got = QUERIES[key](spark, FOLDER)
    assert sorted(got.columns) == columns
    rows = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(rows, key=repr) and rows
