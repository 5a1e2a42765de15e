"""The training-data queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.sql(f"CREATE VIEW {table[:-8]} AS SELECT * FROM '{SF}/{table}{'/*.parquet' if os.path.isdir(f'{SF}/{table}') else ''}'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    order = list(want.columns)[0]
    assert got.sort_values(order).reset_index(drop=True).astype(str).equals(want.sort_values(order).reset_index(drop=True).astype(str))
