"""Every registered query of the engine against its DuckDB statement."""

import os
from decimal import Decimal

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}{'/*.parquet' if os.path.isdir(f'{SF}/{name}') else ''}'")
    return con


def plain(names, rows):
    def text(v):
        return None if v is None else repr(float(v)) if isinstance(v, (float, Decimal)) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(text(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name])
    assert plain(got.columns, got.collect()) == plain(want.columns, want.fetchall())
