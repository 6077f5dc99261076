"""The registered queries against their SQL counterparts, value by value."""

import duckdb
import pytest

from larder.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, duck):
    found = QUERIES[name](spark, SF)
    wanted = duck.execute(ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    rows = sorted(map(repr, map(tuple, found.select(columns).collect())))
    assert rows == sorted(map(repr, wanted.fetchall()))
