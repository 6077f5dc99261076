"""Every registered query against its SQL counterpart in DuckDB."""

import duckdb
import pytest

from larder.registry.oracles import ORACLES
from larder.registry.queries import QUERIES
from tests.conftest import SF

TABLES = "lineitem orders supplier events conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(value):
        if value is None:
            return "~"
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return repr(float(value)) if number else str(value)

    return sorted(tuple(text(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    found = QUERIES[name](spark, SF)
    rows = found.collect()
    assert rows
    if name not in ORACLES:
        pytest.skip("no SQL counterpart")
    wanted = duck.execute(ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert canonical(found.columns, rows) == canonical(columns, wanted.fetchall())


def test_every_counterpart_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
