"""Every dealt query with an SQL counterpart, against DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from labelspring.llm.queries import LLM_ORACLE

TABLES = ("documents", "pages", "benchmark", "labels")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_equals_sql(spark, duck, folder, name):
    df = driver.queries()[name](spark, folder)
    cursor = duck.execute(driver.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    types = {c[0]: str(c[1]) for c in cursor.description}
    expected = cursor.fetchall()
    columns = sorted(df.columns)
    assert columns == sorted(names)
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    order = [names.index(c) for c in columns]
    actual = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert len(actual) > 0
    assert actual == sorted((tuple(r[i] for i in order) for r in expected), key=repr)
