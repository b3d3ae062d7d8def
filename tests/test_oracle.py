"""Every query with an SQL counterpart, against DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from labelspring.checks.elastic_sql import ELASTIC_ORACLE
from labelspring.checks.oracle import ORACLE
from labelspring.checks.simcse_sql import SIMCSE_ORACLE

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def cell(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE | ELASTIC_ORACLE | SIMCSE_ORACLE))
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
    actual = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=repr)
    wanted = sorted((tuple(cell(r[i]) for i in order) for r in expected), key=repr)
    assert len(actual) > 0
    assert actual == wanted


def test_registry_is_consistent():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) == 113
    assert {r["LABEL"] for r in rows} <= {0, 1}
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)
