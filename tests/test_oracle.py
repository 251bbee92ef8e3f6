"""Every registered query against its SQL on the same tables."""

import math
from datetime import date, datetime

import duckdb
import pytest

import __spark_entry__ as entry_point
from tidemark.oracle import ORACLE
from tidemark.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(plain(row[i]) for i in order) for row in rows]


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.items() <= entry_point.queries().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, SF)
    result = duck.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == types
    got, expected = rows_of(df.columns, df.collect()), rows_of(columns, result.fetchall())
    assert sorted(got) == sorted(expected)
    assert got


ORDERED = ("panel_sort", "forecast_snapshot", "forecast_history")


@pytest.mark.parametrize("name", ORDERED)
def test_order(spark, duck, name):
    df = entry_point.queries()[name](spark, SF)
    result = duck.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["entity", "latest_date", "level", "forecast_date", "forecast"]
    assert df.count() == 5
