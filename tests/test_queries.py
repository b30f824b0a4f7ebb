"""Every registered query against its SQL equivalent, values and order-insensitive."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from holdfast.plans.oracles import ORACLES
from holdfast.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in sorted(os.listdir(SF_DIR)):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "normalize"):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def test_every_query_is_paired():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    got = [tuple(row) for row in result.collect()]
    relation = duck.sql(ORACLES[name])
    want = relation.fetchall()
    types = {field.name: KINDS[field.dataType.simpleString()] for field in result.schema.fields}
    assert types == {column: str(kind) for column, kind in zip(relation.columns, relation.types)}
    assert len(got) == len(want)
    assert rows_of(result.columns, got) == rows_of(relation.columns, want)
    assert got, "a query without rows proves nothing"


def test_entry(spark):
    assert contract.entry(spark).count() == 150
