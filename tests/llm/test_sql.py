"""The queries that SQL can express, against their SQL on the driver tables."""

import os

import duckdb
import pytest

from fieldmark.llm import oracles, queries

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark", "labels")
QUERIES = {query.__name__: query for query in queries.REGISTERED}


def plain(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = connection.sql(oracles.SQL[name])
    got = QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(plain(row[c]) for c in want.columns) for row in got.collect())
    assert rows == sorted(tuple(plain(value) for value in row) for row in want.fetchall())
