"""The registered queries and their SQL: names agree, and a sample of both runs."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "events", "labels", "pages")

SAMPLE = (
    "identity_count", "freq_of_freq", "species_profile", "path_parts", "hash_sample", "left_join_back",
    "openset_split", "knn_topk", "struct_fields", "predict_all_rows", "confusion", "positive_sample", "submission_violations", "pca",
    *(query.__name__ for query in entry.roundtrips.REGISTERED if not query.__name__.startswith("final_labels")),
)


def test_every_query_has_its_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    registered = (*entry.registered.REGISTERED, *entry.roundtrips.REGISTERED)
    own = {query.__name__ for query in registered}
    assert len(own) == len(registered)
    assert own <= set(queries)
    assert set(sql) <= set(queries)
    assert own <= set(sql)


@pytest.mark.parametrize("absent", entry.CORPUS_PART)
def test_entry_works_without_the_corpus_part(monkeypatch, absent):
    find = importlib.util.find_spec

    def hidden(name, *package):
        return None if name == absent else find(name, *package)

    monkeypatch.setattr(importlib.util, "find_spec", hidden)
    registered = (*entry.registered.REGISTERED, *entry.roundtrips.REGISTERED)
    assert set(entry.queries()) == {query.__name__ for query in registered}
    assert set(entry.oracle_sql()) == set(entry.queries())


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return str(value)
    return f"{float(value):.6f}"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = connection.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = entry.queries()[name](spark, SF_DIR)
    assert sorted(got.columns) == columns
    left = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    places = [want.columns.index(c) for c in columns]
    right = sorted(tuple(plain(r[i]) for i in places) for r in want.fetchall())
    assert left == right
