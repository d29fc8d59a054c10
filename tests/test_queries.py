import os

import duckdb
import pytest

import __spark_entry__ as entry
from twinleaf.plans import file_queries, queries

QUERIES, ORACLE_SQL = queries.QUERIES | file_queries.QUERIES, queries.ORACLE_SQL | file_queries.ORACLE_SQL

DATA = "/root/testdata/sf0.001"


def rows(columns, data):
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([clean(r[k]) for k in order]) for r in data)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry_lists_all(spark):
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
