"""Every query of the library's own operators against its SQL, on the smallest tables; skipped where these are not there."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from graticula import catalog

DATA = os.environ.get("GRATICULA_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = sql.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == cols
    key = lambda row: tuple(map(str, row))
    got = sorted(key(r[c] for c in cols) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(key(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
