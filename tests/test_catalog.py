"""Every registered record query against DuckDB on the same tables."""

import os

import duckdb
import pytest

from folioforge.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "events", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    theirs = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(names) == columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in theirs.fetchall()), key=key)
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=key)
    assert got == want
    assert got or name == "search_ranked_none"
