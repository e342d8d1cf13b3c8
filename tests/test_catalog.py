"""Every registered query against its SQL on the smallest data set."""

import os

import pytest

from stmtlens.catalog import all_oracles, all_queries
from tools import check

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in check.TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def test_oracles_have_queries():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("key", sorted(all_queries()))
def test_query(spark, duck, key):
    df = all_queries()[key](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if key not in all_oracles():
        assert rows
        return
    relation = duck.execute(all_oracles()[key])
    names = [d[0] for d in relation.description]
    assert sorted(names) == sorted(df.columns)
    assert check.canon(df.columns, rows) == check.canon(names, relation.fetchall())
