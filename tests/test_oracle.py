"""Every registered query against its DuckDB oracle on the sf0.001 tables
(and the rows-only check for queries without SQL)."""

import os

import pytest

import __spark_entry__ as E
from blockflow import catalog
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.all_queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def test_every_query_has_oracle():
    assert set(catalog.all_sql()) == set(catalog.all_queries())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["county", "cnt", "pos", "name"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF).toPandas()
    ddf = duck.execute(E.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(ddf.columns)
    assert len(sdf) == len(ddf)
    assert rows_of(sdf, 6)[1] == rows_of(ddf, 6)[1]
