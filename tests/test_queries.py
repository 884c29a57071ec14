"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from patchloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted(repr(tuple(r[i] for i in order)) for r in rows)).encode()).hexdigest()


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    o = con.sql(E.oracle_sql()[name])
    orows = o.fetchall()
    assert sorted(df.columns) == sorted(o.columns)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(o.columns, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
