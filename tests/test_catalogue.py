"""Every catalogue query against its SQL on the smallest tables, and none empty."""

import decimal
import os

import duckdb
import pytest

from loomstone.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    return round(float(v), 6) if isinstance(v, float | decimal.Decimal) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    assert rows
    if name in catalogue.SQL:
        out = duck.execute(catalogue.SQL[name])
        names = [x[0] for x in out.description]
        assert sorted(names) == columns
        assert sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall()], key=repr) == rows


def test_entry_points():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
