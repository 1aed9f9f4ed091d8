"""Queries of the training-data operators against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from loomstone.llm import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        duck.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)
    out = duck.execute(registry.SQL[name])
    names = [x[0] for x in out.description]
    assert rows and sorted(names) == columns
    assert sorted([tuple(r[names.index(c)] for c in columns) for r in out.fetchall()], key=repr) == rows
