"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from genoquilt.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    return sorted(repr(tuple(None if x is None or x != x else x for x in r)) for r in df)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_sql(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir)
    if name not in registry.oracle_sql():
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    frame = want.project(", ".join(f'"{c}"' for c in order)).fetchall()
    assert rows(frame) == rows(map(tuple, got.select(*(f"`{c}`" for c in order)).collect()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 48
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
