from __future__ import annotations

import duckdb
import pytest

from kithlink import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    at = [want.columns.index(c) for c in order]
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
