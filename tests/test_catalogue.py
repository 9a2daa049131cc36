import os

import duckdb
import pandas as pd
import pytest

from veritree import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NA or x != x:
        return None
    return float(x) if isinstance(x, float) else x.item() if hasattr(x, "item") else x


def rows(df):
    return sorted(repr([plain(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def compare(spark, sf, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = query(spark, sf)
    got, want = df.toPandas(), con.execute(sql).df()
    whole = {c: "Int64" for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint")}  # pandas makes floats of those with nulls
    got = got.astype(whole)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    compare(spark, sf, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir("/root/testdata/sf0.001")
