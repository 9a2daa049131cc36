"""Queries on tables whose keys are as large as those of larger copies."""

import os

import duckdb
import pytest

from tests.test_catalogue import compare
from veritree import catalogue


@pytest.mark.parametrize("name, table, key, by", [("scalar_forms", "orders", "o_orderkey", 360_000_000), ("scalar_forms", "orders", "o_orderkey", 357_000), ("rename_plan", "documents", "doc_id", 94_900), ("rename_plan", "documents", "doc_id", 1_000_000)])
def test_large_keys_equal_the_sql(spark, sf, tmp_path, name, table, key, by):
    for f in os.listdir(sf):
        if f != f"{table}.parquet":
            os.symlink(f"{sf}/{f}", tmp_path / f)
    duckdb.sql(f"COPY (SELECT * REPLACE ({key} + {by} AS {key}) FROM '{sf}/{table}.parquet') TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    compare(spark, str(tmp_path), catalogue.queries()[name], catalogue.oracle_sql()[name])
