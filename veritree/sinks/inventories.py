"""Inventories kept for comparison: one row a content, bucketed and sorted by identity, so that comparing two of them needs no exchange.

    PATH/identities   size, sha256, n: Parquet in buckets by (size, sha256); copies are counted, so no bucket is hot
    PATH/files        the files, sorted by path
    PATH/spec         the number of buckets
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritree.operators import coverage

BUCKETS = 200


def _name(path: str) -> str:
    return f"veritree_inventory_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write(files: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Stores an inventory (path, size, sha256 and more); both sides of a comparison need the same number of buckets."""
    spark, path = files.sparkSession, path.rstrip("/")
    files.write.parquet(f"{path}/files")
    one = coverage.identities(spark.read.parquet(f"{path}/files")).select(F.col("size").cast("long").alias("size"), "sha256", "n")
    name = _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    # dealt out as the buckets are, so a task writes one file for each bucket that it has
    one.repartition(buckets, "size", "sha256").write.bucketBy(buckets, "size", "sha256").sortBy("size", "sha256").option("path", f"{path}/identities").format("parquet").saveAsTable(name)
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{path}/spec")


def identities(spark: SparkSession, path: str) -> DataFrame:
    """size, sha256 and n of a stored inventory, with its buckets known to the planner; also in a session that did not write it."""
    path = path.rstrip("/")
    name = _name(path)
    if not spark.catalog.tableExists(name):
        n = spark.read.schema("buckets int").json(f"{path}/spec").first()[0]
        spark.sql(f"CREATE TABLE {name} (size BIGINT, sha256 STRING, n BIGINT) USING parquet CLUSTERED BY (size, sha256) SORTED BY (size, sha256) INTO {n} BUCKETS LOCATION '{path}/identities'")
    return spark.table(name)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/files")


def forget(spark: SparkSession, path: str) -> None:
    """Takes an inventory's name out of the session; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(path.rstrip('/'))}")
