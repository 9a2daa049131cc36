"""Tables in the folder that all executors share: results that are computed once and survive lost executors."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, local mode (tests) gets a folder of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file:///tmp/checkpoints/veritree-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: The tables of the innermost scratch() that is open, by path.
_open: ContextVar[list[str] | None] = ContextVar("open", default=None)


def reserved(spark: SparkSession, name: str = "step") -> str:
    """A new folder's name in the shared folder, deleted like a table of written()."""
    path = f"{shared_dir(spark)}/veritree-{name}-{uuid.uuid4().hex}"
    if (tables := _open.get()) is not None:
        tables.append(path)
    return path


def written(df: DataFrame, name: str = "step", compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, readable after executors are lost."""
    spark = df.sparkSession
    path = reserved(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.veritree_path = path
    return out


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def bucketed(df: DataFrame, keys: list[str], name: str = "step") -> Iterator[DataFrame]:
    """df as a table of the shared folder in buckets by keys, until the context ends: joins by all of the keys do not move its rows again."""
    spark = df.sparkSession
    path = reserved(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        # where a join by the keys comes before, this is its own exchange
        df.repartition(n, *keys).write.bucketBy(n, *keys).option("compression", "zstd").saveAsTable(table, format="parquet", path=path)
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        dropped(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, when it ends, the tables that written() made inside it. Gets a function that keeps one of them; an outer scratch() then has it.

    Only tables made inside are touched, so results of other operators that have not been read yet stay whole.
    """
    own: list[str] = []
    kept: set[str] = set()
    outer = _open.get()
    token = _open.set(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.veritree_path)
        return df

    try:
        yield keep
    finally:
        _open.reset(token)
        dropped(spark, *[p for p in own if p not in kept])
        if outer is not None:
            outer.extend(p for p in own if p in kept)
