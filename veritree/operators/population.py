"""Evidence by content hash: computed once per hash, reused across copies and runs, with counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritree.operators import evidence as store

#: A provider gets frames of sha256 and path, and returns frames of sha256 and payload_json (null where it fails).
Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def to_compute(files: DataFrame, evidence: DataFrame, namespace: tuple[str, str, str], reuse: bool = True) -> DataFrame:
    """sha256 and one path of every distinct content without evidence in the namespace (of all contents, if nothing is to be reused)."""
    one = files.filter("sha256 is not null").groupBy("sha256").agg(F.min("path").alias("path"))
    if not reuse:
        return one
    kind, algorithm, runtime = namespace
    known = evidence.filter((F.col("evidence_type") == kind) & (F.col("algorithm") == algorithm) & (F.col("runtime") == runtime)).select(F.col("file_sha256").alias("sha256"))
    return one.join(known, "sha256", "left_anti")


def populate(files: DataFrame, evidence: DataFrame, namespace: tuple[str, str, str], provider: Provider, reuse: bool = True) -> DataFrame:
    """New records of the namespace, for `sinks.store.publish`: the provider sees each content once, whatever its copies."""
    kind, algorithm, runtime = namespace
    made = to_compute(files, evidence, namespace, reuse).mapInPandas(provider, "sha256 string, payload_json string")
    return made.filter("payload_json is not null").select(F.col("sha256").alias("file_sha256"), F.lit(kind).alias("evidence_type"), F.lit(algorithm).alias("algorithm"), F.lit(runtime).alias("runtime"), "payload_json")


def counters(files: DataFrame, evidence: DataFrame, namespace: tuple[str, str, str], reuse: bool = True) -> DataFrame:
    """One row: files, distinct contents, and of these how many are reused and how many must be computed."""
    todo = to_compute(files, evidence, namespace, reuse).select("sha256", F.lit(True).alias("todo"))
    rows = files.filter("sha256 is not null").groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).join(todo, "sha256", "left")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("discovered"), F.count(F.lit(1)).alias("distinct_hashes"), F.count(F.when(F.col("todo").isNull(), 1)).alias("reused"), F.count(F.when(F.col("todo"), 1)).alias("to_compute"))


def rechecked(expected: DataFrame, fresh: DataFrame) -> DataFrame:
    """Paths whose fresh digest is not what the cache said, or is missing; any row stops a plan. Both: path, sha256."""
    both = expected.select("path", F.col("sha256").alias("want")).join(fresh.select("path", F.col("sha256").alias("have")), "path", "left")
    return both.filter(~F.col("want").eqNullSafe(F.col("have"))).select("path", "want", "have")


def memo(files: DataFrame, evidence: DataFrame, namespace: tuple[str, str, str]) -> DataFrame:
    """Files with the namespace's payload, null where it must be computed."""
    return store.memo_join(files, evidence, *namespace)
