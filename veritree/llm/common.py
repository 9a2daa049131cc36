"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritree.plans.shared import bucketed, dropped, scratch, shared_dir, written  # noqa: F401

#: A word is a maximal run of characters outside these (Java and RE2 syntax).
SPACE_CLASS = r"[\x09-\x0D\x20]"
WORD_CHAR = r"[^\x09-\x0D\x20]"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark's readers need to open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text):
    """array<string> of the words of a text column; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def slices(batch: pa.RecordBatch, rows: int = 512, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows, which end where the last column's texts pass `size` bytes."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(batch.num_columns - 1)).fill_null(0), np.int64)
    part = np.cumsum(sizes) // size
    at = 0
    while at < batch.num_rows:
        end = min(at + rows, int(np.searchsorted(part, part[at], "right")))
        yield batch.slice(at, end - at)
        at = end
