"""Digests of ordered plans and of sets: equal ones have equal digests, whatever the partitioning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritree.plans.ordering import numbered
from veritree.plans.shared import scratch, written

#: Lines of a plan that are digested together.
CHUNK = 4096


def plan_digest(rows: DataFrame, order: Column, line: Column, chunk: int = CHUNK) -> DataFrame:
    """One row: the number of rows, and SHA-256 of the digests of every `chunk` lines, in order; a chunk's lines are joined by line feeds. More than CHUNK chunks are digested in levels.

    Chunks follow the row numbers, so no task holds more than a chunk's lines or CHUNK digests.
    """
    n = numbered(rows.select(order.alias("o"), line.alias("l")), [F.col("o"), F.col("l")], name="n")
    each = n.groupBy(F.floor((F.col("n") - 1) / chunk).alias("c")).agg(F.count(F.lit(1)).alias("rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "l"))), lambda x: x["l"]), "\n").alias("t"))
    return _combined(each.select("c", "rows", F.sha2("t", 256).alias("d")), lambda c: F.floor(c / CHUNK), CHUNK)


def set_digest(rows: DataFrame, line: Column, bits: int | None = None) -> DataFrame:
    """SHA-256 of a set of any size: lines fall in buckets by the first bits of their own digests, each bucket is digested in order, then the buckets, in levels where they are many.

    The number of buckets follows the size unless given: a power of 16 for about CHUNK lines each. Lines are read once; their digests are written.
    """
    with scratch(rows.sparkSession) as keep:
        digests = written(rows.select(F.sha2(line, 256).alias("d")), "digests")
        if bits is None:
            bits, n = 4, digests.count()
            while n > CHUNK << bits:
                bits += 4
        each = digests.groupBy(F.substring("d", 1, bits // 4).alias("c")).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
        out = _combined(each, lambda c: F.substring(c, F.lit(1), F.length(c) - 2), CHUNK)
        return keep(written(out, "digest"))


def _combined(each: DataFrame, above: Callable[[Column], Column], most: int) -> DataFrame:
    """The digest of digests by place (c). While there are more than `most`, those of one place above are digested together first."""
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "d"))), lambda x: x["d"]), ""), 256)
    with scratch(each.sparkSession) as keep:
        each = written(each, "level")
        while each.count() > most:
            each = written(each.withColumn("up", above(F.col("c"))).groupBy("up").agg(F.sum("rows").alias("rows"), joined.alias("d")).withColumnRenamed("up", "c"), "level")
        return keep(written(each.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), joined.alias("digest")), "digest"))
