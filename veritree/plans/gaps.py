"""Free numbers as the gaps between taken ones: the k-th free number of each key, by ranks alone.

Of a key's taken numbers o_0 < o_1 < ..., o_i has o_i - i free numbers below it. So a row that is to get the k-th free number (from 0) stands, in
one order of rows by k and taken numbers by o_i - i (the taken first), behind k rows and all taken numbers below its own: its number is its place in that
order. Two row numberings over ranges, then, and no task holds a key's rows or taken numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritree.plans.ordering import numbered


def placed(taken: DataFrame, by: tuple[str, ...], number: str = "number") -> DataFrame:
    """by, number and `below`, the free numbers below it. taken: by and number, each once."""
    return numbered(taken.select(*by, number), [F.col(number)], by, "__i").select(*by, number, (F.col(number) - F.col("__i") + 1).alias("below"))


def free_numbers(rows: DataFrame, taken: DataFrame, by: tuple[str, ...], rank: str = "rank", name: str = "number") -> DataFrame:
    """rows with the rank-th number of their key, from 0, that is not taken. rows: by and rank (0, 1, ... within a key), narrow; taken: by and number, each once."""
    kept = [c for c in rows.columns if c not in by]
    mine = rows.select(*by, F.col(rank).cast("long").alias("__key"), F.lit(1).alias("__kind"), F.struct(*kept).alias("__row"))
    others = placed(taken, by).select(*by, F.col("below").cast("long").alias("__key"), F.lit(0).alias("__kind"), F.lit(None).cast(dict(mine.dtypes)["__row"]).alias("__row"))
    merged = numbered(mine.unionByName(others), [F.col("__key"), F.col("__kind")], by, "__place")
    return merged.filter("__kind = 1").select(*by, "__row.*", (F.col("__place") - 1).alias(name))
