"""Row numbers and running sums over a whole table, without one task that sorts it all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritree.plans.shared import scratch, written

#: Rows that a task puts in order, about.
RANGE_ROWS = 200_000


def running(df: DataFrame, order: list[Column], by: tuple[str, ...] = (), sums: dict[str, Column] | None = None, greatest: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """df with, for each of `sums` and `greatest`, its sum or greatest value over all rows up to this one within each value of `by`, in an order that must tell rows apart up to interchangeable ones.

    Rows are exchanged once, by ranges of (by, order) whose number follows the number of rows, and written in that order with their range and place, so results
    do not depend on ranges being found alike again. What is combined is one row for each range and value of
    `by` that meet. Columns named __o0, __o1, ..., __s0, ... are used in between. Rows are counted and written when this is called: give narrow ones.
    """
    wanted = [(n, c, F.sum) for n, c in (sums or {}).items()] + [(n, c, F.max) for n, c in (greatest or {}).items()]
    keys, values = [f"__o{k}" for k in range(len(order))], [f"__s{k}" for k in range(len(wanted))]
    given = df.withColumns(dict(zip(keys, order)) | {v: c for v, (_, c, _) in zip(values, wanted)})
    ascending = [F.col(b).asc_nulls_first() for b in by] + [F.col(k).asc_nulls_first() for k in keys]
    with scratch(df.sparkSession) as keep:
        given = written(given, "given")  # what makes the rows runs once; they are counted, sampled and exchanged from here
        ranges = ranges or max(1, math.ceil(given.count() / RANGE_ROWS))
        dealt = given.repartitionByRange(ranges, *ascending) if ranges > 1 else given.coalesce(1)
        placed = keep(written(dealt.sortWithinPartitions(*ascending).drop(*keys).withColumn("__at", F.monotonically_increasing_id()), "running"))
    part = F.shiftright("__at", 33)
    own = Window.partitionBy("__part", *by).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumn("__part", part).withColumns({v: f(v).over(own) for v, (_, _, f) in zip(values, wanted)})
    met = placed.groupBy(*by, part.alias("__part")).agg(*[f(v).alias(v) for v, (_, _, f) in zip(values, wanted)])
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = met.select(*[F.col(b).alias(f"__b_{b}") for b in by], F.col("__part").alias("__p"), *[f(v).over(earlier).alias(f"__before{v}") for v, (_, _, f) in zip(values, wanted)])
    same = F.col("__part") == F.col("__p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__b_{b}"))
    out = inside.join(F.broadcast(starts) if not by else starts, same)
    both = {F.sum: lambda v: F.coalesce(F.col(v) + F.col(f"__before{v}"), v, f"__before{v}"), F.max: lambda v: F.greatest(v, f"__before{v}")}
    return out.select(*df.columns, *[both[f](v).alias(n) for v, (n, _, f) in zip(values, wanted)])


def numbered(df: DataFrame, order: list[Column], by: tuple[str, ...] = (), name: str = "number", ranges: int | None = None) -> DataFrame:
    """df with row numbers from 1, within each value of `by` if given, in an order that must tell rows apart up to interchangeable ones.

    Like `running`, but the place in a range gives the number, so ranges are not sorted again.
    """
    keys = [f"__o{k}" for k in range(len(order))]
    given = df.withColumns(dict(zip(keys, order)))
    ascending = [F.col(b).asc_nulls_first() for b in by] + [F.col(k).asc_nulls_first() for k in keys]
    with scratch(df.sparkSession) as keep:
        given = written(given, "given")  # what makes the rows runs once; they are counted, sampled and exchanged from here
        ranges = ranges or max(1, math.ceil(given.count() / RANGE_ROWS))
        dealt = given.repartitionByRange(ranges, *ascending) if ranges > 1 else given.coalesce(1)
        placed = keep(written(dealt.sortWithinPartitions(*ascending).drop(*keys).withColumn("__at", F.monotonically_increasing_id()), "numbered"))
    part = F.shiftright("__at", 33)
    met = placed.groupBy(*by, part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = met.select(*[F.col(b).alias(f"__b_{b}") for b in by], F.col("__part").alias("__p"), (before - F.col("__first") + 1).alias("__shift"))
    same = part == F.col("__p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__b_{b}"))
    out = placed.join(F.broadcast(starts) if not by else starts, same)
    return out.select(*df.columns, (F.col("__at") + F.col("__shift")).alias(name))
