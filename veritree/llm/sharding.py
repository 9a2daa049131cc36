"""Sharding: histogram sort into shards of near equal bytes.

Law `bytes`: documents are put in the order of a key and cut into shards where the running sum of
sizes passes k/S of the total, so shard sizes differ by at most about one document. The cut keys
(splitters) are found without a global sort: each round counts the exact bytes below every candidate
key boundary across all partitions and keeps, per splitter, the one cell it must lie in; the next
round probes 4096 finer boundaries inside those cells. A round sends the driver at most
(S-1) x 4096 counts. Cells shrink until all open ones together hold few rows, which are then read to
fix the splitters exactly. Then rows are exchanged once, by ranges of the key, and a row's slot is its place in its
range behind the rows of earlier ranges of its shard.

The key is 60 bits of the text's MD5, then doc_id (63 bits, signed), then the row's number in the ledger. Equal texts are
neighbours, and no two rows have one key: a group of copies, or of repeated rows, however large, is spread over as many
ranges and shards as its bytes need. Rows that are equal but for that number are interchangeable, so it decides nothing that shows. Null
text has size 1 and the key of the empty text. Null doc_id sorts before all others. An empty table gives no rows.

Only DataFrame functions are used. Texts are read in one pass; the rounds read the narrow ledger
(doc_id, size, crc32, key), written once in the shared checkpoint folder.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritree.llm.common import scratch, written

#: Bits per round, rows that may be read in full to end the search, and rows meant for one range of the exchange.
PROBE_BITS, FEW_ROWS, RANGE_ROWS = 12, 8192, 250_000
HASH_BITS, ID_BITS = 60, 63
KEY = ("hi", "lo", "seq")


def shard_ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, hi (60 bits of MD5), lo (doc_id, null as the least long), seq (a number of the row)."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = F.col(key).cast("long")
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(t).cast("long") + 1).alias("size"),
        F.crc32(t).alias("text_crc32"),
        F.conv(F.substring(F.md5(t), 1, 15), 16, 10).cast("long").alias("hi"),
        F.coalesce(d, F.lit(-(2**63))).alias("lo"),
        F.monotonically_increasing_id().alias("seq"),
    )


def _rounds() -> list[tuple[str, int]]:
    """(column, shift) per round: the key's bits from the top, 12 at a time."""
    out = [("hi", s) for s in range(HASH_BITS - PROBE_BITS, -1, -PROBE_BITS)]
    # lo is signed: its arithmetic shift keeps the order of doc_id
    return out + [(c, s) for c in ("lo", "seq") for s in (52, 40, 28, 16, 4, 0)]


def _prefix(before: list[tuple[str, int]]) -> list[int]:
    """Which of the rounds so far tell a cell: the last of each column."""
    return [i for i, (c, _) in enumerate(before) if i + 1 == len(before) or before[i + 1][0] != c]


def _inside(cells, before: list[tuple[str, int]]) -> Column:
    """Whether a row lies in one of the cells (at most one for each splitter)."""
    out = F.lit(False)
    for cell in sorted(cells):
        one = F.lit(True)
        for i in _prefix(before):
            one = one & (F.shiftright(before[i][0], before[i][1]) == cell[i])
        out = out | one
    return out


def splitters(led: DataFrame, weight: str, targets: list[int]) -> list[tuple[int, int, int]]:
    """For each target (ascending), the least key (hi, lo, seq) at which the weight of all smaller or equal keys is over the target."""
    # an open cell: the prefixes of the rounds so far, with the weight below it
    open_cells: dict[tuple[int, ...], int] = {(): 0}
    wanted: dict[tuple[int, ...], list[int]] = {(): sorted(set(targets))}
    before: list[tuple[str, int]] = []
    for column, shift in _rounds():
        last = _prefix(before)
        rows = led.filter(_inside(open_cells, before)) if before else led
        names = [f"p{j}" for j in range(len(last))]
        by = [F.shiftright(before[i][0], before[i][1]).alias(n) for n, i in zip(names, last)]
        counted = rows.groupBy(*by, F.shiftright(column, shift).alias("probe")).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n")).collect()
        found: dict[tuple[int, ...], list[tuple[int, int, int]]] = {}
        for r in counted:
            found.setdefault(tuple(r[n] for n in names), []).append((r["probe"], r["w"], r["n"]))
        next_cells, next_wanted, rows_left = {}, {}, 0
        for cell, base in open_cells.items():
            below = base
            for p, w, n in sorted(found[tuple(cell[i] for i in last)]):
                if here := [t for t in wanted[cell] if below <= t < below + w]:
                    next_cells[(*cell, p)], next_wanted[(*cell, p)] = below, here
                    rows_left += n
                below += w
        open_cells, wanted = next_cells, next_wanted
        before.append((column, shift))
        if rows_left <= FEW_ROWS or not open_cells:
            break
    if not open_cells:
        return []
    # few rows: the exact sums by key, which tells rows apart
    keys = sorted((tuple(r[c] for c in KEY), r["w"]) for r in led.filter(_inside(open_cells, before)).select(*KEY, F.col(weight).alias("w")).collect())
    done: dict[int, tuple[int, int, int]] = {}
    for cell, below in open_cells.items():
        for key, w in keys:
            if all(key[KEY.index(before[i][0])] >> before[i][1] == cell[i] for i in _prefix(before)):
                done.update((t, key) for t in wanted[cell] if below <= t < below + w)
                below += w
    return [done[t] for t in targets]


def _part(ends: list[tuple[int, int, int]]) -> Column:
    """How many of the splitters are below the row's key, by a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        h, i, q = ends[mid]
        up_to = (F.col("hi") < h) | ((F.col("hi") == h) & ((F.col("lo") < i) | ((F.col("lo") == i) & (F.col("seq") <= q))))
        return F.when(up_to, tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(ends))


def shard(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, hi, lo, shard (0 .. n_shards-1) and slot (gapless from 0 in each shard, in key order).

    A row belongs to shard k if the bytes of all smaller keys lie in [k, k+1) x total / n_shards.
    """
    with scratch(docs.sparkSession) as keep:
        led = written(shard_ledger(docs, key, text), "shards")
        total, rows = led.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
        # a splitter is the last key of its shard: the first at which the keys up to it weigh k/S of the total or more
        ends = splitters(led, "size", [-(-k * total // n_shards) - 1 for k in range(1, n_shards)]) if rows else []
        dealt = led.withColumn("shard", _part(ends)).repartitionByRange(max(n_shards, -(-rows // range_rows)), *KEY).sortWithinPartitions(*KEY)
        # after the sort the number tells the range (above 33 bits) and the place in it
        placed = keep(written(dealt.withColumn("at", F.monotonically_increasing_id()), "sorted"))
    part = F.shiftright("at", 33)
    # one row for each range and shard that meet: ranges and n_shards at most
    met = placed.groupBy("shard", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = met.select(F.col("shard").alias("s"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"))
    out = placed.join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (part == F.col("p")))
    return out.select("doc_id", "size", "text_crc32", "hi", "lo", "shard", (F.col("at") + F.col("shift")).alias("slot"))


def shard_of(key: tuple[int, int, int], ends: list[tuple[int, int, int]]) -> int:
    """The shard of one key, for callers that route single rows."""
    return bisect_left(ends, key)
