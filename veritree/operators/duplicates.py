"""Keepers, duplicate moves and target names."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritree.plans.gaps import free_numbers
from veritree.plans.ordering import numbered, running
from veritree.plans.shared import scratch, written


@functools.cache
def _special() -> tuple[str, str, dict[str, str]]:
    """Where Python's case folding differs from lower case: characters that become one other, and those that become several."""
    one, several = {}, {}
    for c in map(chr, range(0x80, 0x20000)):
        low, fold = c.lower(), c.casefold()
        if fold != low and len(low) == 1:
            if len(fold) == 1:
                one[low] = fold
            else:
                several[low] = fold
    return "".join(one), "".join(one.values()), several


def folded(column: Column) -> Column:
    """Case-blind form of a text, by the rule of Unicode case folding, in built-in functions: the lower case, and what differs from it only where a text has such a character."""
    old, new, several = _special()
    low = F.lower(column)
    full = F.translate(low, old, new)
    for c, fold in several.items():
        full = F.replace(full, F.lit(c), F.lit(fold))
    return F.when(low.rlike(f"[{old}{''.join(several)}]"), full).otherwise(low)


def ranked(files: DataFrame, group: tuple[str, ...] = ("size", "sha256"), ascii_paths: bool = False) -> DataFrame:
    """Members of groups with several files, ranked: largest, then oldest, then first path; rank 1 is kept.

    Groups of one are dropped by an aggregate before the sort, so only duplicates are shuffled for ranking, and they are put in order by ranges, so a group of any size is ranked by many tasks.
    """
    several = files.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    key = F.lower("path") if ascii_paths else folded(F.col("path"))
    return numbered(files.join(several, list(group)), [-F.col("size"), F.col("modified_ns"), key, F.col("path")], tuple(group), "rank").withColumn("rank", F.col("rank").cast("int"))


def move_plan(files: DataFrame, folder: str = "dups", ascii_paths: bool = False) -> DataFrame:
    """source, target and group number of every duplicate that is not kept; groups are numbered by their first path."""
    r = ranked(files, ascii_paths=ascii_paths)
    groups = r.groupBy("size", "sha256").agg(F.min("path").alias("first_path"), F.max(F.when(F.col("rank") == 1, F.col("path"))).alias("kept"))
    numbers = group_numbers(groups, "first_path")
    stem = F.regexp_replace(F.element_at(F.split("kept", "/"), -1), r"\.[^.]*$", "")
    ext = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    moves = r.filter("rank > 1").join(numbers.select("size", "sha256", "group_no", "kept"), ["size", "sha256"])
    target = F.concat(F.lit(folder + "/set_"), F.lpad(F.col("group_no").cast("string"), 4, "0"), F.lit("/"), stem, F.lit("_copy("), (F.col("rank") - 1).cast("string"), F.lit(")"), ext)
    return moves.select(F.col("path").alias("source"), target.alias("target"), "group_no", (F.col("rank") - 1).alias("copy_no"), "kept")


def group_numbers(groups: DataFrame, order: str) -> DataFrame:
    """group_no 1.. in the order of a column that tells groups apart."""
    return numbered(groups, [F.col(order)], name="group_no").withColumn("group_no", F.col("group_no").cast("int"))


def numbered_targets(plan: DataFrame, occupied: DataFrame) -> DataFrame:
    """The first free `name (n).ext` of each planned row, in order of source: source, target.

    plan: source, name (with its folder) and ext; occupied: names that exist (paths), which stay taken. Rows of one name, compared case-blind, get its free numbers in
    order: number 0 is the name itself. A name that ends in a number belongs to two such sequences, its own (as 0) and that of the name without the
    number; who comes first in order of source gets it. These contested names are decided in rounds: each depends on
    lower numbers of its sequence and on shorter names only, so rounds that start from any guess end with the one answer,
    after as many rounds as the longest such chain, most often two.
    """
    key = F.concat(folded(F.col("name")), F.lit("\x00"), folded(F.col("ext")))
    with scratch(plan.sparkSession) as keep:
        rows = written(plan.select("source", "name", "ext", key.alias("base")), "names")
        ranked = written(numbered(rows.select("source", "base"), [F.col("source")], ("base",), "rank").withColumn("rank", F.col("rank") - 1), "ranked")
        bases = rows.select("base").distinct()
        stem, ext = split_stem(F.col("path"))
        names = occupied.select(F.concat(folded(stem), F.lit("\x00"), folded(ext)).alias("own")).distinct()
        sequence, number = _in_sequence(F.col("own"))
        both = names.select(F.explode(F.array(F.struct(F.col("own").alias("base"), F.lit(0).cast("long").alias("number")), F.struct(sequence.alias("base"), number.alias("number")))).alias("r")).select("r.*")
        static = written(both.join(bases, "base", "left_semi"), "occupied")
        sequence, number = _in_sequence(F.col("base"))
        first = ranked.filter("rank = 0").select(sequence.alias("base"), number.alias("number"), F.col("base").alias("child"), F.col("source").alias("child_source"))
        contested = written(first.join(bases, "base", "left_semi").join(static, ["base", "number"], "left_anti"), "contested")
        taken, won = static, None
        if not contested.isEmpty():
            won = contested.select("base", "number", "child", F.lit(True).alias("by_child"))
        while won is not None:
            claimed = F.when(F.col("by_child"), F.struct("base", "number")).otherwise(F.struct(F.col("child").alias("base"), F.lit(0).cast("long").alias("number")))
            taken = static.unionByName(won.select(claimed.alias("r")).select("r.*"))
            # the row that comes to a number is the one of rank `number - n`, n numbers below it being taken
            marks = taken.select("base", "number", F.lit(1).alias("held")).unionByName(contested.select("base", "number", F.lit(0).alias("held")))
            due = running(marks, [F.col("number"), F.col("held")], ("base",), {"n": F.col("held")}).filter("held = 0").select("base", "number", (F.col("number") - F.col("n")).alias("rank"))
            reached = contested.join(due, ["base", "number"]).join(ranked, ["base", "rank"], "left")
            following = written(reached.select("base", "number", "child", (F.col("source").isNull() | (F.col("child_source") < F.col("source"))).alias("by_child")), "won")
            if following.exceptAll(won).isEmpty():
                break
            won = following
        numbers = free_numbers(ranked, taken, ("base",))
        target = F.concat("name", F.when(F.col("number") > 0, F.concat(F.lit(" ("), F.col("number").cast("string"), F.lit(")"))).otherwise(""), "ext")
        return keep(written(numbers.select("source", "number").join(rows.drop("base"), "source").select("source", target.alias("target")), "targets"))


def _in_sequence(base: Column) -> tuple[Column, Column]:
    """The base of the sequence that a numbered name is in, and its number there; nulls for other names."""
    parts = r"(?s)^(.*) \(([1-9][0-9]{0,17})\)(\x00.*)$"
    return F.when(base.rlike(parts), F.concat(F.regexp_extract(base, parts, 1), F.regexp_extract(base, parts, 3))), F.when(base.rlike(parts), F.regexp_extract(base, parts, 2).cast("long"))


def split_stem(path: Column) -> tuple[Column, Column]:
    """A path without its last part's extension, and that (with its dot, empty without one); a leading dot starts no extension."""
    ext = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.](\.[^.]*)$", 1)
    return F.substring(path, F.lit(1), F.length(path) - F.length(ext)), ext


def rename_sequence(files: DataFrame, stamp: str = "stamp") -> DataFrame:
    """Sequence numbers per kind: dated before undated, then by date, then by path. Kinds are few and large, so they are numbered by ranges."""
    out = numbered(files, [F.col(stamp).isNull(), F.col(stamp), F.lower("path"), F.col("path")], ("kind",), "sequence")
    return out.withColumn("sequence", F.col("sequence").cast("int"))
