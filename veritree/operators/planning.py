"""Plans over a file table: organise by kind, rename to canonical names, correct extensions; checks before and after.

Plans are tables of (source, target); nothing here touches a file. A file table has path, kind, and what the plan needs besides.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritree.operators import classification, duplicates
from veritree.plans.gaps import free_numbers
from veritree.plans.ordering import numbered
from veritree.plans.shared import scratch, written

#: Numbers that one task goes through in order.
RANGE_NUMBERS = 1 << 17


def parent(path: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def split_name(path: Column) -> tuple[Column, Column]:
    """Stem and extension (with its dot, empty without one) of a path's last part; a leading dot starts no extension."""
    ext = F.regexp_extract(name(path), r"[^.](\.[^.]*)$", 1)
    return F.substring(name(path), F.lit(1), F.length(name(path)) - F.length(ext)), ext


def organize_plan(files: DataFrame, home: dict[str, str]) -> DataFrame:
    """Moves of files that are not in the folder of their kind, each to the first free name there; names stay taken although their file moves away.

    files: path, kind. Only files whose name (without numbers in brackets) another file in play has too can collide; they alone are
    put in sequence, the others are a projection. Returns source, target, kind.
    """
    folder = F.lit(None).cast("string")
    for kind, at in home.items():
        folder = F.when(F.col("kind") == kind, at).otherwise(folder)
    stem, ext = split_name(F.col("path"))
    rows = files.select("path", "kind", folder.alias("folder"), stem.alias("stem"), ext.alias("ext"), parent(F.col("path")).alias("at"))
    bare = F.regexp_replace("stem", r"( \([0-9]+\))+$", "")
    there = F.concat(F.when(F.col("folder") == "", F.lit("")).otherwise(F.concat("folder", F.lit("/"))), "stem")
    rows = rows.withColumns({"same": duplicates.folded(F.concat(bare, F.lit("/"), "ext")), "to": duplicates.folded(F.when(F.col("folder") != F.col("at"), F.col("folder"))), "at": duplicates.folded(F.col("at")), "name": there})
    with scratch(files.sparkSession) as keep:
        rows = written(rows.select("path", "kind", "name", "ext", F.when(F.col("to").isNotNull(), F.concat_ws("/", "to", "same")).alias("family"), F.concat_ws("/", "at", "same").alias("own")), "organize")
        moves = rows.filter("family is not null").select(F.col("path").alias("source"), "kind", "family", "name", "ext")
        standing = rows.select("path", F.col("own").alias("family"))
        both = moves.select("family", F.lit(1).alias("moves")).unionByName(standing.select("family", F.lit(0).alias("moves")))
        crowded = written(both.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.max("moves").alias("some")).filter("n > 1 and some = 1").select("family"), "crowded")
        alone = moves.join(crowded, "family", "left_anti").select("source", F.concat("name", "ext").alias("target"))
        moved = alone.unionByName(duplicates.numbered_targets(moves.join(crowded, "family", "left_semi"), standing.join(crowded, "family", "left_semi")))
        return keep(written(moved.join(moves.select("source", "kind"), "source").select("source", "target", "kind"), "organized"))


def rename_plan(files: DataFrame, collection: str, stamp: str = "stamp", descriptor: str = "descriptor", ascii_paths: bool = False, occupied: DataFrame | None = None) -> DataFrame:
    """Canonical names for pictures and videos that have none: numbered per kind behind the greatest number in use, dated before undated, by date, then path. Returns source, target, sequence.

    files: path, kind, ext and the two named columns. Files that are canonical for their kind keep their names. A number at which
    the name of the file that is due exists already (case-blind, among the files of any kind or `occupied`: path) is left out for all. Which file is due
    depends on the numbers left out before, so only these are found in order, in ranges of RANGE_NUMBERS numbers that hold such names; then all files get the free numbers by rank.
    """
    fold = F.lower if ascii_paths else duplicates.folded
    word = F.when(F.col("kind") == "picture", "image").otherwise("video")
    number = F.coalesce(*[F.when(word == w, classification.canonical_number(name(F.col("path")), collection, w)) for w in ("image", "video")])
    rows = files.filter(F.col("kind").isin("picture", "video")).withColumn("__number", number)
    start = rows.groupBy("kind").agg((F.coalesce(F.max("__number"), F.lit(0)) + 1).alias("start"))  # a row for each kind
    tail = F.concat(F.lit("__"), F.coalesce(F.col(stamp).cast("string"), F.lit("undated")), F.when(F.col(descriptor).isNotNull(), F.concat(F.lit("__"), descriptor)).otherwise(""), "ext")
    head = F.concat(F.when(parent(F.col("path")) == "", "").otherwise(F.concat(parent(F.col("path")), F.lit("/"))), F.lit(collection + "__"), word, F.lit("_"))
    order = [F.col("undated"), F.col("date"), F.col("key"), F.col("path")]
    with scratch(files.sparkSession) as keep:
        dated = F.coalesce(F.col(stamp).cast("string"), F.lit("")) if dict(files.dtypes)[stamp] == "string" else F.col(stamp)
        todo = rows.filter("__number is null").select("path", "kind", F.col(stamp).isNull().alias("undated"), dated.alias("date"), fold("path").alias("key"), head.alias("head"), tail.alias("tail"), fold(F.concat(head, F.lit("\x00"), tail)).alias("form"))
        ranked = numbered(todo, order, ("kind",), "rank").select("path", "kind", "head", "tail", "form", (F.col("rank") - 1).alias("rank"))
        ranked = written(ranked, "ranked")
        names = files.select("path").unionByName(occupied.select("path")) if occupied is not None else files.select("path")
        parts = rf"(?is)^(.*/)?({re.escape(collection)}__)(image|video)(_)([0-9]{{4}}|[1-9][0-9]{{4,17}})(__[^/]*)$"
        part = lambda k: F.regexp_extract("path", parts, k)
        held = names.filter(F.col("path").rlike(parts)).select(
            F.when(F.lower(part(3)) == "image", "picture").otherwise("video").alias("kind"), part(5).cast("long").alias("number"), fold(F.concat(part(1), part(2), part(3), part(4), F.lit("\x00"), part(6))).alias("form")
        )
        held = written(held.distinct().join(F.broadcast(start), "kind").filter("number >= start").select("kind", (F.col("number") - F.col("start")).alias("number"), "form"), "held")
        skipped = _skipped(ranked, held, keep)
        free = free_numbers(ranked.select("path", "kind", "rank"), skipped, ("kind",), name="free")
        out = free.join(ranked.drop("rank", "form"), ["path", "kind"]).join(F.broadcast(start), "kind").withColumn("sequence", F.col("free") + F.col("start"))
        text = F.when(F.col("sequence") > 9999, F.col("sequence").cast("string")).otherwise(F.lpad(F.col("sequence").cast("string"), 4, "0"))
        return keep(written(out.select(F.col("path").alias("source"), F.concat("head", text, "tail").alias("target"), "sequence"), "targets"))


def _bound(walk, before: dict[str, int]):
    return lambda key, due, names: walk(before, key, due, names)


def _skipped(ranked: DataFrame, held: DataFrame, keep) -> DataFrame:
    """kind and number of the numbers that are left out. ranked: kind, rank, form; held: kind, number, form of existing names; numbers and ranks from 0.

    The file due at a number is that of rank `number - skipped before it`. A range of numbers needs the files whose ranks it can come to, and how many numbers were left out
    before it: one small job for each range that holds names, each in a task of bounded size.
    """
    spark = ranked.sparkSession
    span = F.floor(F.col("number") / RANGE_NUMBERS)
    held = held.join(ranked.select("kind", "form").distinct(), ["kind", "form"], "left_semi")
    spans = [r[0] for r in held.select(span.alias("span")).distinct().orderBy("span").collect()]  # one for each range, at most the greatest number / RANGE_NUMBERS
    if not spans:
        return held.select("kind", "number")
    files = keep(written(ranked.select("kind", "rank", "form").repartitionByRange("kind", "rank").sortWithinPartitions("kind", "rank"), "due")) if len(spans) > 1 else ranked
    shift = {"picture": 0, "video": 0}
    found = []
    for k in spans:
        low, before = k * RANGE_NUMBERS, dict(shift)
        here = held.filter(span == k)
        window = F.lit(False)
        for kind, n in before.items():  # up to RANGE_NUMBERS more may be left out within the range
            window = window | ((F.col("kind") == kind) & F.col("rank").between(low - n - RANGE_NUMBERS, low - n + RANGE_NUMBERS))

        def walk(before: dict[str, int], key: tuple, due: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
            forms: dict[int, set[str]] = {}
            for number, form in zip(names["number"], names["form"]):
                forms.setdefault(number, set()).add(form)
            of, out, n = dict(zip(due["rank"], due["form"])), [], before[key[0]]
            for number in sorted(forms):
                if of.get(number - n) in forms[number]:
                    out.append(number)
                    n += 1
            return pd.DataFrame({"kind": pd.Series([key[0]] * len(out), dtype="object"), "number": pd.Series(out, dtype="int64")})

        step = files.filter(window).groupBy("kind").cogroup(here.groupBy("kind")).applyInPandas(_bound(walk, before), "kind string, number long")
        found.append(written(step, "skipped"))
        for kind, n in found[-1].groupBy("kind").count().collect():
            shift[kind] += n
    return spark.read.schema(found[0].schema).parquet(*[f.veritree_path for f in found])


def extension_plan(files: DataFrame, evidence: DataFrame, accepted: DataFrame, protected: tuple[str, ...] = ()) -> DataFrame:
    """What each file's extension says against its content: protected, unsupported (no policy for the format), uninspectable (no format), truthful, or rename with the first accepted extension.

    evidence: path, format; accepted: format, extensions (the first is canonical). Policies are few and joined by hash, files once.
    """
    rows = files.join(evidence, "path", "left").join(accepted, "format", "left")
    decision = (
        F.when(F.col("ext").isin(*protected) if protected else F.lit(False), "protected")
        .when(F.col("format").isNull(), "uninspectable")
        .when(F.col("extensions").isNull(), "unsupported")
        .when(F.array_contains("extensions", F.col("ext")), "truthful")
        .otherwise("rename")
    )
    stem, ext = split_name(F.col("path"))
    bare = F.substring(F.col("path"), F.lit(1), F.length("path") - F.length(ext))
    return rows.withColumn("decision", decision).select("path", "decision", F.when(F.col("decision") == "rename", F.concat(bare, F.element_at("extensions", 1))).alias("target"))


def plan_problems(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Why a plan is refused: targets that are planned twice (case-blind), taken by a file that stays, or sources that are no files. plan: source, target."""
    key = lambda c: duplicates.folded(F.col(c))
    twice = plan.groupBy(key("target").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("path")).filter("n > 1").select("path", F.lit("planned-twice").alias("problem"))
    stay = files.select("path").join(plan.select(F.col("source").alias("path")), "path", "left_anti").select(key("path").alias("k")).distinct()
    taken = plan.select("target", key("target").alias("k")).join(stay, "k", "left_semi").select(F.col("target").alias("path"), F.lit("taken").alias("problem"))
    gone = plan.select(F.col("source").alias("path")).join(files.select("path"), "path", "left_anti").select("path", F.lit("no-source").alias("problem"))
    return twice.unionByName(taken).unionByName(gone)


def verify_plan(plan: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """What went wrong when a plan was carried out: moved files that are not at their target, or not the same, and others that changed. before, after: path, sha256; plan: source, target."""
    want = before.join(plan, before["path"] == plan["source"], "left").select(F.coalesce("target", "path").alias("path"), F.col("sha256").alias("want"), F.col("target").isNotNull().alias("moved"))
    both = want.join(after.select("path", F.col("sha256").alias("have")), "path", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("have") != F.col("want"), "changed")
    return both.select("path", problem.alias("problem")).filter("problem is not null")


def layout_problems(entries: DataFrame, home: dict[str, str], review: str = "dups") -> DataFrame:
    """Entries that keep duplicates from being handled: media outside the folder of their kind, folders inside it, and links. entries: path, category, kind."""
    folder = F.lit(None).cast("string")
    for kind, at in home.items():
        folder = F.when(F.col("kind") == kind, at).otherwise(folder)
    inside = F.array_contains(F.array(*[F.lit(x) for x in home.values()]), parent(F.col("path")))
    problem = (
        F.when(F.element_at(F.split("path", "/"), 1) == review, None)
        .when(F.col("category") == "symbolic_link", "link")
        .when((F.col("category") == "directory") & inside, "nested-folder")
        .when((F.col("category") == "file") & folder.isNotNull() & (folder != parent(F.col("path"))), "misplaced")
    )
    return entries.select("path", problem.alias("problem")).filter("problem is not null")


def remaining_folders(entries: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Folders, deepest first when shown, that hold anything but ignored files anywhere below and are not allowed. entries: path, is_ignored."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = entries.filter((F.size(parts) > 1) & ~F.col("is_ignored")).select(F.explode(above).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))
    return rows.filter(~F.element_at(F.split("folder", "/"), 1).isin(*allowed)).withColumn("depth", F.size(F.split("folder", "/")))


def manifest(entries: DataFrame, by: str) -> DataFrame:
    """Files, folders, bytes and an order-free digest of each tree: equal trees have equal manifests. entries: by, path (relative to the tree), category, size, sha256.

    The digest adds up 60-bit words of each entry's SHA-256, in four sums, so it combines map-side and needs no ordered list.
    """
    line = F.sha2(F.concat_ws("\x00", "path", "category", F.coalesce(F.col("size").cast("string"), F.lit("")), F.coalesce("sha256", F.lit(""))), 256)
    word = lambda k: F.conv(F.substring(line, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    of = lambda c: F.col("category") == c
    one = entries.groupBy(by).agg(
        F.count(F.when(of("file"), 1)).alias("files"),
        F.count(F.when(of("directory"), 1)).alias("folders"),
        F.coalesce(F.sum(F.when(of("file"), F.col("size"))), F.lit(0)).alias("bytes"),
        *[F.sum(word(k)).alias(f"w{k}") for k in range(4)],
    )
    return one.select(by, "files", "folders", "bytes", F.sha2(F.concat_ws(":", *[F.col(f"w{k}").cast("string") for k in range(4)]), 256).alias("digest"))


def aliases(entries: DataFrame) -> DataFrame:
    """Identities (device, inode) under several paths: hard links, which a manifest refuses. entries: path, device, inode."""
    return entries.groupBy("device", "inode").agg(F.count(F.lit(1)).alias("paths"), F.min("path").alias("first_path")).filter("paths > 1")


def move_states(expected: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Whether each moved tree stands at its source (pending), at its target (complete), at both, at neither, or altered. All: tree, digest."""
    rows = expected.join(source.select("tree", F.col("digest").alias("s")), "tree", "left").join(target.select("tree", F.col("digest").alias("t")), "tree", "left")
    state = (
        F.when(F.col("s").isNotNull() & F.col("t").isNotNull(), "both")
        .when(F.col("s").isNull() & F.col("t").isNull(), "neither")
        .when(F.coalesce("s", "t") != F.col("digest"), "altered")
        .when(F.col("s").isNotNull(), "pending")
        .otherwise("complete")
    )
    return rows.select("tree", state.alias("state"))
