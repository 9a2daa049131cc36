"""Ordered tree manifests: a Merkle tree of folders, and the descent to what differs between two of them.

An entry table has a tree's name, path (relative, the empty path is the tree's own folder), category, size, sha256 and, if given, meta, a text of
whatever else must be equal. Digests are made level by level from the deepest folder: a folder's digest covers its
metadata and its children's names and digests in byte order. Each level is one aggregate by parent folder, written to the shared folder, so
plans stay short however deep a tree is. A folder with more children than a chunk is digested in a tree of its own,
by the first digits of the digests of names, so no task holds more than about a chunk of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritree.plans.shared import reserved, scratch, written

#: Children that are digested together.
CHUNK = 4096

NODES = "path string, parent string, name string, category string, meta string, content string, digest string, files long, folders long, bytes long"


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two lists of fields read alike."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def _digested(items: DataFrame, *by: str) -> DataFrame:
    """The lines (`at`, `line`) of each group in order, as one digest, and the sums of what is below."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "")
    return items.groupBy(*by).agg(F.sha2(lines, 256).alias("list"), *[F.sum(c).alias(c) for c in ("files", "folders", "bytes")])


def _lists(children: DataFrame, by: str, chunk: int) -> DataFrame:
    """One digest for the children of each folder."""
    counts = children.groupBy(by, "parent").agg(F.count(F.lit(1)).alias("n"))
    large = written(counts.filter(F.col("n") > chunk), "large")  # a table of its own, so that a join with a folder of many children can be split
    most, rounds = large.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0], 0
    while most > chunk << 4 * rounds:
        rounds += 1
    items = children.select(by, "parent", F.col("name").alias("at"), F.concat(field(F.col("name")), "digest").alias("line"), "files", "folders", "bytes")
    if rounds:
        levels = F.lit(0)
        for k in range(rounds):
            levels = levels + (F.col("n") > (chunk << 4 * k)).cast("int")
        items = items.join(large.select(by, "parent", levels.alias("levels")), [by, "parent"], "left").withColumn("levels", F.coalesce("levels", F.lit(0))).withColumn("key", F.sha2("at", 256))
        for k in range(rounds, 0, -1):
            low = _digested(items.filter(F.col("levels") >= k).withColumn("key", F.substring("key", 1, k)), by, "parent", "levels", "key")
            items = items.filter(F.col("levels") < k).unionByName(low.withColumn("at", F.col("key")).withColumn("line", F.concat(field(F.col("key")), "list")).drop("list"))
    return _digested(items, by, "parent")


def tree(entries: DataFrame, by: str = "tree", chunk: int = CHUNK) -> DataFrame:
    """The nodes of each tree with their digests, and the files, folders and bytes of their subtrees: `by`, the columns of NODES, depth (0 for the root).

    Folders that are not listed themselves have no metadata. The result is a table in the shared folder, by depth, which a descent reads level by level.
    """
    spark = entries.sparkSession
    meta = F.col("meta").cast("string") if "meta" in entries.columns else F.lit(None).cast("string")
    rows = entries.select(by, "path", "category", F.col("size").cast("long").alias("size"), "sha256", meta.alias("meta"), F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/"))).alias("depth"))
    root = reserved(spark, "tree")
    with scratch(spark):
        stored = reserved(spark, "entries")
        rows.write.partitionBy("depth").parquet(stored)
        rows = spark.read.schema(rows.schema).parquet(stored)
        deepest = rows.agg(F.coalesce(F.max("depth"), F.lit(-1))).first()[0]
        children = None
        for depth in range(deepest, -1, -1):
            own = rows.filter(F.col("depth") == depth).drop("depth")
            folders = own.filter("category = 'directory'").select(by, "path", "meta")
            if children is None:
                folders = folders.select(by, "path", "meta", F.lit(None).cast("string").alias("list"), *[F.lit(0).cast("long").alias(c) for c in ("files", "folders", "bytes")])
            else:
                below = _lists(children, by, chunk).withColumnRenamed("parent", "path")
                folders = folders.join(below, [by, "path"], "full").select(by, "path", "meta", "list", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "folders", "bytes")])
            folders = folders.select(
                by, "path", F.lit("directory").alias("category"), "meta", F.lit(None).cast("string").alias("content"), F.sha2(F.concat(F.lit("D"), field(F.col("meta")), field(F.col("list"))), 256).alias("digest"), "files", (F.col("folders") + 1).alias("folders"), "bytes"
            )
            digest = F.sha2(F.concat(F.lit("F"), *[field(F.col(c)) for c in ("category", "meta", "size", "sha256")]), 256)
            content = F.concat_ws(":", F.col("size").cast("string"), "sha256")
            others = own.filter("category <> 'directory'").select(by, "path", "category", "meta", content.alias("content"), digest.alias("digest"), (F.col("category") == "file").cast("long").alias("files"), F.lit(0).cast("long").alias("folders"), F.coalesce("size", F.lit(0)).alias("bytes"))
            name = F.element_at(F.split("path", "/"), -1)
            parent = F.when(F.col("path") != "", F.regexp_replace("path", "/?[^/]*$", ""))
            level = folders.unionByName(others).withColumn("name", name).withColumn("parent", parent).select(by, *[c.split()[0] for c in NODES.split(", ")])
            level.write.parquet(f"{root}/depth={depth}")
            children = spark.read.schema(level.schema).parquet(f"{root}/depth={depth}")
    kind = dict(entries.dtypes)[by]
    schema = f"`{by}` {kind}, {NODES}, depth int"
    out = spark.read.schema(schema).parquet(root) if deepest >= 0 else spark.createDataFrame([], schema)
    out.veritree_path = root
    return out


def manifests(nodes: DataFrame, by: str = "tree") -> DataFrame:
    """The manifest of each tree: its root's digest, with the files, folders (the root included) and bytes."""
    return nodes.filter("depth = 0").select(by, "files", "folders", "bytes", "digest")


def differences(expected: DataFrame, observed: DataFrame, by: str = "tree", first: bool = False) -> DataFrame:
    """What differs between trees of one name: `by`, path, difference (missing, unexpected, kind, content, metadata).

    Goes down from the roots and joins, at each level, the children of folders with different digests only. With `first`, each tree is
    followed to the one difference that comes first in byte order of paths, part by part, and a folder before what is in it.
    """
    spark = expected.sparkSession
    columns = ("path", "parent", "category", "meta", "content", "digest")
    parts: list[DataFrame] = []
    with scratch(spark) as keep:
        frontier, depth = None, 0
        while True:
            sides = []
            for nodes, prefix in ((expected, "a_"), (observed, "b_")):
                level = nodes.filter(F.col("depth") == depth)
                if frontier is not None:
                    level = level.join(frontier.select(by, F.col("path").alias("parent")), [by, "parent"], "left_semi")
                sides.append(level.select(by, "path", *[F.col(c).alias(prefix + c) for c in columns[2:]]))
            same = F.col("a_digest").eqNullSafe(F.col("b_digest"))
            folder = (F.col("a_category") == "directory") & (F.col("b_category") == "directory")
            found = (
                F.when(F.col("b_digest").isNull(), "missing")
                .when(F.col("a_digest").isNull(), "unexpected")
                .when(F.col("a_category") != F.col("b_category"), "kind")
                .when(~folder & ~F.col("a_content").eqNullSafe(F.col("b_content")), "content")
                .when(~F.col("a_meta").eqNullSafe(F.col("b_meta")), "metadata")
            )
            level = sides[0].join(sides[1], [by, "path"], "full").filter(~same).select(by, "path", found.alias("difference"), F.coalesce(folder, F.lit(False)).alias("folder"))
            if first:
                level = level.groupBy(by).agg(F.min(F.struct("path", "difference", "folder")).alias("r")).select(by, "r.*")
            level = keep(written(level, "differences"))
            parts.append(level.filter("difference is not null").select(by, "path", "difference"))
            frontier = level.filter("folder and difference is null" if first else "folder")
            if frontier.isEmpty():
                break
            depth += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
