"""A namespace over many stages of moves: where each file came from, what exists at the end, and the digest of every stage.

Moves are sparse, so a stage costs what it moves, not what there is. Each move is an edge from the latest move that arrived at its source before; chains of
edges are followed by pointer doubling, in rounds that grow with the logarithm of the number of stages. Nothing is joined stage upon stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritree.plans.shared import scratch, written


def _edges(namespace: DataFrame, moves: DataFrame) -> DataFrame:
    """Each move with the stage of the latest arrival at its source before it (null: the file was there from the start), and problem where the source is empty or the target is not.

    Events of one path are at most two a stage, so windows over them stay small.
    """
    leave = moves.select(F.col("source").alias("path"), "stage", F.lit(0).alias("arrives"), "target")
    arrive = moves.select(F.col("target").alias("path"), "stage", F.lit(1).alias("arrives"), F.col("source").alias("target"))
    there = namespace.select("path", F.lit(0).cast("int").alias("stage"), F.lit(1).alias("arrives"), F.lit(None).cast("string").alias("target"))
    w = Window.partitionBy("path").orderBy("stage", "arrives")  # within a stage a path is left before it is taken
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last_arrival = F.max(F.when(F.col("arrives") == 1, F.col("stage"))).over(before)
    occupied = F.coalesce(F.lag("arrives").over(w) == 1, F.lit(False))
    seen = leave.unionByName(arrive).unionByName(there).withColumns({"last": last_arrival, "occupied": occupied}).filter("stage > 0")
    left = seen.filter("arrives = 0").select(F.col("path").alias("source"), "stage", "target", F.when(F.col("last") > 0, F.col("last")).alias("from_stage"), F.when(~F.col("occupied"), "no-source").alias("no_source"))
    taken = seen.filter("arrives = 1").select(F.col("path").alias("target"), "stage", F.when(F.col("occupied"), "occupied").alias("taken"))
    return left.join(taken, ["target", "stage"]).select("stage", "source", "target", "from_stage", F.coalesce("no_source", "taken").alias("problem"))


def move_problems(namespace: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves from a path that holds no file at their stage (no-source), or to one that holds another (occupied): stage, source, target, problem. A stage's moves happen at once, so swaps are none."""
    return _edges(namespace, moves).filter("problem is not null").select("stage", "source", "target", "problem")


def origins(namespace: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The namespace after all stages (path, origin, moves: how often the file moved), and the moves with the origin of the file that each moves.

    namespace: path; moves: stage (from 1), source, target, without problems.
    """
    with scratch(namespace.sparkSession) as keep:
        edges = written(_edges(namespace, moves).drop("problem"), "edges")
        # a pointer goes from a move to an earlier one of the same file, and counts the moves between
        at = written(edges.select("stage", "target", F.col("source").alias("to_path"), F.col("from_stage").cast("int").alias("to_stage"), F.lit(1).alias("moves")), "pointers")
        while not at.filter("to_stage is not null").isEmpty():
            to = at.select(F.col("stage").alias("to_stage"), F.col("target").alias("to_path"), F.col("to_path").alias("p"), F.col("to_stage").alias("s"), F.col("moves").alias("m"))
            open_, done = at.filter("to_stage is not null"), at.filter("to_stage is null")
            at = written(done.unionByName(open_.join(to, ["to_stage", "to_path"]).select("stage", "target", F.col("p").alias("to_path"), F.col("s").alias("to_stage"), (F.col("moves") + F.col("m")).alias("moves"))), "pointers")
        traced = keep(written(edges.join(at.select("stage", "target", F.col("to_path").alias("origin"), "moves"), ["stage", "target"]).select("stage", "source", "target", "origin", "moves"), "traced"))
    events = moves.select(F.col("source").alias("path"), "stage", F.lit(0).alias("arrives")).unionByName(moves.select(F.col("target").alias("path"), "stage", F.lit(1).alias("arrives")))
    last = namespace.select("path", F.lit(0).alias("stage"), F.lit(1).alias("arrives")).unionByName(events).groupBy("path").agg(F.max(F.struct("stage", "arrives")).alias("r")).filter("r.arrives = 1").select("path", "r.stage")
    final = last.join(traced.select(F.col("target").alias("path"), "stage", "origin", "moves"), ["path", "stage"], "left")
    return final.select("path", F.coalesce("origin", "path").alias("origin"), F.coalesce("moves", F.lit(0)).alias("moves")), traced


def folders_after(folders: DataFrame, changes: DataFrame) -> DataFrame:
    """The folders that exist after all stages, with the stage of their last birth (0: from the start). folders: path; changes: stage, path, change (created or removed)."""
    events = folders.select("path", F.lit(0).alias("stage"), F.lit("created").alias("change")).unionByName(changes.select("path", "stage", "change"))
    return events.groupBy("path").agg(F.max(F.struct("stage", F.col("change") == "created")).alias("r")).filter("r.col2").select("path", F.col("r.stage").alias("stage"))


def folder_problems(folders: DataFrame, changes: DataFrame) -> DataFrame:
    """Folders that are created where there is one, or removed where there is none: stage, path, problem."""
    events = folders.select("path", F.lit(0).alias("stage"), F.lit("created").alias("change")).unionByName(changes.select("path", "stage", "change"))
    w = Window.partitionBy("path").orderBy("stage", F.desc("change"))  # removed before created within a stage
    before = F.coalesce(F.lag("change").over(w), F.lit("removed"))
    return events.withColumn("before", before).filter("stage > 0 and before = change").select("stage", "path", F.when(F.col("change") == "created", "exists").otherwise("absent").alias("problem"))


def stage_digests(namespace: DataFrame, traced: DataFrame, changes: DataFrame, stages: int) -> DataFrame:
    """After each stage, from 0: files and folders moved, created and removed in it, and a digest of the whole namespace (paths with their contents, and folders).

    namespace: path, sha256 and, with a null sha256, folders; traced: moves with origin; changes: as in folders_after. The digest adds up words of each entry's SHA-256, so a stage adds what it
    brings and takes off what it leaves: one aggregate over moves, and running sums over a row a stage.
    """
    entry = lambda path: F.sha2(F.concat_ws("\x00", path, F.coalesce("sha256", F.lit("folder"))), 256)
    base = namespace.select(F.lit(0).alias("stage"), F.lit(1).alias("sign"), entry(F.col("path")).alias("h"), F.lit(0).alias("moved"), F.lit(0).alias("created"), F.lit(0).alias("removed"))
    of = traced.join(namespace.select(F.col("path").alias("origin"), "sha256"), "origin")
    count = lambda a, b, c: [F.lit(a).alias("moved"), F.lit(b).alias("created"), F.lit(c).alias("removed")]
    out = of.select("stage", F.lit(-1).alias("sign"), entry(F.col("source")).alias("h"), *count(0, 0, 0)).unionByName(of.select("stage", F.lit(1).alias("sign"), entry(F.col("target")).alias("h"), *count(1, 0, 0)))
    folder = changes.withColumn("sha256", F.lit(None).cast("string"))
    made = folder.filter("change = 'created'").select("stage", F.lit(1).alias("sign"), entry(F.col("path")).alias("h"), *count(0, 1, 0))
    gone = folder.filter("change = 'removed'").select("stage", F.lit(-1).alias("sign"), entry(F.col("path")).alias("h"), *count(0, 0, 1))
    every = namespace.sparkSession.range(stages + 1).select(F.col("id").cast("int").alias("stage"), F.lit(0).alias("sign"), F.lit("0" * 64).alias("h"), *count(0, 0, 0))
    word = lambda k: F.col("sign") * F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    each = base.unionByName(out).unionByName(made).unionByName(gone).unionByName(every).groupBy("stage").agg(*[F.sum(c).cast("long").alias(c) for c in ("moved", "created", "removed")], *[F.sum(word(k)).alias(f"w{k}") for k in range(4)])
    w = Window.orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)  # a row a stage
    sums = [F.sum(f"w{k}").over(w).cast("string") for k in range(4)]
    return each.select("stage", "moved", "created", "removed", F.sha2(F.concat_ws(":", *sums), 256).alias("digest"))
