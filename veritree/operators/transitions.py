"""State transitions: actions against a snapshot, moves of a namespace, workflow attempts and their invariants."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a task of a replay sorts, about.
TASK_ROWS = 400_000


def forward_state(actions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Each action's state in a snapshot: applied, unapplied, or conflict where neither or both of its paths hold its identity.

    actions: action_id, before, after, sha256; snapshot: path, sha256.
    """
    at = lambda side: snapshot.select(F.col("path").alias(side), F.col("sha256").alias(f"{side}_sha"))
    both = actions.join(at("before"), "before", "left").join(at("after"), "after", "left")
    here, there = F.col("before_sha"), F.col("after_sha")
    state = F.when(here.isNull() & there.eqNullSafe(F.col("sha256")), "applied").when(there.isNull() & here.eqNullSafe(F.col("sha256")), "unapplied").otherwise("conflict")
    return both.select("action_id", "before", "after", state.alias("state"))


def moved(namespace: DataFrame, moves: DataFrame) -> DataFrame:
    """A namespace after moves, with the path each file came from. namespace: path, kind; moves: source, target."""
    out = namespace.join(moves, namespace["path"] == moves["source"], "left")
    return out.select(F.coalesce("target", "path").alias("path"), F.col("path").alias("origin"), "kind")


def collisions(namespace: DataFrame) -> DataFrame:
    """Paths, compared case-blind, that a namespace holds more than once; moves that make any are refused."""
    return namespace.groupBy(F.lower("path").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).filter("n > 1")


def removable_folders(entries: DataFrame) -> DataFrame:
    """Folders that hold only ignored files, at least one, in their whole subtree. entries: path (of files), is_ignored."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    below = entries.filter(F.size(parts) > 1).select(F.explode(above).alias("folder"), "is_ignored")
    return below.groupBy("folder").agg(F.bool_and("is_ignored").alias("only"), F.count(F.lit(1)).alias("files")).filter("only").select("folder", "files")


def exact_ids(planned: DataFrame, completed: DataFrame, column: str) -> DataFrame:
    """Ids that are only planned, only completed, or repeated on a side; no row means that both sides are the same set."""
    one = planned.groupBy(column).agg(F.count(F.lit(1)).alias("p"))
    two = completed.groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    problem = F.when(F.col("c").isNull(), "not-completed").when(F.col("p").isNull(), "not-planned").when((F.col("p") > 1) | (F.col("c") > 1), "repeated")
    return one.join(two, column, "full").select(column, problem.alias("problem")).filter("problem is not null")


def attempt_errors(attempts: DataFrame) -> DataFrame:
    """Attempts out of order: sequence numbers with gaps, or a stage other than the one the attempts before have reached.

    attempts: workflow, seq (from 0), stage (from 0), advance (boolean). An ordered fold as two windows.
    """
    w = Window.partitionBy("workflow").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    expected = F.coalesce(F.sum(F.col("advance").cast("int")).over(before), F.lit(0))
    gap = F.col("seq") != F.coalesce(F.lag("seq").over(w) + 1, F.lit(0))
    marked = attempts.withColumn("expected", expected.cast("int")).withColumn("gap", gap)
    error = F.when(F.col("gap"), "sequence").when(F.col("stage") != F.col("expected"), "stage")
    return marked.select("workflow", "seq", "stage", "expected", error.alias("error")).filter("error is not null")


def workflow_status(attempts: DataFrame, stages: int) -> DataFrame:
    """not-started is a workflow without attempts and so no row here; complete, stopped (its last attempt failed) or pending."""
    last = attempts.groupBy("workflow").agg(F.sum(F.col("advance").cast("int")).alias("reached"), F.max(F.struct("seq", "exit_status"))["exit_status"].alias("last_status"), F.count(F.lit(1)).alias("attempts"))
    status = F.when(F.col("reached") >= stages, "complete").when(F.col("last_status") != 0, "stopped").otherwise("pending")
    return last.select("workflow", "attempts", F.col("reached").cast("long").alias("reached"), status.alias("status"))


def outcome_problems(outcomes: DataFrame) -> DataFrame:
    """Scan outcomes that break an invariant, with the first one broken. Columns: run, files, pictures, videos, other, media, groups, extra_copies, duplicate_bytes, scanned_bytes."""
    c = F.col
    problem = (
        F.when(c("pictures") + c("videos") + c("other") != c("files"), "kinds-sum")
        .when(c("pictures") + c("videos") != c("media"), "media-sum")
        .when((c("groups") > c("extra_copies")) | (c("extra_copies") > c("files")), "duplicate-counts")
        .when(c("duplicate_bytes") > c("scanned_bytes"), "duplicate-bytes")
    )
    return outcomes.select("run", problem.alias("problem")).filter("problem is not null")


def verdict_problems(outcomes: DataFrame) -> DataFrame:
    """Preservation outcomes that contradict themselves, with the first rule broken: what is accounted for and what is not add up, for contents and for files; a complete verdict has no reasons and leaves
    nothing out; status 0 and a complete verdict go together. Columns: run, verdict, status, reasons (array), and streams, accounted_streams, unaccounted_streams, files, accounted_files, unaccounted_files."""
    c = F.col
    complete = c("verdict") == "complete"
    problem = (
        F.when(~c("verdict").isin("complete", "incomplete", "unproven"), "verdict")
        .when(c("accounted_streams") + c("unaccounted_streams") != c("streams"), "streams-sum")
        .when(c("accounted_files") + c("unaccounted_files") != c("files"), "files-sum")
        .when(complete & ((F.size("reasons") > 0) | (c("unaccounted_streams") > 0)), "complete")
        .when(~complete & (F.size("reasons") == 0), "no-reason")
        .when(complete != (c("status") == 0), "status")
    )
    return outcomes.select("run", problem.alias("problem")).filter("problem is not null")


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions that follow the number of rows, so that what a task sorts does not grow with them; one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))


def simulate(actions: DataFrame, entries: DataFrame, order: str = "seq", rows: int | None = None) -> DataFrame:
    """Sequential replay of renames, one run at a time: the first action of each run that finds its source gone or its target taken.

    actions: run_id, seq, before, after; entries: run_id, path. Whether a path is taken before an action is what it held at first plus what came less
    what went, a running sum over that path's own events; it holds up to the first problem of a run, which is all that is reported. So no task replays a run.
    Entries are events too, before all others, so nothing is joined. Events are dealt out by run and path to as many tasks as their number asks for: two for
    each action and one for each entry are counted unless `rows` gives about how many there are.
    """
    spark = actions.sparkSession
    n = tasks_for(spark, 2 * actions.count() + entries.count() if rows is None else rows)
    went, came = (F.struct(F.lit(step).alias("step"), F.col(side).alias("path")) for step, side in ((0, "before"), (1, "after")))
    steps = actions.select("run_id", F.col(order).alias("seq"), F.explode(F.array(went, came)).alias("e")).select("run_id", "seq", "e.path", "e.step")
    held = entries.filter("path is not null").select("run_id", F.lit(None).cast(steps.schema["seq"].dataType).alias("seq"), "path", F.lit(-1).alias("step"))
    events = steps.unionByName(held).repartition(n, "run_id", "path")
    w = Window.partitionBy("run_id", "path").orderBy(F.col("step") >= 0, "seq", "step").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("step") >= 0, 2 * F.col("step") - 1)
    taken = F.coalesce(F.max((F.col("step") < 0).cast("int")).over(w), F.lit(0)) + F.coalesce(F.sum(change).over(w), F.lit(0))
    marked = events.withColumn("taken", taken)
    problem = F.when((F.col("step") == 0) & (F.col("taken") < 1), "missing").when((F.col("step") == 1) & (F.col("taken") > 0), "occupied")
    found = marked.withColumn("problem", problem).filter("problem is not null").select("run_id", "seq", "step", "problem").repartition(n, "run_id")
    first = found.groupBy("run_id").agg(F.min(F.struct("seq", "step", "problem")).alias("p"))
    return first.select("run_id", F.col("p.seq").cast("long").alias("seq"), "p.problem")
