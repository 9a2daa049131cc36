"""Reports over an append-only journal of runs, and findings and outcomes roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritree.functions.text import decomposed
from veritree.operators.duplicates import folded
from veritree.plans.ordering import numbered, running

#: Severities from worst to best.
SEVERITIES = ("error", "warning", "info")
# The events of a journal, the modes of a run, and what each operation on a path must state.
EVENTS = ("RUN_STARTED", "ACTION_PLANNED", "ACTION_COMPLETED", "RUN_COMMITTED", "RUN_INCOMPLETE")
MODES = ("APPLY", "UNDO")


def run_fold(events: DataFrame) -> DataFrame:
    """One row per run: its first and last sequence number, planned and completed actions, terminal state, and whether events after a terminal one make it malformed.

    events: run_id, seq, event (started, planned, completed, committed or incomplete).
    """
    terminal = F.col("event").isin("committed", "incomplete")
    last = F.max(F.when(terminal, F.col("seq")))
    n = lambda name: F.count(F.when(F.col("event") == name, 1))
    return events.groupBy("run_id").agg(
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        n("planned").alias("planned"),
        n("completed").alias("completed"),
        F.coalesce(F.max(F.when(terminal, F.struct("seq", "event")))["event"], F.lit("open")).alias("state"),
        F.coalesce(F.max("seq") > last, F.lit(False)).alias("malformed"),
    )


def event_problems(events: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """seq, run_id and the first rule broken of every event that a strict reader refuses; no row means a sound journal.

    events: seq, run_id, event, tool, mode, target_run_id, action_id, action_count, reason. Runs start once, name a known tool and mode, and
    a target only if they undo; events follow a start and no terminal event; an action is planned once and completed once, after
    its plan; a commit counts its actions, all of them completed, and repeats its run's target; an incomplete end has a reason.
    """
    c = F.col
    run = Window.partitionBy("run_id").orderBy("seq")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    action = Window.partitionBy("run_id", "action_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda name, w: F.coalesce(F.sum((c("event") == name).cast("int")).over(w), F.lit(0))
    start = c("event") == "RUN_STARTED"
    marked = events.withColumns({
        "starts": seen("RUN_STARTED", before), "planned": seen("ACTION_PLANNED", before), "completed": seen("ACTION_COMPLETED", before),
        "ended": seen("RUN_COMMITTED", before) + seen("RUN_INCOMPLETE", before), "own_planned": seen("ACTION_PLANNED", action), "own_completed": seen("ACTION_COMPLETED", action),
        "run_target": F.first(F.when(start, c("target_run_id")), ignorenulls=True).over(before),
    })
    no_action = F.coalesce(c("action_id"), F.lit("")) == ""
    problem = (
        F.when(c("event").isNull() | ~c("event").isin(*EVENTS), "unknown-event")
        .when(start & (c("starts") > 0), "duplicate-run")
        .when(start & (c("tool").isNull() | ~c("tool").isin(*tools)), "tool")
        .when(start & (c("mode").isNull() | ~c("mode").isin(*MODES)), "mode")
        .when(start & (c("mode") == "APPLY") & c("target_run_id").isNotNull(), "unexpected-target")
        .when(start & (c("mode") == "UNDO") & (F.coalesce(c("target_run_id"), F.lit("")) == ""), "no-target")
        .when(~start & (c("starts") == 0), "unknown-run")
        .when(~start & (c("ended") > 0), "after-end")
        .when(c("event").isin("ACTION_PLANNED", "ACTION_COMPLETED") & no_action, "no-action")
        .when((c("event") == "ACTION_PLANNED") & (c("own_planned") > 0), "duplicate-action")
        .when((c("event") == "ACTION_COMPLETED") & (c("own_planned") == 0), "not-planned")
        .when((c("event") == "ACTION_COMPLETED") & (c("own_completed") > 0), "completed-twice")
        .when((c("event") == "RUN_COMMITTED") & (c("action_count").isNull() | (c("action_count") != c("planned")) | (c("action_count") != c("completed"))), "count")
        .when((c("event") == "RUN_COMMITTED") & ~c("target_run_id").eqNullSafe(c("run_target")), "commit-target")
        .when((c("event") == "RUN_INCOMPLETE") & c("reason").isNull(), "no-reason")
    )
    return marked.select("seq", "run_id", problem.alias("problem")).filter("problem is not null")


def run_records(events: DataFrame) -> DataFrame:
    """One row for each run of a sound journal: tool, mode, target, first sequence number, planned and completed actions, and state (open, committed, incomplete)."""
    start = F.col("event") == "RUN_STARTED"
    n = lambda name: F.count(F.when(F.col("event") == name, 1))
    state = F.when(n("RUN_COMMITTED") > 0, "committed").when(n("RUN_INCOMPLETE") > 0, "incomplete").otherwise("open")
    of = lambda name: F.max(F.when(start, F.col(name)))
    return events.groupBy("run_id").agg(of("tool").alias("tool"), of("mode").alias("mode"), of("target_run_id").alias("target_run_id"), F.min(F.when(start, F.col("seq"))).alias("started"), n("ACTION_PLANNED").alias("planned"), n("ACTION_COMPLETED").alias("completed"), state.alias("state"))


def undo_problems(runs: DataFrame) -> DataFrame:
    """Undo runs whose target is unknown, no apply run, of another tool or not earlier, and those that commit a second undo of one target. runs: as run_records."""
    undo = runs.filter("mode = 'UNDO'").select("run_id", "tool", "target_run_id", "started", "state")
    target = runs.select(F.col("run_id").alias("target_run_id"), F.col("tool").alias("t_tool"), F.col("mode").alias("t_mode"), F.col("started").alias("t_started"))
    w = Window.partitionBy("target_run_id", "state").orderBy("started", "run_id")
    rows = undo.withColumn("nth", F.row_number().over(w)).join(target, "target_run_id", "left")
    problem = (
        F.when(F.col("t_mode").isNull() | (F.col("t_mode") != "APPLY") | (F.col("t_tool") != F.col("tool")) | (F.col("t_started") >= F.col("started")), "target")
        .when((F.col("state") == "committed") & (F.col("nth") > 1), "undone-twice")
    )
    return rows.select("run_id", problem.alias("problem")).filter("problem is not null")


def undo_targets(runs: DataFrame) -> DataFrame:
    """tool, run_id and state of the run that an undo of each tool would revert: the newest apply run that is not undone; blocked if an undo of the tool is unfinished."""
    undone = runs.filter("mode = 'UNDO' and state = 'committed'").select(F.col("target_run_id").alias("run_id"))
    active = runs.filter("mode = 'APPLY'").join(undone, "run_id", "left_anti")
    open_undo = runs.filter("mode = 'UNDO' and state <> 'committed'").select("tool", F.lit(True).alias("blocked")).distinct()
    return latest_per(active, "tool", "started", ("run_id", "state")).join(open_undo, "tool", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def undo_plan(targets: DataFrame, states: DataFrame) -> DataFrame:
    """The steps that revert each tool's target, last action first, with before and after exchanged; `problem` where a file is in neither state, or a committed action is not in effect.

    targets: undo_targets; states: run_id, action_seq, before, after, state (applied, unapplied or conflict). Actions of an unfinished run that never took effect need no step.
    """
    rows = targets.select("tool", "run_id", F.col("state").alias("run_state"), "blocked").join(states, "run_id")
    rows = rows.filter(~((F.col("run_state") != "committed") & (F.col("state") == "unapplied")))
    problem = F.when(F.col("blocked"), "unfinished-undo").when(F.col("state") == "conflict", "conflict").when(F.col("state") == "unapplied", "not-applied")
    steps = rows.select("tool", "run_id", "action_seq", F.col("after").alias("before"), F.col("before").alias("after"), problem.alias("problem"))
    return numbered(steps, [-F.col("action_seq")], ("tool",), "step").select("tool", "run_id", F.col("step").cast("int").alias("step"), "before", "after", "problem")


def action_problems(actions: DataFrame, required: dict[str, tuple[str, ...]]) -> DataFrame:
    """Actions of unknown operations, or without a field that their operation requires; required: operation -> fields."""
    lacking = F.lit(None).cast("string")
    for operation, fields in required.items():
        for f in reversed(fields):
            lacking = F.when((F.col("operation") == operation) & F.col(f).isNull(), F.lit(f)).otherwise(lacking)
    problem = F.when(F.col("operation").isNull() | ~F.col("operation").isin(*required), "operation").otherwise(lacking)
    return actions.select("action_id", problem.alias("problem")).filter("problem is not null")


def active_runs(runs: DataFrame) -> DataFrame:
    """Committed runs that no committed undo names as its target."""
    undone = runs.filter("mode = 'undo' and state = 'committed'").select(F.col("target_run_id").alias("run_id"))
    return runs.filter("mode = 'apply' and state = 'committed'").join(undone, "run_id", "left_anti")


def latest_per(runs: DataFrame, by: str, order: str, columns: tuple[str, ...]) -> DataFrame:
    """Of each value of `by` the row with the greatest `order`; an aggregate that combines map-side."""
    top = runs.groupBy(by).agg(F.max(F.struct(order, *columns)).alias("r"))
    return top.select(by, F.col(f"r.{order}").alias(order), *[F.col(f"r.{c}").alias(c) for c in columns])


def path_key(path: Column) -> Column:
    """A text by which paths sort as trees do: what lies under a path follows it, before anything else."""
    return F.concat(F.replace(path, F.lit("/"), F.lit("\x01")), F.lit("\x01"))


#: Sorts after everything under a path.
_LAST = "\U0010ffff"


def later_blockers(actions: DataFrame, target: int, active: DataFrame | None = None) -> DataFrame:
    """Runs after the target whose paths equal, contain or lie under one of its paths, or that touch an inode of it; with `active` (run_no), only runs among these.

    actions: run_no, path, inode. Paths are put in the order of trees once. What lies under a path is an interval there, and intervals nest, so a later path lies under a target's one if the
    greatest end of the target's intervals up to it is behind it, and contains one if the next target's path is within its own interval. Two running
    passes over one row a path, however deep paths are.
    """
    rows = actions.filter(F.col("run_no") >= target)
    if active is not None:
        rows = rows.join(active.select("run_no").distinct().unionByName(rows.select("run_no").filter(F.col("run_no") == target).limit(1)), "run_no", "left_semi")
    own = F.col("run_no") == target
    paths = rows.select(F.when(own, None).otherwise(F.col("run_no")).alias("later"), path_key(F.col("path")).alias("key")).distinct()
    end = F.concat("key", F.lit(_LAST))
    first = F.col("later").isNotNull().cast("int")  # a target's path stands before an equal one
    under = running(paths, [F.col("key"), first, F.col("later")], greatest={"reach": F.when(F.col("later").isNull(), end)}).filter("later is not null and reach >= key").select("later")
    # from the end: the least target's path that is not before this one, as the greatest of its turned place
    turned = paths.select("later", "key").withColumn("next", F.when(F.col("later").isNull(), F.col("key")))
    over = following(turned, F.col("key"), F.col("later"), F.col("next")).filter(F.col("later").isNotNull() & (F.col("next_key") <= end)).select("later")
    inode = rows.filter(~own).join(rows.filter(own).select("inode").distinct(), "inode", "left_semi").select(F.col("run_no").alias("later"))
    return under.unionByName(over).unionByName(inode).distinct().withColumnRenamed("later", "run_no")


def following(paths: DataFrame, key: Column, later: Column, value: Column) -> DataFrame:
    """paths with next_key, the least `value` at or behind each place of the order by key. The number of values before a place names it, so this is a running count and an equi-join."""
    counted = running(paths.select("later", key.alias("key"), value.alias("value")), [F.col("key"), F.col("value").isNotNull().cast("int"), F.col("later")], sums={"before": F.col("value").isNotNull().cast("long")})
    values = counted.filter("value is not null").select((F.col("before") - 1).alias("before"), F.col("value").alias("next_key"))
    return counted.filter("value is null").select("later", "key", "before").join(values, "before").select("later", "key", "next_key")


def undo_order(actions: DataFrame) -> DataFrame:
    """Completed actions of each run reversed, last first, with before and after exchanged."""
    steps = actions.filter("applied").select("run_id", "action_seq", "operation", F.col("after").alias("before"), F.col("before").alias("after"))
    return numbered(steps, [-F.col("action_seq")], ("run_id",), "step").select("run_id", F.col("step").cast("int").alias("step"), "operation", "before", "after")


def findings_rollup(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("path").alias("paths"))


def file_health(findings: DataFrame) -> DataFrame:
    """Each path's worst severity decides: error, warning or healthy (info is healthy); counted once."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    worst = findings.groupBy("path").agg(F.max(rank).alias("r"))
    return worst.groupBy(F.when(F.col("r") == 2, "error").when(F.col("r") == 1, "warning").otherwise("healthy").alias("health")).agg(F.count(F.lit(1)).alias("files"))


def policy_match(observed: DataFrame, expected: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Per checkpoint: whether what was observed equals what was authorised; unknown checkpoints match nothing."""
    one = observed.select("checkpoint", F.struct(*columns).alias("o"))
    two = expected.select("checkpoint", F.struct(*columns).alias("e"))
    return one.join(two, "checkpoint", "left").select("checkpoint", F.when(F.col("e").isNull(), "not-authorised").when(F.col("o").eqNullSafe(F.col("e")), "match").otherwise("mismatch").alias("decision"))


def exact_cover(have: DataFrame, want: DataFrame, column: str) -> DataFrame:
    """Values missing from, or unexpected in, a set that must cover another exactly."""
    a, b = have.select(column).distinct(), want.select(column).distinct()
    return b.exceptAll(a).withColumn("problem", F.lit("missing")).unionByName(a.exceptAll(b).withColumn("problem", F.lit("unexpected")))


def layered_config(layers: DataFrame) -> DataFrame:
    """Values of ordered layers, each once (case-blind) at its first place. layers: ordinal, value."""
    return layers.groupBy(F.lower("value").alias("key")).agg(F.min(F.struct("ordinal", "value")).alias("r")).select("key", F.col("r.ordinal").alias("ordinal"), F.col("r.value").alias("value"))


def progress(items: DataFrame, by: str, order: tuple[str, ...], size: str) -> DataFrame:
    """Running count and sum per group in the given order, and the group's total."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    return items.select(by, order[0], F.count(F.lit(1)).over(w).alias("done"), F.sum(size).over(w).alias("done_size"), F.count(F.lit(1)).over(whole).alias("total"))


def progress_windows(events: DataFrame, by: str, width: str, late: str | None = None) -> DataFrame:
    """Items and bytes completed in each window of event time, for a table or, with `late` (how long events may come after their time), a stream: by, ends, items, bytes, first_ts.

    events: by, ts, bytes (null or negative: none).
    """
    rows = events.withWatermark("ts", late) if late is not None else events
    size = F.greatest(F.coalesce(F.col("bytes"), F.lit(0)), F.lit(0)).cast("long")
    one = rows.groupBy(F.window("ts", width), by).agg(F.count(F.lit(1)).alias("items"), F.sum(size).alias("bytes"), F.min("ts").alias("first_ts"))
    return one.select(by, F.col("window.end").alias("ends"), "items", "bytes", "first_ts")


def progress_eta(windows: DataFrame, totals: DataFrame, by: str) -> DataFrame:
    """At the end of each window what is done, the rate, and the seconds that are left: by bytes where there are any, else by items; none before three items are done, and none behind the last.

    windows: progress_windows; totals: by, total_items, total_bytes (null: unknown). A window is one row, so the running sums are over few rows a group.
    """
    w = Window.partitionBy(by).orderBy("ends").rowsBetween(Window.unboundedPreceding, 0)
    rows = windows.select(by, "ends", F.sum("items").over(w).alias("done"), F.sum("bytes").over(w).alias("done_bytes"), F.min("first_ts").over(w).alias("began")).join(totals, by)
    elapsed = F.col("ends").cast("double") - F.col("began").cast("double")
    by_bytes = (F.coalesce("total_bytes", F.lit(0)) > 0) & (F.col("done_bytes") > 0)
    left = lambda total, done: elapsed * F.greatest(F.col(total) - F.col(done), F.lit(0)) / F.col(done)
    eta = F.when((F.col("done") >= 3) & (F.col("done") < F.col("total_items")), F.when(by_bytes, left("total_bytes", "done_bytes")).otherwise(left("total_items", "done")))
    rate = F.when(elapsed > 0, F.when(F.col("done_bytes") > 0, F.col("done_bytes") / elapsed).otherwise(F.col("done") / elapsed))
    return rows.select(by, "ends", "done", "done_bytes", F.round(elapsed, 3).alias("elapsed"), F.round(rate, 6).alias("rate"), F.round(eta, 3).alias("eta_seconds"))


def capacity(files: DataFrame, by: str, block: int, reserve: int) -> DataFrame:
    """Bytes a copy needs: the reserve and every size rounded up to whole blocks."""
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("long")
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), (F.sum(blocks * block) + reserve).alias("required"))


def overlaps(endpoints: DataFrame) -> DataFrame:
    """Pairs of endpoints one of which lies in the other: an equi-join of own identities with exploded ancestries. endpoints: ordinal, id, ancestry (array of ids, itself included)."""
    own = endpoints.select(F.col("ordinal").alias("outer"), F.col("id"))
    up = endpoints.select(F.col("ordinal").alias("inner"), F.explode("ancestry").alias("id"))
    return up.join(own, "id").filter("inner <> outer").select("outer", "inner").distinct()


def same_leaves(endpoints: DataFrame) -> DataFrame:
    """Endpoints that do not exist yet and would be one entry of their parent: each with the first of its group, so groups give as many rows as they have members. endpoints: ordinal, parent (the id of the folder), name.

    Names are compared in canonical decomposition and case-blind, as a file system may spell either.
    """
    rows = endpoints.select("ordinal", "parent", folded(decomposed(F.col("name"))).alias("key"))
    first = rows.groupBy("parent", "key").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("parent", "key", "first")
    return rows.join(first, ["parent", "key"]).filter("ordinal <> first").select("first", "ordinal")


def queue_expand(jobs: DataFrame, stages: tuple[str, ...], authorised: DataFrame) -> DataFrame:
    """Every stage of every job with its authorisation, if any. stages is a fixed short list, exploded in place."""
    every = F.posexplode(F.array(*[F.lit(s) for s in stages])).alias("at", "stage")
    rows = jobs.select("ordinal", every).withColumn("stage_no", F.col("at") + 1)
    return rows.join(authorised, ["ordinal", "stage"], "left").select("ordinal", "stage", "stage_no", F.coalesce("decision", F.lit("ask")).alias("decision"))


def job_states(jobs: DataFrame, attempts: DataFrame, stages: int) -> DataFrame:
    """completed (all stages passed), retry_required (the last attempt failed) or resumable, for each job of a queue; attempts: job, ordinal, stage, status."""
    last = attempts.groupBy("job").agg(F.max(F.struct("ordinal", "status"))["status"].alias("status"), F.countDistinct(F.when(F.col("status") == 0, F.col("stage"))).alias("passed"))
    rows = jobs.join(last, "job", "left")
    state = F.when(F.coalesce("passed", F.lit(0)) >= stages, "completed").when(F.coalesce("status", F.lit(0)) != 0, "retry_required").otherwise("resumable")
    return rows.select("job", F.coalesce("passed", F.lit(0)).cast("long").alias("passed"), state.alias("state"))


def queue_order(states: DataFrame) -> DataFrame:
    """What a queue runs: jobs in order up to the first that must be retried explicitly; `run`, `skip` (completed), `stop` there and `wait` behind it. states: ordinal, job, state.

    The first stop is one scalar, so no job waits in a sorted partition of all jobs.
    """
    first = states.agg(F.min(F.when(F.col("state") == "retry_required", F.col("ordinal"))).alias("first"))
    rows = states.join(F.broadcast(first))  # one row
    action = F.when(F.col("state") == "completed", "skip").when(F.col("ordinal") == F.col("first"), "stop").when(F.col("ordinal") > F.col("first"), "wait").otherwise("run")
    return rows.select("ordinal", "job", action.alias("action"))


def transition_problems(states: DataFrame) -> DataFrame:
    """Consecutive states of a workflow that differ by other than one valid attempt. states: workflow, version, attempts (array of statuses), next_stage.

    A following state appends one attempt, leaves the earlier ones as they are, and advances by one stage on status 0, else not at all.
    """
    w = Window.partitionBy("workflow").orderBy("version")
    rows = states.withColumns({"old": F.lag("attempts").over(w), "old_stage": F.lag("next_stage").over(w)}).filter("old is not null")
    moved = F.when(F.element_at("attempts", -1) == 0, 1).otherwise(0)
    problem = (
        F.when(F.size("attempts") != F.size("old") + 1, "attempts")
        .when(F.slice("attempts", F.lit(1), F.size("old")) != F.col("old"), "rewritten")
        .when(F.col("next_stage") != F.col("old_stage") + moved, "stage")
    )
    return rows.select("workflow", "version", problem.alias("problem")).filter("problem is not null")


def expectation_problems(expected: DataFrame, checkpoints: tuple[str, ...], of: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Authorised expectations that cannot be: unknown (by `of` a checkpoint) or repeated checkpoints, findings that are not sorted and unique, or a clean status beside findings. expected: ordinal, checkpoint, status, findings (array)."""
    w = Window.partitionBy("checkpoint").orderBy("ordinal")
    rows = expected.withColumn("nth", F.row_number().over(w))
    problem = (
        F.when(F.col("checkpoint").isNull() | ~of(F.col("checkpoint")).isin(*checkpoints), "checkpoint")
        .when(F.col("nth") > 1, "repeated")
        .when(F.col("findings") != F.array_sort(F.array_distinct("findings")), "findings-order")
        .when((F.col("status") == 0) & (F.size("findings") > 0), "status")
    )
    return rows.select("ordinal", "checkpoint", problem.alias("problem")).filter("problem is not null")


def applied_else_preview(outcomes: DataFrame, by: str) -> DataFrame:
    """The latest successful applied outcome of each group, else its latest preview. outcomes: by, ordinal, mode (apply or preview), status, payload."""
    of = lambda mode: F.max(F.when((F.col("mode") == mode) & (F.col("status") == 0), F.struct("ordinal", "payload")))
    top = outcomes.groupBy(by).agg(of("apply").alias("a"), of("preview").alias("p"))
    return top.select(by, F.when(F.col("a").isNotNull(), "apply").when(F.col("p").isNotNull(), "preview").alias("mode"), F.coalesce("a.payload", "p.payload").alias("payload"))


def attempt_outcomes(attempts: DataFrame, outcomes: DataFrame, stages: DataFrame) -> DataFrame:
    """Attempts with their outcome and stage: problem is missing-outcome, unknown-stage or wrong-command, null where all fit. attempts: attempt, stage, outcome_id; outcomes: outcome_id, command; stages: stage, command."""
    rows = attempts.join(outcomes.select("outcome_id", F.col("command").alias("had")), "outcome_id", "left").join(stages.select("stage", F.col("command").alias("wanted")), "stage", "left")
    problem = F.when(F.col("wanted").isNull(), "unknown-stage").when(F.col("had").isNull(), "missing-outcome").when(F.col("had") != F.col("wanted"), "wrong-command")
    return rows.select("attempt", "stage", F.col("had").alias("command"), problem.alias("problem"))


def synopsis(attempts: DataFrame, by: str = "stage") -> DataFrame:
    """Attempts, failures, total time and distinct subjects of each stage; attempts: by, status, milliseconds, subject."""
    return attempts.groupBy(by).agg(F.count(F.lit(1)).alias("attempts"), F.count(F.when(F.col("status") != 0, 1)).alias("findings"), F.sum("milliseconds").alias("duration_milliseconds"), F.countDistinct("subject").alias("users"))


def progress_milestones(items: DataFrame, by: str, order: tuple[str, ...]) -> DataFrame:
    """The items at which a tenth more of a group is done: ceil(total * k / 10), k from 1 to 10, each place once."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = items.select(by, *order, F.row_number().over(w).alias("done"), F.count(F.lit(1)).over(Window.partitionBy(by)).alias("total"))
    tenth = F.floor(F.col("done") * 10 / F.col("total"))
    before = F.floor((F.col("done") - 1) * 10 / F.col("total"))
    return rows.filter(tenth > before).select(by, "done", "total", (tenth * 10).cast("int").alias("percent"))
