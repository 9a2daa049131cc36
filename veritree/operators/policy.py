"""Predicates on policies, receipts and queue jobs: what must hold before anything runs unattended. All inputs are small tables of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def receipt_problems(receipts: DataFrame, policies: DataFrame) -> DataFrame:
    """Receipts that bind no policy, another policy's bytes, or another candidate. receipts: job, policy_sha256, candidate; policies: job, content (binary), candidate."""
    given = policies.select("job", F.sha2("content", 256).alias("have"), F.col("candidate").alias("wanted"))
    rows = receipts.join(given, "job", "left")
    problem = F.when(F.col("have").isNull(), "no-policy").when(F.col("have") != F.col("policy_sha256"), "bytes").when(~F.col("wanted").eqNullSafe(F.col("candidate")), "candidate")
    return rows.select("job", problem.alias("problem")).filter("problem is not null")


def binding_problems(bindings: DataFrame, runs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Runs whose binding record is missing or differs from what the run observed in any of the columns, nulls equal; with the first one that differs."""
    rows = runs.select("run", *[F.col(c).alias(f"seen_{c}") for c in columns]).join(bindings.select("run", F.lit(True).alias("bound"), *columns), "run", "left")
    problem = F.when(F.col("bound").isNull(), "unbound")
    for c in columns:
        problem = problem.when(~F.col(c).eqNullSafe(F.col(f"seen_{c}")), c)
    return rows.select("run", problem.alias("problem")).filter("problem is not null")


def job_problems(jobs: DataFrame, roots: DataFrame) -> DataFrame:
    """Queue jobs that cannot be bound, with the first reason: a root that was not observed, one root in the other, one device where two are needed, or a folder of an earlier job used again.

    jobs: ordinal, source, working, two_devices (boolean); roots: path, device, ancestry (device:inode of itself and all above, leaf to root).
    """
    at = lambda side: roots.select(F.col("path").alias(side), F.col("device").alias(f"{side}_device"), F.col("ancestry").alias(f"{side}_up"))
    rows = jobs.join(at("source"), "source", "left").join(at("working"), "working", "left")
    used = jobs.select(F.explode(F.array("source", "working")).alias("path"), "ordinal").groupBy("path").agg(F.min("ordinal").alias("first"))
    again = lambda side: used.select(F.col("path").alias(side), F.col("first").alias(f"{side}_first"))
    rows = rows.join(again("source"), "source").join(again("working"), "working")
    a, b = F.col("source_up"), F.col("working_up")
    problem = (
        F.when(a.isNull() | b.isNull(), "root")
        .when(F.array_contains(a, F.element_at(b, 1)) | F.array_contains(b, F.element_at(a, 1)), "nested")
        .when(F.col("two_devices") & (F.col("source_device") == F.col("working_device")), "device")
        .when((F.col("source_first") < F.col("ordinal")) | (F.col("working_first") < F.col("ordinal")), "repeated")
    )
    return rows.select("ordinal", problem.alias("problem")).filter("problem is not null")


def last_meeting(attempts: DataFrame, by: str, condition: str) -> DataFrame:
    """The last attempt of each group, if it meets a condition; an earlier one that does counts for nothing. attempts: by, ordinal and what the condition reads."""
    columns = [c for c in attempts.columns if c not in (by, "ordinal")]
    last = attempts.groupBy(by).agg(F.max(F.struct("ordinal", *columns)).alias("r")).select(by, "r.*")
    return last.filter(condition)


def artifact_problems(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Artifacts of jobs that are missing, unexpected, or of another digest. Both: job, name, sha256."""
    rows = expected.select("job", "name", F.col("sha256").alias("want")).join(found.select("job", "name", F.col("sha256").alias("have")), ["job", "name"], "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("have") != F.col("want"), "changed")
    return rows.select("job", "name", problem.alias("problem")).filter("problem is not null")


def signoff_problems(outcomes: DataFrame) -> DataFrame:
    """Outcomes that cannot be signed off, with the first reason: a status other than 0, a verdict other than complete, reasons, or anything unaccounted or unsupported."""
    c = F.col
    problem = (
        F.when(c("status") != 0, "status").when(c("verdict") != "complete", "verdict").when(F.size("reasons") > 0, "reasons")
        .when(c("unaccounted") > 0, "unaccounted").when(c("unsupported") > 0, "unsupported")
    )
    return outcomes.select("job", problem.alias("problem")).filter("problem is not null")
