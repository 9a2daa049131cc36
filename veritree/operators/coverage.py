"""Coverage of one file set by another: bytes first, then weaker layers, then a verdict.

Identity is (size, sha256). A verdict is complete, incomplete or unproven; anything that was not
enumerated fully makes it unproven. Each comparison aggregates each side by identity before it joins,
so copies never multiply rows and a hot identity is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDENTITY = ("size", "sha256")


def identities(files: DataFrame) -> DataFrame:
    return files.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("n"))


def joined(source: DataFrame, destination: DataFrame) -> DataFrame:
    """size, sha256, source_n, destination_n: null where one side lacks the identity. One aggregate over both sides, which combines map-side, in one exchange."""
    one = lambda df, name: df.select(*IDENTITY, F.lit(name).alias("side"))
    n = lambda name: F.nullif(F.count(F.when(F.col("side") == name, 1)), F.lit(0)).alias(f"{name}_n")
    return one(source, "source").unionByName(one(destination, "destination")).groupBy(*IDENTITY).agg(n("source"), n("destination"))


def _sum(c):
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def byte_coverage(source: DataFrame, destination: DataFrame, source_complete: bool = True, destination_complete: bool = True) -> DataFrame:
    """One row: how the destination represents the source's content, with the verdict."""
    return coverage_of(joined(source, destination), source_complete, destination_complete)


def joined_counts(source: DataFrame, destination: DataFrame) -> DataFrame:
    """As joined, of two tables that have one row an identity already (size, sha256, n): a join that takes the partitioning they have, and exchanges nothing where both are bucketed alike."""
    return source.withColumnRenamed("n", "source_n").join(destination.withColumnRenamed("n", "destination_n"), list(IDENTITY), "full")


def coverage_of(both: DataFrame, source_complete: bool = True, destination_complete: bool = True) -> DataFrame:
    """The row of byte_coverage for joined identities."""
    s, d = F.col("source_n"), F.col("destination_n")
    here, shared, gone = s.isNotNull(), s.isNotNull() & d.isNotNull(), s.isNotNull() & d.isNull()
    one = both.agg(
        _sum(here.cast("int")).alias("source_unique"),
        _sum(shared.cast("int")).alias("represented"),
        _sum(gone.cast("int")).alias("missing"),
        _sum(s.isNull().cast("int")).alias("destination_only"),
        _sum(F.when(here, F.col("size"))).alias("source_bytes"),
        _sum(F.when(gone, F.col("size"))).alias("missing_bytes"),
        _sum(F.when(shared, F.greatest(s - d, F.lit(0)))).alias("reduced"),
        _sum(F.when(shared, F.greatest(d - s, F.lit(0)))).alias("added"),
        _sum(F.when(here, s - 1)).alias("source_duplicate_copies"),
        _sum(F.when(here, F.col("size") * (s - 1))).alias("source_duplicate_bytes"),
    )
    percent = F.round(F.when(F.col("source_unique") == 0, 100.0).otherwise(100.0 * F.col("represented") / F.col("source_unique")), 6)
    verdict = F.when(F.lit(not source_complete), "unproven").when((F.col("missing") > 0) & F.lit(not destination_complete), "unproven").when(F.col("missing") > 0, "incomplete").otherwise("complete")
    return one.withColumn("coverage_percent", percent).withColumn("verdict", verdict)


def missing_files(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Source files whose content the destination lacks."""
    return source.join(destination.select(*IDENTITY), list(IDENTITY), "left_anti")


def multiplicity(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Represented identities with fewer or more copies than before."""
    both = joined(source, destination).filter("source_n is not null and destination_n is not null and source_n <> destination_n")
    return both.select(*IDENTITY, "source_n", "destination_n", F.greatest(F.col("source_n") - F.col("destination_n"), F.lit(0)).alias("reduced"), F.greatest(F.col("destination_n") - F.col("source_n"), F.lit(0)).alias("added"))


def second_layer(source: DataFrame, destination: DataFrame, digest: str, bucket: tuple[str, ...] = ()) -> DataFrame:
    """Byte-missing source identities with whether a weaker digest of any of their files, in that file's bucket (nulls equal), is found at the destination."""
    gone = missing_files(source, destination).select(*IDENTITY, F.col(digest).alias("digest"), F.struct(F.lit(0).alias("x"), *bucket).alias("bucket")).distinct()
    there = destination.filter(F.col(digest).isNotNull()).select(F.col(digest).alias("digest"), F.struct(F.lit(0).alias("x"), *bucket).alias("bucket"), F.lit(True).alias("hit")).distinct()
    # equal structs may hold equal nulls
    return gone.join(there, ["digest", "bucket"], "left").groupBy(*IDENTITY).agg(F.coalesce(F.max("hit"), F.lit(False)).alias("represented"))


def layered(source: DataFrame, destination: DataFrame, layers: list[tuple[str, tuple[str, ...]]], exact_kinds: tuple[str, ...] = ("picture", "video")) -> DataFrame:
    """Each source identity with the first layer that represents it: bytes, the given layers in order, else unsupported or missing."""
    kinds = source.groupBy(*IDENTITY).agg(F.max(F.col("kind").isin(*exact_kinds)).alias("exact"))
    out = kinds.join(identities(destination).select(*IDENTITY, F.lit("bytes").alias("by0")), list(IDENTITY), "left")
    names = ["by0"]
    for k, (digest, bucket) in enumerate(layers, 1):
        found = second_layer(source, destination, digest, bucket).filter("represented").select(*IDENTITY, F.lit(digest).alias(f"by{k}"))
        out = out.join(found, list(IDENTITY), "left")
        names.append(f"by{k}")
    return out.select(*IDENTITY, F.coalesce(*names, F.when(F.col("exact"), "missing").otherwise("unsupported")).alias("layer"))


def verdict(layers: DataFrame, issues: int = 0, stable: bool = True) -> DataFrame:
    """One row of counts per outcome and the verdict: unstable or unsupported evidence is unproven before anything is incomplete."""
    count = lambda name: _sum((F.col("layer") == name).cast("int"))
    one = layers.agg(F.count(F.lit(1)).alias("identities"), count("bytes").alias("by_bytes"), count("missing").alias("missing"), count("unsupported").alias("unsupported"))
    one = one.withColumn("by_other_layers", F.col("identities") - F.col("by_bytes") - F.col("missing") - F.col("unsupported"))
    return one.withColumn("verdict", F.when(F.lit(not stable or issues > 0) | (F.col("unsupported") > 0), "unproven").when(F.col("missing") > 0, "incomplete").otherwise("complete"))


def problem_paths(*issues: DataFrame) -> DataFrame:
    """All problems of several lists, each (path, category) once, in case-blind order of the path when shown."""
    out = issues[0].select("path", "category")
    for more in issues[1:]:
        out = out.unionByName(more.select("path", "category"))
    return out.distinct()


def side_report(files: DataFrame) -> DataFrame:
    """One row on one side: files, bytes, distinct contents and their bytes, and copies beyond the first."""
    return identities(files).agg(
        _sum("n").alias("files"), _sum(F.col("size") * F.col("n")).alias("bytes"), F.count(F.lit(1)).alias("streams"), _sum("size").alias("stream_bytes"),
        _sum(F.col("n") - 1).alias("duplicate_copies"), _sum(F.col("size") * (F.col("n") - 1)).alias("duplicate_bytes"),
    )


def percentages(counts: DataFrame, parts: tuple[str, ...], whole: str) -> DataFrame:
    """Each part's share of a whole in percent, to six places; nothing is wholly covered."""
    return counts.select("*", *[F.round(F.when(F.col(whole) == 0, 100.0).otherwise(100.0 * F.col(p) / F.col(whole)), 6).alias(f"{p}_percent") for p in parts])


def disposition(files: DataFrame, layers: DataFrame) -> DataFrame:
    """Every source file with the layer that accounts for its content, and whether it is accounted for."""
    rows = files.select("path", *IDENTITY).join(layers, list(IDENTITY))
    return rows.select("path", "layer", (~F.col("layer").isin("missing", "unsupported")).alias("accounted"))


def category_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entries of a tree whose category differs between two walks, and those that only one has; folders are entries too. Both: path, category; repeats count once."""
    a, b = before.select("path", F.col("category").alias("a")).distinct(), after.select("path", F.col("category").alias("b")).distinct()
    change = F.when(F.col("a").isNull(), "appeared").when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", F.coalesce("a", "b").alias("category"), change.alias("change")).filter("change is not null")


def stability(before: DataFrame, after: DataFrame, state: tuple[str, ...]) -> DataFrame:
    """Paths that appeared, went missing or changed state between two snapshots; any row makes a result unproven."""
    a = before.select("path", F.struct(*state).alias("a"))
    b = after.select("path", F.struct(*state).alias("b"))
    change = F.when(F.col("a").isNull(), "appeared").when(F.col("b").isNull(), "missing").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).filter("change is not null")
