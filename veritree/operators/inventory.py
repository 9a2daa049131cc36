"""Inventory reports: counts and bytes by kind, extension and type; same-size candidates; exact duplicates.

A file table has path, size, sha256 (may be null), kind, mime_type, in_review, modified_ns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("picture", "video", "audio", "document", "other")
PICTURES, VIDEOS, AUDIO, TEXTS = (".jpg", ".png"), (".mp4", ".mkv"), (".mp3",), (".txt",)


def extension(path: Column) -> Column:
    """The lower-case extension of a path's last part, with the dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def kind_of(ext: Column) -> Column:
    return F.when(ext.isin(*PICTURES), "picture").when(ext.isin(*VIDEOS), "video").when(ext.isin(*AUDIO), "audio").when(ext.isin(*TEXTS), "document").otherwise("other")


def mime_of(ext: Column) -> Column:
    known = {".jpg": "image/jpeg", ".png": "image/png", ".mp4": "video/mp4", ".mkv": "video/x-matroska", ".mp3": "audio/mpeg", ".txt": "text/plain"}
    out = F.lit("unknown")
    for k, v in known.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def collection(docs: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """Documents as a file table: a synthetic path, the text's bytes as content. The text itself is read only where size or digest are."""
    exts = F.array(*[F.lit(x) for x in (".jpg", ".png", ".mp4", ".mkv", ".txt", ".mp3", "")])
    ext = F.element_at(exts, (F.col("doc_id") % 7 + 1).cast("int"))
    t = F.col("text")
    return docs.select(
        "doc_id",
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.octet_length(t).cast("long").alias("size"),
        F.sha2(t, 256).alias("sha256"),
        kind_of(ext).alias("kind"),
        ext.alias("ext"),
        mime_of(ext).alias("mime_type"),
        (F.col("doc_id") * 1_000_000_000).alias("modified_ns"),
        (F.col("doc_id") % 11 == 0).alias("in_review"),
        "lang",
        "source",
        *[c.alias(n) for n, c in (more or {}).items()],
    )


def by_attribute(files: DataFrame, attribute: str) -> DataFrame:
    """Files and bytes per value of a column; empty values are `(none)`."""
    return files.groupBy(F.coalesce(F.nullif(F.col(attribute), F.lit("")), F.lit("(none)")).alias(attribute)).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def by_kind(files: DataFrame) -> DataFrame:
    """Files and bytes for each kind, zeros included."""
    spark = files.sparkSession
    found = files.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    zero = F.lit(0).cast("long")
    return spark.createDataFrame([(k,) for k in KINDS], "kind string").join(found, "kind", "left").select("kind", F.coalesce("files", zero).alias("files"), F.coalesce("bytes", zero).alias("bytes"))


def review_storage(files: DataFrame) -> DataFrame:
    return files.groupBy("in_review", "kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def layout_readiness(files: DataFrame, home: dict[str, str]) -> DataFrame:
    """Media already under the folder of their kind, and moves that would put the others there; home: kind -> folder."""
    folder = F.lit(None).cast("string")
    for kind, name in home.items():
        folder = F.when(F.col("kind") == kind, name).otherwise(folder)
    at_home = F.startswith(F.col("path"), F.concat(folder, F.lit("/")))
    media = files.filter(F.col("kind").isin(*home)).withColumn("at_home", at_home)
    return media.groupBy("kind").agg(F.sum(F.col("at_home").cast("long")).alias("organised"), F.sum((~F.col("at_home")).cast("long")).alias("moves"), F.coalesce(F.sum(F.when(~F.col("at_home"), F.col("size"))), F.lit(0)).alias("move_bytes"))


def comparable(files: DataFrame) -> DataFrame:
    """The files that duplicates are looked for in: pictures and videos outside the review folder."""
    return files.filter(F.col("kind").isin("picture", "video") & ~F.col("in_review"))


def same_size_candidates(files: DataFrame) -> DataFrame:
    """Groups of one kind and size with several comparable files, and the bytes that duplicates among them could take at most."""
    return comparable(files).groupBy("kind", "size").agg(F.count(F.lit(1)).alias("files")).filter("files > 1").withColumn("upper_bound", F.col("size") * (F.col("files") - 1))


def exact_duplicates(files: DataFrame) -> DataFrame:
    """Groups of comparable files of equal content; digests matter only for files of a repeated size, so others never reach the second grouping."""
    some = comparable(files)
    sizes = some.groupBy("kind", "size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("kind", "size")
    same = some.join(sizes, ["kind", "size"], "left_semi")
    return same.groupBy("kind", "size", "sha256").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path")).filter("files > 1").withColumn("duplicate_bytes", F.col("size") * (F.col("files") - 1))


def duplicate_statistics(files: DataFrame) -> DataFrame:
    """One row: groups of equal size, their files, and the upper bound of duplicate bytes."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return same_size_candidates(files).agg(F.count(F.lit(1)).alias("groups"), total("files").alias("files"), total("upper_bound").alias("upper_bound"))


def storage_summary(files: DataFrame) -> DataFrame:
    """Retained and duplicate files and bytes, with shares of the scan in percent (0 of nothing)."""
    groups = files.groupBy("size", "sha256").agg(F.count(F.lit(1)).alias("n"))
    one = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"),
        F.count(F.lit(1)).alias("retained"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.col("size") * (F.col("n") - 1)), F.lit(0)).alias("duplicate_bytes"),
        F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("scanned_bytes"),
    )
    return one.withColumn("scan_percent", F.round(F.when(F.col("scanned_bytes") == 0, 0.0).otherwise(100.0 * F.col("duplicate_bytes") / F.col("scanned_bytes")), 6))


def top_extensions(files: DataFrame, limit: int = 12) -> DataFrame:
    """The most frequent extensions, ties in case-blind order of the name."""
    return by_attribute(files, "ext").orderBy(F.desc("files"), F.lower("ext"), "ext").limit(limit)
