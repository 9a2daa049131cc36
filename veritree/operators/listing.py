"""What a command looks at: files of a walk, media folders, paths of identities, and the columns a report may show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritree.operators.classification import PICTURE_EXTENSIONS
from veritree.operators.coverage import IDENTITY
from veritree.operators.planning import parent

#: Categories of a walk after which a command that moves files must not go on.
UNSAFE = ("unreadable", "changed", "non_regular")


def walk_problems(entries: DataFrame) -> DataFrame:
    """Entries that stop a command which must see everything; any row means that it must not go on."""
    return entries.filter(F.col("category").isin(*UNSAFE)).select("path", "category")


def collection_files(entries: DataFrame, review: str = "dups") -> DataFrame:
    """The regular files of a walk outside the review folder; what is ignored, linked or the tool's own is left out by its category. Shown in case-blind order of the path."""
    return entries.filter((F.col("category") == "file") & ~F.startswith(F.col("path"), F.lit(review + "/")))


def pictures(files: DataFrame, folder: str = "pics", extensions: tuple[str, ...] = PICTURE_EXTENSIONS) -> DataFrame:
    """Files that stand in the pictures folder itself, by extension."""
    return files.filter((parent(F.col("path")) == folder) & F.col("ext").isin(*extensions))


def videos(files: DataFrame, folder: str = "vids") -> DataFrame:
    """Files that stand in the videos folder itself and are videos by content."""
    return files.filter((parent(F.col("path")) == folder) & (F.col("kind") == "video"))


def needs_decoding(files: DataFrame) -> bool:
    """Whether any video has content, so that native tools are needed at all; stops at the first."""
    return not files.filter((F.col("kind") == "video") & (F.col("size") > 0)).limit(1).isEmpty()


def identities_of(paths: DataFrame, files: DataFrame) -> DataFrame:
    """The distinct identities that stand at some paths; paths without a file are dropped."""
    return files.join(paths.select("path").distinct(), "path", "left_semi").select(*IDENTITY).distinct()


def outside_review(namespace: DataFrame, review: str = "dups") -> DataFrame:
    """Paths of a namespace outside the review folder, in case-blind order when shown."""
    return namespace.filter(~F.startswith(F.col("path"), F.lit(review + "/")))


def chosen(rows: DataFrame, columns: tuple[str, ...], codes: tuple[str, ...] | None = None) -> DataFrame:
    """Only the named columns of a report's rows, and only finding codes that may be shown: another code raises when rows are read."""
    out = rows.select(*columns)
    if codes is None:
        return out
    safe = F.when(F.col("code").isin(*codes), F.col("code")).otherwise(F.raise_error(F.lit("a finding code that may not be shown")))
    return out.withColumn("code", safe)


def expected_or_any(expected: Column, observed: Column) -> Column:
    """No expectation, or met."""
    return expected.isNull() | expected.eqNullSafe(observed)


def all_of(*sets: tuple[str, ...]) -> tuple[str, ...]:
    """The union of small sets of settings, in order of appearance."""
    return tuple(dict.fromkeys(x for s in sets for x in s))


def ancestry(path: str) -> list[str]:
    """device:inode of a folder and of each folder above it, leaf to root; a path with a link in it, or not in normal form, is refused."""
    import os

    if not os.path.isabs(path) or os.path.normpath(path) != path or os.path.realpath(path) != path:
        raise ValueError(f"{path} is no absolute path without links")
    out = []
    while True:
        s = os.stat(path)
        out.append(f"{s.st_dev}:{s.st_ino}")
        if path == os.sep:
            return out
        path = os.path.dirname(path)
