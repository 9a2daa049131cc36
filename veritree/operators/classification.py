"""Classification of files by content type and name, and predicates on paths."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERIC = ("application/octet-stream", "text/plain", "unknown")
VIDEO_APPLICATIONS = ("application/ogg", "application/vnd.rn-realmedia")
PICTURE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".tiff", ".heic", ".webp")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".mkv", ".avi", ".webm", ".m4v")


def extension_kind(ext: Column) -> Column:
    """picture, video or null by extension."""
    return F.when(ext.isin(*PICTURE_EXTENSIONS), "picture").when(ext.isin(*VIDEO_EXTENSIONS), "video")


def classify(mime: Column, from_content: Column, ext: Column) -> Column:
    """The first rule that fits: a type guessed from the name counts only by extension; content types decide; generic ones fall back to the extension."""
    by_ext = extension_kind(ext)
    return (
        F.when(~from_content & by_ext.isNotNull(), by_ext)
        .when(F.startswith(mime, F.lit("image/")), "picture")
        .when(F.startswith(mime, F.lit("video/")) | mime.isin(*VIDEO_APPLICATIONS), "video")
        .when(mime.isin(*GENERIC), F.coalesce(by_ext, F.lit("other")))
        .otherwise("other")
    )


def scan_kind(kind: Column, mime: Column) -> Column:
    """The inventory's five kinds: audio and unknown are told apart from other."""
    return F.when(F.startswith(mime, F.lit("audio/")), "audio").when((kind == "other") & (mime == "unknown"), "unknown").otherwise(kind)


def mismatched(kind: Column, ext: Column) -> Column:
    """A media extension on content of another kind."""
    by_ext = extension_kind(ext)
    return by_ext.isNotNull() & (by_ext != kind)


def desired_folder(kind: Column) -> Column:
    return F.when(kind == "picture", "pics").when(kind == "video", "vids").otherwise("")


def in_review(path: Column, folder: str = "dups") -> Column:
    """Below the review folder; a file of that name is not."""
    return (F.element_at(F.split(path, "/"), 1) == folder) & (F.size(F.split(path, "/")) > 1)


def glob_regex(pattern: str) -> str:
    """A shell pattern as a Java regular expression for whole strings, case-blind."""
    return "(?i)^" + fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")


def ignored(path: Column, files: tuple[str, ...], folders: tuple[str, ...]) -> Column:
    """A file pattern fits its name or path, or a folder pattern fits the name or path of any folder above it."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    out = F.lit(False)
    for p in files:
        out = out | name.rlike(glob_regex(p)) | path.rlike(glob_regex(p))
    above = F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.element_at(parts, k).alias("name"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path")))
    if folders:
        rules = [glob_regex(p) for p in folders]

        def fits(a: Column) -> Column:
            hit = F.lit(False)
            for r in rules:
                hit = hit | a["name"].rlike(r) | a["path"].rlike(r)
            return hit

        out = out | F.exists(above, fits)
    return out


def relative_path_ok(path: Column) -> Column:
    """Normal relative form: not empty or absolute, no empty, `.` or `..` part, no NUL."""
    return path.isNotNull() & (path != "") & ~F.contains(path, F.lit("\x00")) & ~F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))


def canonical_number(name: Column, collection: str, kind: str) -> Column:
    """The sequence number in a canonical name of a kind, or null."""
    got = F.regexp_extract(name, rf"(?i)^{collection}__{kind}_([0-9]{{4,}})__", 1)
    return F.when(got != "", got.cast("long"))


def canonical_name(collection: str, kind: Column, sequence: Column, stamp: Column, descriptor: Column, suffix: Column) -> Column:
    word = F.when(kind == "picture", "image").otherwise("video")
    tail = F.when(descriptor.isNotNull(), F.concat(F.lit("__"), descriptor)).otherwise("")
    return F.concat(F.lit(collection + "__"), word, F.lit("_"), F.when(sequence > 9999, sequence.cast("string")).otherwise(F.lpad(sequence.cast("string"), 4, "0")), F.lit("__"), F.coalesce(stamp, F.lit("undated")), tail, suffix)
