"""Health of media files: candidates by disposition, findings per file from probe evidence, reports, and reuse of earlier results.

A discovered entry has path, category (file, symbolic_link, unreadable, changed, ignored), size, kind (by
content), ext_kind (by extension; null if unknown). Probe evidence is a provider's row per path; all rules are columns, so a
table of findings is one pass over candidates joined with their evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The finding codes, with severity and description.
CODES: dict[str, tuple[str, str]] = {
    "additional_streams": ("info", "subtitle, data or attachment streams"),
    "changed_during_discovery": ("warning", "changed while it was being found"),
    "changed_during_validation": ("warning", "changed while it was being checked"),
    "classification_fallback": ("warning", "type guessed from the name"),
    "container_extension_mismatch": ("warning", "container of another family than the extension's"),
    "empty_file": ("error", "no content"),
    "extension_content_mismatch": ("warning", "extension and content disagree"),
    "invalid_image": ("error", "picture cannot be decoded"),
    "invalid_video": ("error", "video cannot be probed or decoded"),
    "invalid_video_dimensions": ("error", "no positive dimensions"),
    "missing_or_invalid_duration": ("warning", "no positive duration"),
    "missing_video_codec": ("warning", "no codec name"),
    "missing_video_stream": ("error", "no video stream"),
    "multiple_audio_streams": ("warning", "several audio streams"),
    "multiple_video_streams": ("warning", "several video streams"),
    "symbolic_link_skipped": ("warning", "symbolic link"),
    "unreadable_entry": ("error", "cannot be read"),
    "unrecognized_media_extension": ("warning", "media without a media extension"),
    "unsupported_image_format": ("warning", "no decoder for this picture format"),
}
SEVERITY = {code: severity for code, (severity, _) in CODES.items()}
#: Scores of a probe that count as sure.
SURE = (50, 100)


def disposition(category: Column, kind: Column, ext_kind: Column) -> Column:
    """candidate, ignored, symlink, unreadable, changed, mismatched (a media extension on other content) or other."""
    media = kind.isin("picture", "video")
    return (
        F.when(category == "ignored", "ignored")
        .when(category == "symbolic_link", "symlink")
        .when(category == "unreadable", "unreadable")
        .when(category == "changed", "changed")
        .when(media, "candidate")
        .when(ext_kind.isNotNull(), "mismatched")
        .otherwise("other")
    )


def _codes(*found: tuple[str, Column]) -> Column:
    """The codes whose condition holds (a null condition does not)."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in found]), lambda x: x.isNotNull())


def _streams(kind: str) -> Column:
    return F.filter(F.coalesce(F.col("streams"), F.array().cast("array<struct<codec_type: string, codec_name: string, width: int, height: int>>")), lambda s: s["codec_type"] == kind)


def partition_streams(probes: DataFrame) -> DataFrame:
    """Probe rows with their streams by type: videos, audios and the number of others."""
    return probes.withColumns({"videos": _streams("video"), "audios": _streams("audio")}).withColumn("others", F.coalesce(F.size("streams"), F.lit(0)) - F.size("videos") - F.size("audios"))


def container_mismatch(family: Column, score: Column, accepted: Column) -> Column:
    """A sure probe names a family that the extension does not take; unknown families accuse nobody."""
    return score.between(*SURE) & family.isNotNull() & accepted.isNotNull() & ~F.array_contains(accepted, family)


def file_findings(candidates: DataFrame, probes: DataFrame) -> DataFrame:
    """path, kind, severity and code of every finding.

    candidates: path, kind, ext_kind, size, changed (boolean: the state moved during the check, which replaces all other findings).
    probes: path, ok (decoded), decoder (the picture's format is decodable), format_matches, streams, duration, family, score, accepted (families of the extension).
    """
    rows = partition_streams(candidates.join(probes, "path", "left"))
    empty, picture, video = F.col("size") == 0, F.col("kind") == "picture", F.col("kind") == "video"
    undecodable = F.coalesce(picture & (F.col("ext_kind") == "picture") & ~F.col("decoder"), F.lit(False))
    probed = video & ~empty & F.coalesce(F.col("ok"), F.lit(False))
    positive = lambda s: F.coalesce((s["width"] > 0) & (s["height"] > 0), F.lit(False))
    found = _codes(
        ("empty_file", empty),
        ("unrecognized_media_extension", F.col("ext_kind").isNull()),
        ("extension_content_mismatch", (F.col("ext_kind") != F.col("kind")) | (picture & ~empty & ~undecodable & F.col("ok") & ~F.col("format_matches"))),
        ("unsupported_image_format", ~empty & undecodable),
        ("invalid_image", picture & ~empty & ~undecodable & ~F.coalesce(F.col("ok"), F.lit(False))),
        ("invalid_video", video & ~empty & ~F.coalesce(F.col("ok"), F.lit(False))),
        ("missing_video_stream", probed & (F.size("videos") == 0)),
        ("missing_video_codec", probed & F.exists("videos", lambda s: F.coalesce(s["codec_name"], F.lit("")) == "")),
        ("invalid_video_dimensions", probed & F.exists("videos", lambda s: ~positive(s))),
        ("multiple_video_streams", probed & (F.size("videos") > 1)),
        ("multiple_audio_streams", probed & (F.size("audios") > 1)),
        ("additional_streams", probed & (F.col("others") > 0)),
        ("missing_or_invalid_duration", probed & ~F.coalesce((F.col("duration") > 0) & (F.col("duration") < float("inf")), F.lit(False))),
        ("container_extension_mismatch", probed & container_mismatch(F.col("family"), F.col("score"), F.col("accepted"))),
    )
    codes = F.when(F.col("changed"), F.array(F.lit("changed_during_validation"))).otherwise(found)
    out = rows.select("path", "kind", F.explode(codes).alias("code"))
    return out.select("path", "kind", severity_of(F.col("code")).alias("severity"), "code")


def severity_of(code: Column) -> Column:
    by = {s: [c for c, x in SEVERITY.items() if x == s] for s in ("error", "warning")}
    return F.when(code.isin(*by["error"]), "error").when(code.isin(*by["warning"]), "warning").otherwise("info")


def entry_findings(entries: DataFrame) -> DataFrame:
    """Findings about entries that are no candidates. entries: path, disposition."""
    code = F.when(F.col("disposition") == "symlink", "symbolic_link_skipped").when(F.col("disposition") == "unreadable", "unreadable_entry").when(F.col("disposition") == "changed", "changed_during_discovery").when(F.col("disposition") == "mismatched", "extension_content_mismatch")
    rows = entries.select("path", F.lit("entry").alias("kind"), code.alias("code")).filter("code is not null")
    return rows.select("path", "kind", severity_of(F.col("code")).alias("severity"), "code")


def health(candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files with errors (unreadable entries too), with warnings only (changed, linked and mismatched entries too), healthy candidates, and the exit status."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    worst = findings.groupBy("path").agg(F.max(rank).alias("r"))
    n = lambda c: F.count(F.when(c, 1))
    known = candidates.select("path", F.lit(True).alias("candidate"))
    one = worst.join(known, "path", "full").agg(
        n(F.col("r") == 2).alias("files_with_errors"),
        n(F.col("r") == 1).alias("files_with_warnings"),
        n(F.col("candidate") & (F.coalesce("r", F.lit(0)) == 0)).alias("healthy_files"),
        n(F.col("candidate")).alias("media_files"),
    )
    return one.withColumn("status", F.when(F.col("files_with_errors") > 0, 1).otherwise(0))


def findings_table(findings: DataFrame, fallback: bool = False) -> DataFrame:
    """Findings by severity and code, with the number of findings and of files; with `fallback`, one more for the whole run, of no file: contents could not be classified, so names decided."""
    out = findings.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("path").alias("files"))
    if fallback:
        own = findings.sparkSession.range(1).select(F.lit("classification_fallback").alias("code"), F.lit(1).cast("long").alias("count"), F.lit(0).cast("long").alias("files"))
        out = out.unionByName(own.select(severity_of(F.col("code")).alias("severity"), "code", "count", "files"))
    return out


def results(candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """What the store keeps of each checked file: its worst severity as outcome, and its codes in order."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    per = findings.groupBy("path").agg(F.max(rank).alias("r"), F.array_sort(F.collect_set("code")).alias("codes"))
    rows = candidates.join(per, "path", "left")
    return rows.select("path", "sha256", "kind", F.when(F.col("r") == 2, "errors").when(F.col("r") == 1, "warnings").otherwise("healthy").alias("outcome"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def result_problems(stored: DataFrame) -> DataFrame:
    """Stored results that contradict themselves, with the first rule broken. stored: sha256, kind, outcome, codes."""
    known = F.array(*[F.lit(c) for c in CODES])
    worst = lambda s: F.exists("codes", lambda c: severity_of(c) == s)
    problem = (
        F.when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "sha256")
        .when(~F.col("kind").isin("picture", "video"), "kind")
        .when(F.size(F.array_except("codes", known)) > 0, "code")
        .when(F.col("codes") != F.array_sort(F.array_distinct("codes")), "order")
        .when(F.col("outcome") != F.when(worst("error"), "errors").when(worst("warning"), "warnings").otherwise("healthy"), "outcome")
    )
    return stored.select("sha256", problem.alias("problem")).filter("problem is not null")


def split_reused(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Every candidate with `reused`: a stored result of its hash and kind, whose file has not changed since; the others must be checked afresh."""
    usable = stored.select("sha256", "kind", "outcome").groupBy("sha256", "kind").agg(F.max("outcome").alias("outcome"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return candidates.join(usable, ["sha256", "kind"], "left").withColumn("reused", F.col("outcome").isNotNull() & ~F.col("changed"))


def merged_results(candidates: DataFrame, stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Reused results and fresh ones of the rest as one table, in path order when shown. fresh: path, outcome."""
    split = split_reused(candidates, stored)
    old = split.filter("reused").select("path", "outcome", "reused")
    new = split.filter("not reused").select("path", "reused").join(fresh, "path", "left").select("path", "outcome", "reused")
    return old.unionByName(new)
