"""The preservation report: whether a destination still holds everything of a source, by bytes, by displayed pixels, by playback.

Files of both sides and the evidence on their contents meet in one aggregate by SHA-256, which combines map-side, so a content with many copies is one row
before it is exchanged. Contents that the destination lacks are looked up by their pixel digest, or their playback digest and candidate key, in
one join for both layers. The report is one aggregate over contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcomes(source: DataFrame, destination: DataFrame, evidence: DataFrame, exact_images: tuple[str, ...], images: tuple[str, ...]) -> DataFrame:
    """One row a content: copies on each side, what it is, the layer that accounts for it (bytes, image, video or null) and what is not known of it.

    source, destination: size, sha256, kind, ext; evidence: sha256, pixel_sha256, candidate and playback_sha256, null where a decoder failed. Pictures are those with an
    exact extension; other extensions of `images` are unsupported. A digest under two sizes is a conflict.
    """
    none = F.lit(None).cast("string")
    sides = [df.select("sha256", "size", F.lit(name).alias("side"), F.lower("ext").isin(*exact_images).alias("picture"), (F.col("kind") == "video").alias("video"), (F.lower("ext").isin(*images) & ~F.lower("ext").isin(*exact_images)).alias("odd"), none.alias("pixels"), none.alias("plays")) for name, df in (("s", source), ("d", destination))]
    plays = F.when(F.col("candidate").isNotNull() & F.col("playback_sha256").isNotNull(), F.concat_ws(":", "candidate", "playback_sha256"))
    known = evidence.select("sha256", F.lit(None).cast("long").alias("size"), F.lit("e").alias("side"), *[F.lit(False).alias(c) for c in ("picture", "video", "odd")], F.col("pixel_sha256").alias("pixels"), plays.alias("plays"))
    on = lambda side, c: F.coalesce(F.max((F.col("side") == side) & F.col(c)), F.lit(False))
    each = sides[0].unionByName(sides[1]).unionByName(known).groupBy("sha256").agg(
        F.max("size").alias("size"), (F.max("size") != F.min("size")).alias("conflict"), F.count(F.when(F.col("side") == "s", 1)).alias("source_n"), F.count(F.when(F.col("side") == "d", 1)).alias("destination_n"),
        on("s", "picture").alias("picture"), on("s", "video").alias("video"), on("s", "odd").alias("odd"), on("d", "picture").alias("there_picture"), on("d", "video").alias("there_video"), F.max("pixels").alias("pixels"), F.max("plays").alias("plays"),
    ).filter("source_n + destination_n > 0")
    gone = (F.col("source_n") > 0) & (F.col("destination_n") == 0)
    keys = lambda picture, video: F.filter(F.array(F.when(picture & F.col("pixels").isNotNull(), F.concat(F.lit("i"), "pixels")), F.when(video & F.col("plays").isNotNull(), F.concat(F.lit("v"), "plays"))), lambda k: k.isNotNull())
    own = F.when(gone, keys(F.col("picture"), F.col("video")))
    # contents without a key get one of their own, that nothing has: nulls would all meet in one task
    sought = each.withColumn("key", F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(F.concat(F.lit("0"), "sha256")))))
    held = each.filter("destination_n > 0").select(F.explode(keys(F.col("there_picture"), F.col("there_video"))).alias("key")).distinct().withColumn("hit", F.lit(True))
    met = sought.join(held, "key", "left")
    columns = [c for c in each.columns if c != "sha256"]
    found = lambda letter: F.coalesce(F.max(F.col("hit") & F.startswith("key", F.lit(letter))), F.lit(False))
    # keys of one content are few, and its other columns are alike in their rows
    one = met.groupBy("sha256").agg(*[F.first(c).alias(c) for c in columns], found("i").alias("by_image"), found("v").alias("by_video"))
    layer = F.when((F.col("source_n") > 0) & (F.col("destination_n") > 0), "bytes").when(F.col("by_image"), "image").when(F.col("by_video"), "video")
    image_issue, video_issue = gone & F.col("picture") & F.col("pixels").isNull(), gone & F.col("video") & F.col("plays").isNull()
    return one.select("sha256", "size", "conflict", "source_n", "destination_n", "picture", "video", "there_picture", "there_video", "by_image", "by_video", layer.alias("layer"), image_issue.alias("image_issue"), video_issue.alias("video_issue"),
        (gone & layer.isNull() & (image_issue | video_issue | F.col("odd"))).alias("unsupported"),
        (F.col("there_picture") & F.col("pixels").isNull()).alias("there_image_issue"), (F.col("there_video") & F.col("plays").isNull()).alias("there_video_issue"))


def report(contents: DataFrame, source_complete: bool = True, destination_complete: bool = True, changes: int = 0, simulated: bool = False) -> DataFrame:
    """One row of nested sections: coverage, multiplicity, image_content, video_content, preservation. contents: outcomes; changes: paths of either side that were not stable."""
    c = F.col
    here, there = c("source_n") > 0, c("destination_n") > 0
    gone = here & ~there
    n = lambda cond: F.count(F.when(cond, 1))
    total = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long")
    fewer, more = F.greatest(c("source_n") - c("destination_n"), F.lit(0)), F.greatest(c("destination_n") - c("source_n"), F.lit(0))
    sums = {
        "source_unique": n(here), "represented_unique": n(here & there), "missing_unique": n(gone), "source_bytes": total(here, c("size")), "represented_bytes": total(here & there, c("size")), "missing_bytes": total(gone, c("size")),
        "source_files": total(here, c("source_n")), "represented_files": total(here & there, c("source_n")), "missing_files": total(gone, c("source_n")), "destination_only": n(~here), "conflicts": n(c("conflict")),
        "source_copies": total(here, c("source_n") - 1), "source_copy_bytes": total(here, c("size") * (c("source_n") - 1)), "destination_copies": total(there, c("destination_n") - 1), "destination_copy_bytes": total(there, c("size") * (c("destination_n") - 1)),
        "reduced_copies": total(here & there, fewer), "reduced_bytes": total(here & there, fewer * c("size")), "added_copies": total(here & there, more), "added_bytes": total(here & there, more * c("size")),
        "by_bytes": n(c("layer") == "bytes"), "by_image": n(c("layer") == "image"), "by_video": n(c("layer") == "video"), "accounted": n(c("layer").isNotNull()), "accounted_files": total(c("layer").isNotNull(), c("source_n")),
        "unaccounted": n(here & c("layer").isNull()), "unaccounted_files": total(here & c("layer").isNull(), c("source_n")), "unsupported": n(c("unsupported")), "unsupported_files": total(c("unsupported"), c("source_n")),
    }
    for k, kind in (("image", "picture"), ("video", "video")):
        eligible, hit, issue = gone & c(kind), c(f"by_{k}"), c(f"{k}_issue")
        sums |= {
            f"{k}_eligible": n(eligible), f"{k}_eligible_files": total(eligible, c("source_n")), f"{k}_represented": n(hit), f"{k}_represented_files": total(hit, c("source_n")), f"{k}_missing": n(eligible & ~hit & ~issue),
            f"{k}_missing_files": total(eligible & ~hit & ~issue, c("source_n")), f"{k}_uninspectable": n(issue), f"{k}_candidates": n(c(f"there_{kind}")), f"{k}_there_uninspectable": n(c(f"there_{k}_issue")),
        }
    one = contents.agg(*[v.alias(k) for k, v in sums.items()])
    percent = lambda part, whole: F.round(F.when(c(whole) == 0, 100.0).otherwise(100.0 * c(part) / c(whole)), 6)

    def layer_verdict(k: str) -> Column:
        return F.when(c(f"{k}_eligible") == 0, "not-needed").when(c(f"{k}_uninspectable") > 0, "unproven").when((c(f"{k}_missing") > 0) & (c(f"{k}_there_uninspectable") > 0), "unproven").when(c(f"{k}_missing") > 0, "incomplete").otherwise("complete")

    incomplete = F.lit(not (source_complete and destination_complete) or changes > 0) | (c("conflicts") > 0)
    by_bytes = F.when(F.lit(not source_complete), "unproven").when((c("missing_unique") > 0) & F.lit(not destination_complete), "unproven").when(c("missing_unique") > 0, "incomplete").otherwise("complete")
    one = one.withColumns({"image_verdict": layer_verdict("image"), "video_verdict": layer_verdict("video"), "byte_verdict": by_bytes})
    unproven = (c("image_verdict") == "unproven") | (c("video_verdict") == "unproven") | (c("byte_verdict") == "unproven")
    reason = F.when(incomplete, "filesystem-evidence-incomplete").when(c("unsupported") > 0, "unsupported-source-media").when((c("unaccounted") > 0) & unproven, "media-equivalence-evidence-incomplete").when(c("unaccounted") > 0, "source-content-unaccounted")
    one = one.withColumn("reason", reason)
    verdict = F.when(c("reason").isNull(), "complete").when(c("reason") == "source-content-unaccounted", "incomplete").otherwise("unproven")
    done = "eligible-for-human-quarantine-review" if simulated else "eligible-for-human-signoff"
    part = lambda *names: [c(x) for x in names]
    content = lambda k: F.struct(c(f"{k}_verdict").alias("verdict"), *[c(f"{k}_{x}").alias(x) for x in ("eligible", "eligible_files", "represented", "represented_files", "missing", "missing_files", "uninspectable", "candidates", "there_uninspectable")])
    return one.select(
        F.struct(c("byte_verdict").alias("verdict"), *part("source_unique", "represented_unique", "missing_unique"), percent("represented_unique", "source_unique").alias("unique_percent"), *part("source_bytes", "represented_bytes", "missing_bytes"), percent("represented_bytes", "source_bytes").alias("bytes_percent"), *part("source_files", "represented_files", "missing_files", "destination_only", "conflicts")).alias("coverage"),
        F.struct(*part("source_copies", "source_copy_bytes", "destination_copies", "destination_copy_bytes", "reduced_copies", "reduced_bytes", "added_copies", "added_bytes")).alias("multiplicity"),
        content("image").alias("image_content"),
        content("video").alias("video_content"),
        F.struct(verdict.alias("verdict"), c("reason"), *part("accounted", "accounted_files"), percent("accounted", "source_unique").alias("accounted_percent"), *part("by_bytes", "by_image", "by_video", "unaccounted", "unaccounted_files", "unsupported", "unsupported_files"), F.lit(changes).cast("long").alias("changes"), F.when(verdict == "complete", done).otherwise("retain-source-and-resolve-findings").alias("disposition")).alias("preservation"),
    )


def flat(nested: DataFrame) -> DataFrame:
    """The report as rows: section, field, value (numbers with a fraction to six places)."""
    rows = []
    for section in nested.schema.fields:
        for f in section.dataType.fields:
            value = F.col(f"{section.name}.{f.name}")
            rows.append(F.struct(F.lit(section.name).alias("section"), F.lit(f.name).alias("field"), (F.format_string("%.6f", value) if f.dataType.typeName() == "double" else value.cast("string")).alias("value")))
    return nested.select(F.inline(F.array(*rows)))


def unaccounted_files(source: DataFrame, contents: DataFrame) -> DataFrame:
    """Every source file whose content no layer accounts for, and whether that is for want of support. path, size, sha256, unsupported."""
    return source.select("path", "size", "sha256").join(contents.filter("source_n > 0 and layer is null").select("sha256", "unsupported"), "sha256").select("path", "size", "sha256", "unsupported")
