"""Reports a user asks for by name, each as a dictionary of plain values.

Every report runs a fixed number of aggregates and brings only their rows to the driver: a handful of
counters, one row per kind, extension, type or finding code. Paths are listed only on request, as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritree.operators import classification, coverage, duplicates, evidence, inventory, journal, media, merkle, planning, population, preservation, validation
from veritree.plans import digest
from veritree.sinks import store
from veritree.sources import tree


def scan(spark: SparkSession, folder: str, checksums: bool = False) -> DataFrame:
    """A folder as a file table: path, category, size, sha256, kind, ext, in_review, modified_ns."""
    tree.register(spark)
    entries = spark.read.format("tree").option("checksums", str(checksums).lower()).load(folder)
    ext = inventory.extension(F.col("path"))
    mime = inventory.mime_of(ext)
    kind = classification.classify(mime, F.lit(False), ext)
    return entries.withColumns({"ext": ext, "mime_type": mime, "kind": classification.scan_kind(kind, mime), "in_review": classification.in_review(F.col("path"))})


def _pairs(df: DataFrame, key: str) -> dict:
    return {r[key]: {"files": r["files"], "bytes": r["bytes"]} for r in df.collect()}


def inventory_report(files: DataFrame, checksums: bool = False) -> dict:
    """Counts and bytes by kind, extension and type; what stands in review; same-size and, with checksums, exact duplicates."""
    files = files.filter("category = 'file'") if "category" in files.columns else files
    same = inventory.same_size_candidates(files).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("upper_bound"), F.lit(0)).alias("bytes")).first()
    out = {
        "schema_version": 1,
        "kinds": _pairs(inventory.by_attribute(files, "kind"), "kind"),
        "extensions": _pairs(inventory.by_attribute(files, "ext"), "ext"),
        "mime_types": _pairs(inventory.by_attribute(files, "mime_type"), "mime_type"),
        "review": _pairs(inventory.by_attribute(files.filter("in_review"), "kind"), "kind"),
        "same_size": same.asDict(),
    }
    if checksums:
        exact = inventory.exact_duplicates(files).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("duplicate_bytes"), F.lit(0)).alias("bytes")).first()
        out["exact_duplicates"] = exact.asDict()
    return out


#: Categories that make an enumeration incomplete.
INCOMPLETE = ("symbolic_link", "non_regular", "unreadable", "changed")


def preservation_report(source: DataFrame, destination: DataFrame, layers: list[tuple[str, tuple[str, ...]]] | None = None, without_review: bool = False) -> dict:
    """Whether the destination represents everything of the source: byte counts, outcome per layer, verdict.

    Entries that could not be enumerated make their side incomplete and the verdict unproven, also inside a review folder that is left out.
    """
    issues = {}
    for name, side in (("source", source), ("destination", destination)):
        issues[name] = {r["category"]: r["n"] for r in side.filter(F.col("category").isin(*INCOMPLETE)).groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()} if "category" in side.columns else {}
    s, d = (x.filter("category = 'file'") if "category" in x.columns else x for x in (source, destination))
    if without_review:
        d = d.filter(~classification.in_review(F.col("path")))
    counts = coverage.byte_coverage(s, d, not issues["source"], not issues["destination"]).first().asDict()
    out = {"schema_version": 5, "bytes": counts, "issues": issues, "verdict": counts["verdict"]}
    if layers:
        layered = coverage.verdict(coverage.layered(s, d, layers), issues=sum(map(len, issues.values()))).first().asDict()
        out |= {"layers": layered, "verdict": layered["verdict"]}
    return out


def media_preservation_report(source: DataFrame, destination: DataFrame, evidence: DataFrame, exact_images: tuple[str, ...], images: tuple[str, ...], stability: DataFrame | None = None, without_review: bool = False) -> tuple[dict, DataFrame]:
    """The report with pictures by pixels and videos by playback, and the source files that nothing accounts for. stability: path, change of either side since its inventory; evidence as in `preservation.outcomes`."""
    s, d = (x.filter("category = 'file'") if "category" in x.columns else x for x in (source, destination))
    whole = [x.filter(F.col("category").isin(*INCOMPLETE)).isEmpty() if "category" in x.columns else True for x in (source, destination)]
    if without_review:
        d = d.filter(~classification.in_review(F.col("path")))
    contents = preservation.outcomes(s, d, evidence, exact_images, images)
    one = preservation.report(contents, *whole, changes=stability.count() if stability is not None else 0, simulated=without_review).first()
    return {"schema_version": 5, "result_kind": "simulated" if without_review else "observed"} | one.asDict(recursive=True), preservation.unaccounted_files(s, contents)


def duplicate_report(files: DataFrame) -> dict:
    """Storage taken by exact duplicates."""
    return inventory.storage_summary(files.filter("category = 'file'") if "category" in files.columns else files).first().asDict()


def duplicate_plan(files: DataFrame, folder: str = "dups") -> DataFrame:
    """The moves that would put all but one of each group of equal files under the review folder."""
    return duplicates.move_plan(files.filter(~classification.in_review(F.col("path"), folder)), folder)


def validation_report(entries: DataFrame, candidates: DataFrame, probes: DataFrame, profile: str = "standard", show_files: bool = False, fallback: bool = False, stored: DataFrame | None = None) -> dict:
    """Health of a collection: inventory by disposition, findings by severity and code, files by health, exit status. entries: path, disposition; others as in `validation`.

    fallback: contents could not be classified; stored: earlier results (sha256, kind, outcome), with which the report counts the files that need no check.
    """
    found = validation.file_findings(candidates, probes).unionByName(validation.entry_findings(entries)).select("path", "kind", "severity", "code")
    rows = validation.findings_table(found, fallback).collect()  # a row for each code at most
    by = {r["disposition"]: r["n"] for r in entries.groupBy("disposition").agg(F.count(F.lit(1)).alias("n")).collect()}
    kinds = {r["kind"]: r for r in candidates.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).collect()}
    one = validation.health(candidates, found).first()
    out = {
        "schema_version": 3,
        "profile": profile,
        "inventory": {
            "media_files": one["media_files"], "media_bytes": sum(r["bytes"] for r in kinds.values()),
            "pictures": kinds["picture"]["files"] if "picture" in kinds else 0, "videos": kinds["video"]["files"] if "video" in kinds else 0,
            "other_files": by.get("other", 0) + by.get("mismatched", 0), "ignored_entry_points": by.get("ignored", 0), "symbolic_links_skipped": by.get("symlink", 0),
            "unreadable_entries": by.get("unreadable", 0), "changed_during_discovery": by.get("changed", 0),
        },
        "health": {k: one[k] for k in ("files_with_errors", "files_with_warnings", "healthy_files")},
        "findings": [{"severity": r["severity"], "code": r["code"], "count": r["count"], "description": validation.CODES[r["code"]][1]} for r in sorted(rows, key=lambda r: (r["severity"], r["code"]))],
        "changed_during_validation": sum(r["count"] for r in rows if r["code"] == "changed_during_validation"),
        "status": one["status"],
    }
    if stored is not None:
        out["reuse"] = validation.split_reused(candidates, stored).agg(F.count(F.when(F.col("reused"), 1)).alias("reused"), F.count(F.when(~F.col("reused"), 1)).alias("checked")).first().asDict()
    return out | ({"finding_files": found} if show_files else {})


def find_image_duplicates(files: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pictures whose displayed pixels others share, ranked; rank 1 is kept. pixels: sha256, pixel_sha256."""
    pictures = files.filter((F.col("kind") == "picture") & ~F.col("in_review"))
    return media.keepers(media.decoded_groups(pictures, pixels, "pixel_sha256"), "pixel_sha256")


def find_video_duplicates(files: DataFrame, probes: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Videos that play alike, ranked; rank 1 is kept. Only files of an equal candidate key are compared."""
    videos = files.filter((F.col("kind") == "video") & ~F.col("in_review"))
    return media.keepers(media.playback_groups(videos, probes, fingerprints), "playback_sha256")


def organize(files: DataFrame, home: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The plan that puts media in the folder of their kind, and its digest."""
    plan = planning.organize_plan(files, home or {"picture": "pics", "video": "vids"})
    return plan, digest.plan_digest(plan, F.col("source"), F.concat_ws(">", "source", "target"))


def rename(files: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
    """The plan of canonical names, and its digest. files: with ext, stamp and descriptor."""
    plan = planning.rename_plan(files, collection)
    return plan, digest.plan_digest(plan, F.col("source"), F.concat_ws(">", "source", "target"))


def correct_extensions(files: DataFrame, formats: DataFrame, accepted: DataFrame, protected: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Decisions on every file's extension, and the digest of the renames among them."""
    plan = planning.extension_plan(files, formats, accepted, protected)
    moves = plan.filter("decision = 'rename'")
    return plan, digest.plan_digest(moves, F.col("path"), F.concat_ws(">", "path", "target"))


def warm(spark: SparkSession, path: str, files: DataFrame, namespace: tuple[str, str, str], provider: population.Provider, reuse: bool = True) -> dict:
    """Computes and publishes evidence that a store lacks (all of it again, without reuse), and counts what was done."""
    now = store.read(spark, path)
    counts = population.counters(files, now, namespace, reuse).first().asDict()
    version = store.publish(spark, path, population.populate(files, now, namespace, provider, reuse)) if counts["to_compute"] else None
    return counts | {"version": version}


def quarantine_plan(tree_entries: DataFrame, source: dict, destination: dict, block: int = 4096, reserve: int = 1 << 20) -> dict:
    """Whether a review tree can be copied away: its manifest, the bytes needed, and what speaks against it.

    tree_entries: path, category, size, sha256, device, inode; source and destination: device, ancestry (device:inode, leaf to root) and, for the destination, free bytes.
    """
    rows = tree_entries.withColumn("tree", F.lit("tree"))
    manifest = merkle.manifests(merkle.tree(rows)).drop("tree").first()
    need = journal.capacity(rows.filter("category = 'file'"), "tree", block, reserve).first()
    checks = {
        "hard-links": planning.aliases(rows.filter("category = 'file'")).limit(1).count() > 0,
        "unsafe-entries": rows.filter(~F.col("category").isin("file", "directory")).limit(1).count() > 0,
        "same-device": source["device"] == destination["device"],
        "nested": source["ancestry"][0] in destination["ancestry"] or destination["ancestry"][0] in source["ancestry"],
        "no-space": need is not None and need["required"] > destination["free"],
    }
    return {"schema_version": 1, "manifest": manifest.asDict() if manifest else None, "required": need["required"] if need else reserve, "problems": sorted(k for k, bad in checks.items() if bad)}


def evidence_report(store: DataFrame, observations: DataFrame, current: DataFrame, versions: DataFrame | None = None) -> dict:
    """Evidence per type and how much of it is linked and current; with the algorithms in use (evidence_type, algorithm), also what fits them, the observations by state and the coverage of the whole store."""
    types = {r["evidence_type"]: {k: r[k] for k in ("records", "namespaces", "linked", "unlinked", "current")} for r in evidence.status(store, observations, current).collect()}
    if versions is None:
        return types
    one = evidence.report(store, observations, current, versions).first()
    part = lambda *names: {n: one[n] for n in names}
    return {
        "evidence_types": types, **part("evidence_records", "evidence_namespaces"), "evidence_compatibility": part("algorithm_compatible", "stale_algorithm", "unknown_type"),
        "file_observations": {"total": one["observations"], **{s: one[f"observations_{s}"] for s in ("current", "stale", "unreadable")}}, "evidence_coverage": part("linked", "linked_current", "unlinked"),
    }
