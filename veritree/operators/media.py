"""Duplicates and coverage by decoded content: pixel digests of pictures, playback digests of videos.

Decoders are not part of the engine. A provider's results come as evidence tables: pictures as
(sha256, pixel_sha256), probes as (sha256, the six fields of the candidate key, ...), fingerprints as
(sha256, playback_sha256), each one row per content hash. Every operator joins on the hash, so copies
of one file are looked up once and never decoded twice; a hash with two payloads is an error, not a choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritree.operators import coverage
from veritree.plans.ordering import numbered

#: What equal playback has in common: files that differ in one of these can not play alike.
CANDIDATE_KEY = ("display_width", "display_height", "has_audio", "audio_sample_rate", "audio_channels", "audio_layout")


def candidate_key() -> Column:
    return F.struct(*CANDIDATE_KEY)


def conflicts(evidence: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys with more than one payload; any row refuses the evidence."""
    return evidence.groupBy(key).agg(F.countDistinct(F.coalesce(F.col(payload).cast("string"), F.lit("\x00"))).alias("payloads")).filter("payloads > 1")


#: What a probe reports of a stream and its container; all that is not a number comes as text.
PROBE = (
    "streams array<struct<codec_type: string, codec_name: string, width: long, height: long, pix_fmt: string, bits_per_raw_sample: string, color_transfer: string, rotation: string, "
    "duration: string, start_time: string, sample_rate: string, channels: long, channel_layout: string, disposition: struct<attached_pic: int>>>, format struct<duration: string, format_name: string, probe_score: int>"
)
# Transfer functions of high dynamic range, and pixel formats of over eight bits.
HDR, DEEP = ("arib-std-b67", "smpte2084"), "(10|12|14|16|48|64)(le|be)?$"


def normalised_probes(raw: DataFrame) -> DataFrame:
    """A probe's JSON as the fields that decide about equal playback, or the first reason why a file is not compared. raw: sha256, json.

    One video stream, one audio stream at most and nothing else, eight bits, no high dynamic range, positive size and duration; a quarter turn exchanges width and height.
    """
    from veritree.functions.text import decimal_microseconds, rotation

    rows = raw.select("sha256", F.from_json("json", PROBE).alias("p")).select("sha256", "p.*")
    of = lambda kind: F.filter("streams", lambda s: s["codec_type"] == kind)
    rows = rows.withColumns({"videos": of("video"), "audios": of("audio")}).withColumns({"v": F.try_element_at("videos", F.lit(1)), "a": F.try_element_at("audios", F.lit(1))})
    v, a = F.col("v"), F.col("a")
    has_audio = F.size("audios") == 1
    pixels = F.lower(F.coalesce(v["pix_fmt"], F.lit("")))
    rate = a["sample_rate"].try_cast("int")
    duration = F.coalesce(decimal_microseconds(v["duration"]), decimal_microseconds(F.col("format.duration")))
    turned = rotation(F.coalesce(v["rotation"], F.lit("0")))
    problem = (
        F.when(F.col("streams").isNull(), "no-streams")
        .when(F.size("videos") != 1, "video-streams")
        .when(F.size("audios") > 1, "audio-streams")
        .when(F.size("streams") > F.size("videos") + F.size("audios"), "other-streams")
        .when(F.coalesce(v["disposition"]["attached_pic"], F.lit(0)) != 0, "attached-picture")
        .when(~F.coalesce((v["width"] > 0) & (v["height"] > 0), F.lit(False)), "dimensions")
        .when((pixels == "") | pixels.rlike(DEEP) | (F.coalesce(v["bits_per_raw_sample"].try_cast("int"), F.lit(0)) > 8) | F.lower(F.coalesce(v["color_transfer"], F.lit(""))).isin(*HDR), "high-bit-depth")
        .when(turned.isNull(), "rotation")
        .when(~F.coalesce(duration > 0, F.lit(False)), "duration")
        .when(has_audio & ~F.coalesce((rate > 0) & (a["channels"] > 0), F.lit(False)), "audio")
    )
    sideways = turned.isin(90, 270)
    ok = problem.isNull()
    when = lambda c: F.when(ok, c)
    return rows.select(
        "sha256",
        problem.alias("problem"),
        when(F.when(sideways, v["height"]).otherwise(v["width"])).cast("int").alias("display_width"),
        when(F.when(sideways, v["width"]).otherwise(v["height"])).cast("int").alias("display_height"),
        when(has_audio).alias("has_audio"),
        when(F.when(has_audio, rate)).alias("audio_sample_rate"),
        when(F.when(has_audio, a["channels"])).cast("int").alias("audio_channels"),
        when(F.when(has_audio, F.coalesce(a["channel_layout"], F.concat(a["channels"].cast("string"), F.lit("ch"))))).alias("audio_layout"),
        when(duration).alias("duration_us"),
        when(decimal_microseconds(v["start_time"], 0)).alias("video_start_us"),
        when(F.when(has_audio, decimal_microseconds(a["start_time"], 0))).alias("audio_start_us"),
    )


def encoded(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """sha256 and a payload: the columns as a JSON object with sorted keys, nulls written out."""
    return rows.select("sha256", F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("payload_json"))


def probe_problems(probes: DataFrame) -> DataFrame:
    """Probe rows of an impossible shape, with the first rule broken: positive dimensions, audio fields all present with audio and all absent without."""
    audio = [F.col(c).isNotNull() for c in ("audio_sample_rate", "audio_channels", "audio_layout")]
    every, some = audio[0] & audio[1] & audio[2], audio[0] | audio[1] | audio[2]
    problem = (
        F.when(F.col("display_width").isNull() | F.col("display_height").isNull() | (F.least("display_width", "display_height") < 1), "dimensions")
        .when(F.col("has_audio").isNull(), "has_audio")
        .when(F.col("has_audio") & ~every, "audio-missing")
        .when(~F.col("has_audio") & some, "audio-unexpected")
    )
    return probes.select("sha256", problem.alias("problem")).filter("problem is not null")


def decoded_groups(files: DataFrame, digests: DataFrame, digest: str) -> DataFrame:
    """Files whose decoded content others share: digest, path, size, modified_ns, group_size and first_path, by which groups are ordered."""
    known = digests.filter(F.col(digest).isNotNull()).select("sha256", digest).distinct()
    rows = files.join(known, "sha256")
    groups = rows.groupBy(digest).agg(F.count(F.lit(1)).alias("group_size"), F.min("path").alias("first_path")).filter("group_size > 1")
    return rows.join(groups, digest).select(digest, "path", "size", "modified_ns", "group_size", "first_path")


def keepers(groups: DataFrame, digest: str, ascii_paths: bool = False) -> DataFrame:
    """Members of each group ranked, by ranges: largest, then oldest, then first path; rank 1 is kept."""
    from veritree.operators.duplicates import folded

    key = F.lower("path") if ascii_paths else folded(F.col("path"))
    return numbered(groups, [-F.col("size"), F.col("modified_ns"), key, F.col("path")], (digest,), "rank").withColumn("rank", F.col("rank").cast("int"))


def candidate_buckets(files: DataFrame, probes: DataFrame) -> DataFrame:
    """Files of buckets of equal candidate key with several files, null parts equal: only these need decoding."""
    rows = files.join(probes.select("sha256", *CANDIDATE_KEY).distinct(), "sha256")
    sizes = rows.groupBy(candidate_key().alias("k")).agg(F.count(F.lit(1)).alias("bucket_size")).filter("bucket_size > 1")
    # a struct of equal nulls is an equal struct
    return rows.withColumn("k", candidate_key()).join(sizes, "k").drop("k")


def to_decode(files: DataFrame, probes: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Distinct content hashes in buckets with several files that no fingerprint is stored for."""
    return candidate_buckets(files, probes).select("sha256").distinct().join(fingerprints.select("sha256"), "sha256", "left_anti")


def playback_groups(files: DataFrame, probes: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Files of equal playback within their bucket; a fingerprint without a bucket partner is not looked at."""
    rows = candidate_buckets(files, probes).select("path", "sha256", "size", "modified_ns", "bucket_size")
    groups = decoded_groups(rows, fingerprints, "playback_sha256")
    return groups


def representatives(files: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per identity the first path, in order, that could be read, and the issues of identities without any. attempts: path, value (null: failed), issue."""
    rows = files.select("size", "sha256", "path").join(attempts, "path")
    best = rows.groupBy("size", "sha256").agg(F.min(F.when(F.col("value").isNotNull(), F.struct("path", "value"))).alias("r"))
    good = best.filter("r is not null").select("size", "sha256", "r.path", "r.value")
    issues = rows.join(best.filter("r is null").select("size", "sha256"), ["size", "sha256"], "left_semi").select("size", "sha256", "path", "issue")
    return good, issues


def picture_layer(source: DataFrame, destination: DataFrame, pixels: DataFrame) -> DataFrame:
    """Byte-missing identities of pictures: represented if any of their pixel digests is a destination picture's; `issue` where the source's are not known."""
    gone = coverage.missing_files(source.filter("kind = 'picture'"), destination).select("size", "sha256").distinct()
    known = pixels.filter("pixel_sha256 is not null").select("sha256", "pixel_sha256").distinct()
    there = destination.filter("kind = 'picture'").select("sha256").distinct().join(known, "sha256").select(F.col("pixel_sha256"), F.lit(True).alias("hit")).distinct()
    found = gone.join(known, "sha256", "left").join(there, "pixel_sha256", "left")
    return found.groupBy("size", "sha256").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("represented"), (F.max("pixel_sha256").isNull()).alias("issue"))


def video_layer(source: DataFrame, destination: DataFrame, probes: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Byte-missing identities of videos: represented by equal playback among destination videos of an equal candidate key, and `issue` where the source has no probe or fingerprint."""
    gone = coverage.missing_files(source.filter("kind = 'video'"), destination).select("size", "sha256").distinct()
    seen = probes.select("sha256", candidate_key().alias("k")).distinct().join(fingerprints.filter("playback_sha256 is not null").select("sha256", "playback_sha256").distinct(), "sha256")
    there = destination.filter("kind = 'video'").select("sha256").distinct().join(seen, "sha256").select("k", "playback_sha256", F.lit(True).alias("hit")).distinct()
    found = gone.join(seen, "sha256", "left").join(there, ["k", "playback_sha256"], "left")
    return found.groupBy("size", "sha256").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("represented"), (F.max("playback_sha256").isNull()).alias("issue"))


def layer_status(layer: DataFrame, destination_issues: int = 0) -> DataFrame:
    """One row: eligible, represented, missing, issues and the status - not-needed, unproven, incomplete or complete."""
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    missing = ~F.col("represented") & ~F.col("issue")
    one = layer.agg(F.count(F.lit(1)).alias("eligible"), n(F.col("represented")).alias("represented"), n(missing).alias("missing"), n(F.col("issue") & ~F.col("represented")).alias("issues"))
    status = F.when(F.col("eligible") == 0, "not-needed").when(F.col("issues") > 0, "unproven").when((F.col("missing") > 0) & F.lit(destination_issues > 0), "unproven").when(F.col("missing") > 0, "incomplete").otherwise("complete")
    return one.withColumn("status", status)


def reuse(wanted: DataFrame, cached: DataFrame, computed: DataFrame, key: str, payload: str) -> DataFrame:
    """Each wanted row with its payload and where it came from: cache, fresh work shared by equal hashes, or none (`failed`)."""
    old = cached.groupBy(key).agg(F.max(payload).alias("old"))
    new = computed.groupBy(key).agg(F.max(payload).alias("new"))
    rows = wanted.join(old, key, "left").join(new, key, "left")
    origin = F.when(F.col("old").isNotNull(), "reused").when(F.col("new").isNotNull(), "computed").otherwise("failed")
    return rows.withColumn(payload, F.coalesce("old", "new")).withColumn("origin", origin).drop("old", "new")


def reuse_counters(rows: DataFrame, key: str) -> DataFrame:
    """discovered, inspected, distinct hashes and represented hashes, by origin of the payload."""
    one = lambda name: F.count(F.when(F.col("origin") == name, 1)).alias(name)
    return rows.agg(F.count(F.lit(1)).alias("discovered"), one("reused"), one("computed"), one("failed"), F.countDistinct(key).alias("distinct_hashes"), F.countDistinct(F.when(F.col("origin") != "failed", F.col(key))).alias("represented_hashes"))
