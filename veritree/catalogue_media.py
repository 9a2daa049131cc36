"""Registered queries on decoded content, validation and reuse, each with the DuckDB SQL it must equal.

The tables hold no media, so providers' evidence is derived from documents: a picture's pixel digest and a video's
playback digest from the text without case and spacing, probes from its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritree.catalogue import FILES, SIDES, files, query, sides, table
from veritree.functions import content
from veritree.functions import text as names
from veritree.operators import duplicates, inventory, media, population, validation
from veritree.operators import evidence as evidence_store


def evidence(spark: SparkSession, sf_dir: str, digest: str) -> DataFrame:
    """sha256 and a digest that files of other bytes can share; none where the size is a multiple of 17."""
    t = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size"), F.sha2(names.normalised(F.col("text")), 256).alias("d"))
    return t.select("sha256", F.when(F.col("size") % 17 != 0, F.col("d")).alias(digest)).distinct()


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text").cast("long")
    audio = size % 4 != 0
    return (
        table(spark, sf_dir, "documents")
        .select(
            F.sha2("text", 256).alias("sha256"),
            (320 * (1 + F.floor(size / 64) % 3)).cast("int").alias("display_width"),
            (240 * (F.floor(size / 64) % 5)).cast("int").alias("display_height"),
            audio.alias("has_audio"),
            F.when(audio, F.when(size % 8 == 1, 44100).otherwise(48000)).alias("audio_sample_rate"),
            F.when(audio, F.lit(2)).alias("audio_channels"),
            F.when(audio & (size % 13 != 0), "stereo").alias("audio_layout"),
        )
        .distinct()
    )


EVIDENCE = rf"""{FILES}, p AS (
  SELECT DISTINCT sha256, CASE WHEN size % 17 <> 0 THEN sha256(lower(trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g')))) END AS digest FROM files
), pr AS (
  SELECT DISTINCT sha256, (320 * (1 + (size // 64) % 3))::INTEGER AS display_width, (240 * ((size // 64) % 5))::INTEGER AS display_height, size % 4 <> 0 AS has_audio,
    CASE WHEN size % 4 <> 0 THEN CASE WHEN size % 8 = 1 THEN 44100 ELSE 48000 END END AS audio_sample_rate, CASE WHEN size % 4 <> 0 THEN 2 END AS audio_channels,
    CASE WHEN size % 4 <> 0 AND size % 13 <> 0 THEN 'stereo' END AS audio_layout FROM files
), k AS (SELECT sha256, (display_width, display_height, has_audio, audio_sample_rate, audio_channels, audio_layout)::VARCHAR AS k FROM pr)"""
GROUPS = """SELECT {digest} AS {name}, path, size, modified_ns, count(*) OVER w AS group_size, min(path) OVER w AS first_path FROM {rows} WINDOW w AS (PARTITION BY {digest}) QUALIFY group_size > 1"""
PICTURES = GROUPS.format(digest="digest", name="pixel_sha256", rows="(SELECT * FROM files JOIN p USING (sha256) WHERE kind = 'picture' AND digest IS NOT NULL)")
BUCKETS = "b AS (SELECT *, count(*) OVER (PARTITION BY k) AS bucket_size FROM (SELECT * FROM files WHERE kind = 'video') JOIN k USING (sha256) QUALIFY bucket_size > 1)"
PLAYBACK = GROUPS.format(digest="digest", name="playback_sha256", rows="(SELECT b.*, p.digest FROM b JOIN p USING (sha256) WHERE digest IS NOT NULL)")


def of_kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return files(spark, sf_dir).filter(F.col("kind") == kind)


def pictures(spark, sf_dir) -> DataFrame:
    return media.decoded_groups(of_kind(spark, sf_dir, "picture"), evidence(spark, sf_dir, "pixel_sha256"), "pixel_sha256")


@query(f"WITH {EVIDENCE} {PICTURES}")
def pixel_groups(spark, sf_dir):
    return pictures(spark, sf_dir)


@query(f"WITH {EVIDENCE}, g AS ({PICTURES}) SELECT *, row_number() OVER (PARTITION BY pixel_sha256 ORDER BY size DESC, modified_ns, lower(path), path)::INTEGER AS rank FROM g")
def pixel_keepers(spark, sf_dir):
    return media.keepers(pictures(spark, sf_dir), "pixel_sha256")


@query(f"WITH {EVIDENCE}, {BUCKETS} SELECT path, sha256, bucket_size FROM b")
def video_candidate_buckets(spark, sf_dir):
    return media.candidate_buckets(of_kind(spark, sf_dir, "video"), probes(spark, sf_dir)).select("path", "sha256", "bucket_size")


@query(f"WITH {EVIDENCE}, {BUCKETS} SELECT DISTINCT sha256 FROM b WHERE sha256 NOT IN (SELECT sha256 FROM p WHERE digest IS NOT NULL)")
def video_to_decode(spark, sf_dir):
    known = evidence(spark, sf_dir, "playback_sha256").filter("playback_sha256 is not null")
    return media.to_decode(of_kind(spark, sf_dir, "video"), probes(spark, sf_dir), known)


@query(f"WITH {EVIDENCE}, {BUCKETS} {PLAYBACK}")
def video_groups(spark, sf_dir):
    return media.playback_groups(of_kind(spark, sf_dir, "video"), probes(spark, sf_dir), evidence(spark, sf_dir, "playback_sha256"))


LAYERS = f"""{SIDES}, {EVIDENCE.removeprefix(FILES + ", ")}, gone AS (SELECT DISTINCT kind, size, sha256 FROM src WHERE (size, sha256) NOT IN (SELECT (size, sha256) FROM dst)),
pl AS (SELECT size, sha256, digest IS NOT NULL AND digest IN (SELECT digest FROM p JOIN dst USING (sha256) WHERE kind = 'picture' AND digest IS NOT NULL) AS represented, digest IS NULL AS issue FROM gone JOIN p USING (sha256) WHERE kind = 'picture'),
vk AS (SELECT sha256, k, digest FROM k JOIN p USING (sha256) WHERE digest IS NOT NULL),
vl AS (SELECT size, sha256, digest IS NOT NULL AND (k, digest) IN (SELECT (k, digest) FROM vk JOIN dst USING (sha256) WHERE kind = 'video') AS represented, digest IS NULL AS issue FROM gone LEFT JOIN vk USING (sha256) WHERE kind = 'video')"""
STATUS = """SELECT count(*) AS eligible, count(*) FILTER (WHERE represented) AS represented, count(*) FILTER (WHERE NOT represented AND NOT issue) AS missing, count(*) FILTER (WHERE issue) AS issues,
  CASE WHEN count(*) = 0 THEN 'not-needed' WHEN count(*) FILTER (WHERE issue) > 0 THEN 'unproven' WHEN count(*) FILTER (WHERE NOT represented) > 0 THEN 'incomplete' ELSE 'complete' END AS status FROM """


@query(f"WITH {LAYERS} SELECT size, sha256, represented, issue FROM pl")
def picture_layer(spark, sf_dir):
    return media.picture_layer(*sides(spark, sf_dir), evidence(spark, sf_dir, "pixel_sha256"))


@query(f"WITH {LAYERS} {STATUS} pl")
def picture_layer_status(spark, sf_dir):
    return media.layer_status(picture_layer(spark, sf_dir))


@query(f"WITH {LAYERS} SELECT size, sha256, represented, issue FROM vl")
def video_layer(spark, sf_dir):
    return media.video_layer(*sides(spark, sf_dir), probes(spark, sf_dir), evidence(spark, sf_dir, "playback_sha256"))


@query(f"WITH {LAYERS} {STATUS} vl")
def video_layer_status(spark, sf_dir):
    return media.layer_status(video_layer(spark, sf_dir))


@query(f"""WITH {EVIDENCE} SELECT sha256, CASE WHEN least(display_width, display_height) < 1 THEN 'dimensions' ELSE 'audio-missing' END AS problem FROM pr WHERE least(display_width, display_height) < 1 OR (has_audio AND audio_layout IS NULL)""")
def probe_problems(spark, sf_dir):
    return media.probe_problems(probes(spark, sf_dir))


@query("SELECT lang AS key, count(DISTINCT source) AS payloads FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def evidence_conflicts(spark, sf_dir):
    return media.conflicts(table(spark, sf_dir, "documents").select(F.col("lang").alias("key"), "source"), "key", "source")


@query(f"""WITH {FILES}, a AS (SELECT path, size, sha256, CASE WHEN doc_id % 3 <> 0 THEN 'ok' END AS value, CASE WHEN doc_id % 3 = 0 THEN 'unreadable' END AS issue FROM files)
SELECT size, sha256, min(path) FILTER (WHERE value IS NOT NULL) AS path, count(*) FILTER (WHERE value IS NULL) > 0 AS tried_others FROM a GROUP BY 1, 2 HAVING count(value) > 0""")
def representative_paths(spark, sf_dir):
    f = files(spark, sf_dir)
    attempts = f.select("path", F.when(F.col("doc_id") % 3 != 0, "ok").alias("value"), F.when(F.col("doc_id") % 3 == 0, "unreadable").alias("issue"))
    good, _ = media.representatives(f, attempts)
    failed = f.filter("doc_id % 3 = 0").select("size", "sha256").distinct().withColumn("tried_others", F.lit(True))
    return good.join(failed, ["size", "sha256"], "left").select("size", "sha256", "path", F.coalesce("tried_others", F.lit(False)).alias("tried_others"))


REUSE = f"""{FILES}, c AS (SELECT sha256, max(size)::VARCHAR AS payload FROM files WHERE sha256 < '6' GROUP BY 1), n AS (SELECT sha256, max(size)::VARCHAR AS payload FROM files WHERE sha256 >= '6' AND size % 5 <> 0 GROUP BY 1),
r AS (SELECT path, sha256, coalesce(c.payload, n.payload) AS payload, CASE WHEN c.payload IS NOT NULL THEN 'reused' WHEN n.payload IS NOT NULL THEN 'computed' ELSE 'failed' END AS origin FROM files LEFT JOIN c USING (sha256) LEFT JOIN n USING (sha256))"""


def reused(spark, sf_dir) -> DataFrame:
    f = files(spark, sf_dir)
    rows = f.select("sha256", "size", F.col("size").cast("string").alias("payload"))
    return media.reuse(f.select("path", "sha256"), rows.filter("sha256 < '6'"), rows.filter("sha256 >= '6' and size % 5 <> 0"), "sha256", "payload")


@query(f"WITH {REUSE} SELECT * FROM r")
def evidence_reuse(spark, sf_dir):
    return reused(spark, sf_dir)


@query(f"""WITH {REUSE} SELECT count(*) AS discovered, count(*) FILTER (WHERE origin = 'reused') AS reused, count(*) FILTER (WHERE origin = 'computed') AS computed, count(*) FILTER (WHERE origin = 'failed') AS failed,
  count(DISTINCT sha256) AS distinct_hashes, count(DISTINCT sha256) FILTER (WHERE origin <> 'failed') AS represented_hashes FROM r""")
def evidence_population(spark, sf_dir):
    return media.reuse_counters(reused(spark, sf_dir), "sha256")


STATES = f"""{FILES}, s AS (SELECT path, sha256, CASE WHEN doc_id % 5 = 0 THEN 'gone' WHEN doc_id % 6 = 0 THEN 'unreadable' WHEN doc_id % 4 = 0 THEN 'stale' ELSE 'current' END AS state, 'collection-v1:7:' || doc_id % 2 AS scope FROM files)"""


def observed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    f, d = files(spark, sf_dir), F.col("doc_id")
    state = f.select("doc_id", "path", "sha256", F.lit(7).alias("device"), d.alias("inode"), "size", "modified_ns", F.col("modified_ns").alias("changed_ns"))
    seen = state.withColumn("scope", evidence_store.scope(F.col("device"), d % 2)).withColumnsRenamed({"path": "relative_path", "sha256": "byte_sha256"}).drop("doc_id")
    now = state.filter(d % 5 != 0).withColumns({"category": F.when(d % 6 == 0, "unreadable").otherwise("file"), "changed_ns": F.when(d % 4 == 0, F.col("changed_ns") + 1).otherwise(F.col("changed_ns"))})
    return seen, now.drop("doc_id", "sha256")


@query(f"WITH {STATES} SELECT path AS relative_path, sha256 AS byte_sha256, state FROM s")
def observation_states(spark, sf_dir):
    return evidence_store.observation_states(*observed(spark, sf_dir))


@query(f"WITH {STATES} SELECT path, sha256 AS byte_sha256 FROM s WHERE state = 'current' AND scope = 'collection-v1:7:1'")
def reusable_hashes(spark, sf_dir):
    return evidence_store.matching(*observed(spark, sf_dir), "collection-v1:7:1")


@query("""WITH e AS (SELECT lang AS evidence_type, source AS algorithm, CASE WHEN doc_id % 2 = 0 THEN 'r1' ELSE 'r2' END AS runtime FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL), v AS (SELECT 'en' AS evidence_type, 'src0' AS algorithm, 'r1' AS runtime UNION ALL SELECT 'de', 'src1', 'r2')
SELECT evidence_type, count(*) FILTER (WHERE (evidence_type, algorithm, runtime) IN (SELECT (evidence_type, algorithm, runtime) FROM v)) AS compatible,
  count(*) FILTER (WHERE (evidence_type, algorithm, runtime) NOT IN (SELECT (evidence_type, algorithm, runtime) FROM v) AND evidence_type IN ('en', 'de')) AS stale, count(*) FILTER (WHERE evidence_type NOT IN ('en', 'de')) AS unknown FROM e GROUP BY 1""")
def evidence_compatibility(spark, sf_dir):
    e = table(spark, sf_dir, "documents").filter("lang is not null and source is not null").select(F.col("lang").alias("evidence_type"), F.col("source").alias("algorithm"), F.when(F.col("doc_id") % 2 == 0, "r1").otherwise("r2").alias("runtime"))
    versions = spark.createDataFrame([("en", "src0", "r1"), ("de", "src1", "r2")], "evidence_type string, algorithm string, runtime string")
    return evidence_store.compatibility(e, versions)


# -- validation: an entry for each document ------------------------------------------------------------------------------------


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    category = F.when(d % 41 == 0, "symbolic_link").when(d % 43 == 0, "unreadable").when(d % 47 == 0, "changed").when(d % 53 == 0, "ignored").otherwise("file")
    kind = F.when(d % 19 == 0, "other").when(d % 23 == 0, "video").otherwise(F.col("kind"))
    ext_kind = F.when(F.col("ext").isin(".jpg", ".png"), "picture").when(F.col("ext").isin(".mp4", ".mkv"), "video")
    f = files(spark, sf_dir).withColumns({"category": category, "kind": kind, "ext_kind": ext_kind})
    return f.withColumn("disposition", validation.disposition(F.col("category"), F.col("kind"), F.col("ext_kind")))


ENTRIES = f"""{FILES}, e0 AS (SELECT * REPLACE (CASE WHEN doc_id % 19 = 0 THEN 'other' WHEN doc_id % 23 = 0 THEN 'video' ELSE kind END AS kind), CASE WHEN ext IN ('.jpg', '.png') THEN 'picture' WHEN ext IN ('.mp4', '.mkv') THEN 'video' END AS ext_kind FROM files),
e AS (SELECT *, CASE WHEN doc_id % 41 = 0 THEN 'symlink' WHEN doc_id % 43 = 0 THEN 'unreadable' WHEN doc_id % 47 = 0 THEN 'changed' WHEN doc_id % 53 = 0 THEN 'ignored' WHEN kind IN ('picture', 'video') THEN 'candidate' WHEN ext_kind IS NOT NULL THEN 'mismatched' ELSE 'other' END AS disposition FROM e0),
c AS (SELECT *, doc_id % 29 = 0 AS moved, doc_id % 7 = 1 AS bad, doc_id % 31 <> 0 AS decoder, doc_id % 37 <> 0 AS matches, (doc_id // 7) % 6 AS nv FROM e WHERE disposition = 'candidate')"""

STREAM = "struct<codec_type: string, codec_name: string, width: int, height: int>"


def candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates, and a probe of each."""
    e = entries(spark, sf_dir).filter("disposition = 'candidate'").withColumn("changed", F.col("doc_id") % 29 == 0)
    d = F.col("doc_id")
    nv = F.floor(d / 7) % 6
    stream = lambda kind, codec, w: F.struct(F.lit(kind).alias("codec_type"), codec.alias("codec_name"), w.alias("width"), F.lit(480).alias("height"))
    codec = F.when(nv == 5, F.lit(None).cast("string")).otherwise(F.lit("h264"))
    width = F.when(nv == 4, F.lit(0)).otherwise(F.lit(640))
    none = F.array().cast(f"array<{STREAM}>")
    streams = F.concat(
        F.when(nv == 0, none).when(nv == 2, F.array(stream("video", codec, width), stream("video", codec, width))).otherwise(F.array(stream("video", codec, width))),
        F.when(nv == 3, F.array(stream("audio", F.lit("aac"), F.lit(None).cast("int")), stream("audio", F.lit("aac"), F.lit(None).cast("int")))).otherwise(none),
        F.when(d % 5 == 0, F.array(stream("subtitle", F.lit("srt"), F.lit(None).cast("int")))).otherwise(none),
    )
    p = e.select(
        "path", (d % 7 != 1).alias("ok"), (d % 31 != 0).alias("decoder"), (d % 37 != 0).alias("format_matches"), streams.alias("streams"),
        F.when(d % 3 == 0, F.lit(None).cast("double")).otherwise(F.lit(9.5)).alias("duration"), F.when(d % 2 == 0, "matroska,webm").otherwise("mov,mp4").alias("family"),
        (d % 120).cast("int").alias("score"), F.when(d % 11 != 0, F.array(F.lit("mov,mp4"))).alias("accepted"),
    )
    return e.select("path", "sha256", "kind", "ext_kind", "size", "changed", "disposition"), p


_RULES = (
    ("empty_file", "size = 0"),
    ("unrecognized_media_extension", "ext_kind IS NULL"),
    ("extension_content_mismatch", "ext_kind <> kind OR (kind = 'picture' AND size > 0 AND NOT (ext_kind IS NOT NULL AND ext_kind = 'picture' AND NOT decoder) AND NOT bad AND NOT matches)"),
    ("unsupported_image_format", "size > 0 AND kind = 'picture' AND ext_kind = 'picture' AND NOT decoder"),
    ("invalid_image", "kind = 'picture' AND size > 0 AND bad AND NOT coalesce(ext_kind = 'picture' AND NOT decoder, false)"),
    ("invalid_video", "kind = 'video' AND size > 0 AND bad"),
    ("missing_video_stream", "probed AND nv = 0"),
    ("missing_video_codec", "probed AND nv = 5"),
    ("invalid_video_dimensions", "probed AND nv = 4"),
    ("multiple_video_streams", "probed AND nv = 2"),
    ("multiple_audio_streams", "probed AND nv = 3"),
    ("additional_streams", "probed AND doc_id % 5 = 0"),
    ("missing_or_invalid_duration", "probed AND doc_id % 3 = 0"),
    ("container_extension_mismatch", "probed AND doc_id % 120 BETWEEN 50 AND 100 AND doc_id % 11 <> 0 AND doc_id % 2 = 0"),
)
_SEVERITY = " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in validation.SEVERITY.items())
FOUND = f"""{ENTRIES}, q AS (SELECT *, kind = 'video' AND size > 0 AND NOT bad AS probed FROM c),
r AS (SELECT path, kind, unnest(CASE WHEN moved THEN ['changed_during_validation'] ELSE list_filter([{", ".join(f"CASE WHEN {rule} THEN '{code}' END" for code, rule in _RULES)}], lambda x: x IS NOT NULL) END) AS code FROM q),
f AS (SELECT path, kind, CASE code {_SEVERITY} END AS severity, code FROM r),
g AS (SELECT path, 'entry' AS kind, CASE disposition WHEN 'symlink' THEN 'symbolic_link_skipped' WHEN 'unreadable' THEN 'unreadable_entry' WHEN 'changed' THEN 'changed_during_discovery' ELSE 'extension_content_mismatch' END AS code FROM e WHERE disposition IN ('symlink', 'unreadable', 'changed', 'mismatched')),
h AS (SELECT * FROM f UNION ALL SELECT path, kind, CASE code {_SEVERITY} END AS severity, code FROM g)"""


def all_findings(spark, sf_dir) -> DataFrame:
    return validation.file_findings(*candidates(spark, sf_dir)).unionByName(validation.entry_findings(entries(spark, sf_dir)))


@query(f"WITH {ENTRIES} SELECT disposition, count(*) AS entries, sum(size)::BIGINT AS bytes FROM e GROUP BY 1")
def candidate_dispositions(spark, sf_dir):
    return entries(spark, sf_dir).groupBy("disposition").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"))


@query(f"WITH {FOUND} SELECT * FROM h")
def validation_findings(spark, sf_dir):
    return all_findings(spark, sf_dir)


@query(f"WITH {FOUND} SELECT severity, code, count(*) AS count, count(DISTINCT path) AS files FROM h GROUP BY 1, 2")
def validation_findings_table(spark, sf_dir):
    return validation.findings_table(all_findings(spark, sf_dir))


@query(f"""WITH {FOUND}, w AS (SELECT path, max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS r FROM h GROUP BY 1)
SELECT (SELECT count(*) FROM w WHERE r = 2) AS files_with_errors, (SELECT count(*) FROM w WHERE r = 1) AS files_with_warnings, (SELECT count(*) FROM c WHERE path NOT IN (SELECT path FROM w WHERE r > 0)) AS healthy_files,
  (SELECT count(*) FROM c) AS media_files, CASE WHEN (SELECT count(*) FROM w WHERE r = 2) > 0 THEN 1 ELSE 0 END AS status""")
def validation_health(spark, sf_dir):
    return validation.health(candidates(spark, sf_dir)[0], all_findings(spark, sf_dir))


RESULTS = f"""{FOUND}, s AS (SELECT path, max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS r, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM f GROUP BY 1),
t AS (SELECT c.path, sha256, c.kind, CASE s.r WHEN 2 THEN 'errors' WHEN 1 THEN 'warnings' ELSE 'healthy' END AS outcome, coalesce(codes, '') AS codes, moved FROM c LEFT JOIN s USING (path))"""


def checked(spark, sf_dir) -> DataFrame:
    c, p = candidates(spark, sf_dir)
    return validation.results(c, validation.file_findings(c, p))


@query(f"WITH {RESULTS} SELECT path, sha256, kind, outcome, codes FROM t")
def validation_results(spark, sf_dir):
    return checked(spark, sf_dir).withColumn("codes", F.array_join("codes", ","))


@query(f"WITH {RESULTS} SELECT sha256, CASE WHEN sha256 < '3' THEN 'sha256' ELSE 'outcome' END AS problem FROM t WHERE sha256 < '3' OR (sha256 < '6' AND outcome <> 'healthy')")
def validation_result_problems(spark, sf_dir):
    rows = checked(spark, sf_dir)
    wrong = rows.withColumn("outcome", F.when(F.col("sha256") < "6", "healthy").otherwise(F.col("outcome")))
    bad = wrong.withColumn("sha256", F.when(F.col("sha256") < "3", F.upper("sha256")).otherwise(F.col("sha256")))
    # the digests of shown rows are given in lower case again
    marked = bad.withColumn("sha256", F.when(F.col("sha256") < "3", F.concat("sha256", F.lit("!"))).otherwise(F.col("sha256")))
    return validation.result_problems(marked).withColumn("sha256", F.lower(F.regexp_replace("sha256", "!", "")))


@query(f"""WITH {RESULTS}, o AS (SELECT sha256, kind, max(outcome) AS outcome FROM t WHERE sha256 < '8' GROUP BY 1, 2 HAVING count(*) = 1)
SELECT t.path, coalesce(CASE WHEN NOT t.moved THEN o.outcome END, t.outcome) AS outcome, o.outcome IS NOT NULL AND NOT t.moved AS reused FROM t LEFT JOIN o USING (sha256, kind)""")
def validation_reuse(spark, sf_dir):
    rows = checked(spark, sf_dir)
    return validation.merged_results(candidates(spark, sf_dir)[0], rows.filter("sha256 < '8'"), rows.select("path", "outcome"))


@query(f"""WITH {FILES}, g AS (SELECT kind, size, count(*) AS n FROM files WHERE kind IN ('picture', 'video') AND NOT in_review GROUP BY 1, 2 HAVING count(*) > 1)
SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS files, coalesce(sum(size * (n - 1)), 0)::BIGINT AS upper_bound FROM g""")
def duplicate_statistics(spark, sf_dir):
    return inventory.duplicate_statistics(files(spark, sf_dir))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lower(source) || 'ss' || chr(963) ELSE lower(lang) END AS folded FROM documents")
def case_folding(spark, sf_dir):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.upper("source"), F.lit("ßς"))).otherwise(F.upper("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", duplicates.folded(name).alias("folded"))


# -- content ------------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'video/x-matroska' WHEN 3 THEN CASE WHEN doc_id % 2 = 1 AND doc_id % 9 = 0 THEN 'video/mp4' ELSE 'text/plain' END WHEN 4 THEN 'application/octet-stream' ELSE 'unknown' END AS mime,
  NOT (doc_id % 6 = 5 OR (doc_id % 6 = 3 AND doc_id % 9 = 0)) AS from_content, CASE WHEN doc_id % 6 = 0 THEN 'JPEG' END AS format FROM documents""")
def detected_types(spark, sf_dir):
    d = F.col("doc_id")
    head = F.when(d % 6 == 0, "FFD8FFE0").when(d % 6 == 1, "000000186674797069736F6D").when(d % 6 == 2, "1A45DFA3").when(d % 6 == 3, F.hex(F.concat(F.lit("plain "), d.cast("string")))).when(d % 6 == 4, "41001F").otherwise("")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.unhex(head).alias("head"), F.when((d % 6 == 3) & (d % 9 == 0), ".mp4").otherwise(".xyz").alias("ext"))
    kind = content.detected_type(F.col("head"), F.col("ext"), {".mp4": "video/mp4"})
    return rows.select("doc_id", kind.alias("k"), content.picture_format(F.col("head")).alias("format")).select("doc_id", "k.*", "format")


@query("""SELECT o_orderkey, o_orderkey || ':' || o_custkey AS state, sha256('/' || o_clerk) AS binding, NOT contains(o_clerk, '0000000') AS absolute FROM (SELECT o_orderkey, o_custkey, 'c' || o_orderkey AS o_clerk FROM orders)""")
def state_names(spark, sf_dir):
    path = F.concat(F.lit("/c"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", content.state_name("o_orderkey", "o_custkey").alias("state"), content.destination_binding(path).alias("binding"), content.absolute_path_ok(path).alias("absolute"))


@query(f"""WITH {FILES}, e AS (SELECT DISTINCT sha256 FROM files WHERE sha256 < '9'), g AS (SELECT sha256, count(*) AS n FROM files GROUP BY 1)
SELECT sum(n)::BIGINT AS discovered, count(*) AS distinct_hashes, count(*) FILTER (WHERE sha256 IN (SELECT sha256 FROM e)) AS reused, count(*) FILTER (WHERE sha256 NOT IN (SELECT sha256 FROM e)) AS to_compute FROM g""")
def population_counters(spark, sf_dir):
    f = files(spark, sf_dir)
    known = f.filter("sha256 < '9'").select(F.col("sha256").alias("file_sha256"), F.lit("t").alias("evidence_type"), F.lit("v").alias("algorithm"), F.lit("r").alias("runtime")).distinct()
    return population.counters(f, known, ("t", "v", "r"))


@query(f"""WITH {FILES} SELECT path, sha256 AS want, CASE WHEN doc_id % 8 = 0 THEN 'x' END AS have FROM files WHERE doc_id % 8 = 0 OR doc_id % 9 = 0""")
def rechecked_hashes(spark, sf_dir):
    f, d = files(spark, sf_dir), F.col("doc_id")
    fresh = f.filter((d % 9 != 0) | (d % 8 == 0)).select("path", F.when(d % 8 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return population.rechecked(f, fresh)
