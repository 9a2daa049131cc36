"""Registered queries over the driver's tables, each with the DuckDB SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritree.functions import text as names
from veritree.operators import classification, coverage, duplicates, evidence, inventory, journal, planning, transitions
from veritree.plans import digest

FLAGSHIP = "byte_coverage"

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.collection(table(spark, sf_dir, "documents"))


FILES = """files AS (
  SELECT *, CASE WHEN ext IN ('.jpg', '.png') THEN 'picture' WHEN ext IN ('.mp4', '.mkv') THEN 'video' WHEN ext = '.mp3' THEN 'audio' WHEN ext = '.txt' THEN 'document' ELSE 'other' END AS kind,
    CASE ext WHEN '.jpg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' WHEN '.mp4' THEN 'video/mp4' WHEN '.mkv' THEN 'video/x-matroska' WHEN '.mp3' THEN 'audio/mpeg' WHEN '.txt' THEN 'text/plain' ELSE 'unknown' END AS mime_type,
    source || '/' || lang || '/doc_' || doc_id || ext AS path
  FROM (SELECT doc_id, lang, source, text, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha256, doc_id * 1000000000 AS modified_ns, doc_id % 11 = 0 AS in_review,
    ['.jpg', '.png', '.mp4', '.mkv', '.txt', '.mp3', ''][doc_id % 7 + 1] AS ext FROM documents)
)"""


@query(f"""WITH {FILES} SELECT k.kind, count(f.kind) AS files, coalesce(sum(f.size), 0)::BIGINT AS bytes
FROM (VALUES ('picture'), ('video'), ('audio'), ('document'), ('other')) AS k(kind) LEFT JOIN files f ON f.kind = k.kind GROUP BY k.kind""")
def inventory_by_kind(spark, sf_dir):
    return inventory.by_kind(files(spark, sf_dir))


@query(f"WITH {FILES} SELECT coalesce(nullif(ext, ''), '(none)') AS ext, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY 1")
def inventory_by_extension(spark, sf_dir):
    return inventory.by_attribute(files(spark, sf_dir), "ext")


@query(f"WITH {FILES} SELECT mime_type, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY 1")
def inventory_by_mime(spark, sf_dir):
    return inventory.by_attribute(files(spark, sf_dir), "mime_type")


@query(f"WITH {FILES} SELECT in_review, kind, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY 1, 2")
def review_storage(spark, sf_dir):
    return inventory.review_storage(files(spark, sf_dir))


@query(f"""WITH {FILES} SELECT kind, count(*) FILTER (WHERE home) AS organised, count(*) FILTER (WHERE NOT home) AS moves, coalesce(sum(size) FILTER (WHERE NOT home), 0)::BIGINT AS move_bytes
FROM (SELECT *, starts_with(path, CASE kind WHEN 'picture' THEN 'src0/' ELSE 'src1/' END) AS home FROM files WHERE kind IN ('picture', 'video')) GROUP BY kind""")
def layout_readiness(spark, sf_dir):
    return inventory.layout_readiness(files(spark, sf_dir), {"picture": "src0", "video": "src1"})


@query(f"WITH {FILES} SELECT kind, size, count(*) AS files, size * (count(*) - 1) AS upper_bound FROM files WHERE kind IN ('picture', 'video') AND NOT in_review GROUP BY 1, 2 HAVING count(*) > 1")
def same_size_candidates(spark, sf_dir):
    return inventory.same_size_candidates(files(spark, sf_dir))


@query(f"WITH {FILES} SELECT kind, size, sha256, count(*) AS files, min(path) AS first_path, size * (count(*) - 1) AS duplicate_bytes FROM files WHERE kind IN ('picture', 'video') AND NOT in_review GROUP BY 1, 2, 3 HAVING count(*) > 1")
def exact_byte_duplicates(spark, sf_dir):
    return inventory.exact_duplicates(files(spark, sf_dir))


RANKED = """ranked AS (
  SELECT size, sha256, path, modified_ns, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY size, sha256 ORDER BY size DESC, modified_ns, lower(path), path)::INTEGER AS rank
  FROM files WINDOW w AS (PARTITION BY size, sha256) QUALIFY group_size > 1
)"""


@query(f"WITH {FILES}, {RANKED} SELECT size, sha256, path, group_size, rank FROM ranked")
def keeper_ranking(spark, sf_dir):
    return duplicates.ranked(files(spark, sf_dir), ascii_paths=True).select("size", "sha256", "path", "group_size", "rank")


@query(f"""WITH {FILES}, {RANKED}, g AS (
  SELECT size, sha256, max(path) FILTER (WHERE rank = 1) AS kept, row_number() OVER (ORDER BY min(path))::INTEGER AS group_no FROM ranked GROUP BY 1, 2
)
SELECT r.path AS source, 'dups/set_' || lpad(group_no::VARCHAR, 4, '0') || '/' || regexp_replace(string_split(kept, '/')[-1], '\\.[^.]*$', '') || '_copy(' || (rank - 1) || ')' || regexp_extract(r.path, '(\\.[^./]+)$', 1) AS target,
  group_no, (rank - 1)::INTEGER AS copy_no, kept FROM ranked r JOIN g USING (size, sha256) WHERE rank > 1""")
def duplicate_move_plan(spark, sf_dir):
    return duplicates.move_plan(files(spark, sf_dir), ascii_paths=True)


@query(f"""WITH {FILES}, g AS (SELECT size, count(*) AS n FROM files GROUP BY size, sha256)
SELECT sum(n)::BIGINT AS files, count(*) AS retained, sum(n - 1)::BIGINT AS duplicates, sum(size * (n - 1))::BIGINT AS duplicate_bytes, sum(size * n)::BIGINT AS scanned_bytes, round(100.0 * sum(size * (n - 1))::DOUBLE / sum(size * n)::DOUBLE, 6)::DOUBLE AS scan_percent FROM g""")
def storage_summary(spark, sf_dir):
    return inventory.storage_summary(files(spark, sf_dir))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Source: documents without a label; destination: those with one. Contents are digested after the choice, each once."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    return tuple(inventory.collection(docs.join(labels, "doc_id", how)) for how in ("left_anti", "left_semi"))


SIDES = f"""{FILES}, src AS (SELECT * FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels)), dst AS (SELECT * FROM files WHERE doc_id IN (SELECT doc_id FROM labels)),
s AS (SELECT size, sha256, count(*) AS sn FROM src GROUP BY 1, 2), d AS (SELECT size, sha256, count(*) AS dn FROM dst GROUP BY 1, 2), j AS (SELECT size, sha256, sn, dn FROM s FULL JOIN d USING (size, sha256))"""
COVERAGE = """SELECT count(sn) AS source_unique, count(*) FILTER (WHERE sn IS NOT NULL AND dn IS NOT NULL) AS represented, count(*) FILTER (WHERE dn IS NULL) AS missing, count(*) FILTER (WHERE sn IS NULL) AS destination_only,
  coalesce(sum(size) FILTER (WHERE sn IS NOT NULL), 0)::BIGINT AS source_bytes, coalesce(sum(size) FILTER (WHERE dn IS NULL), 0)::BIGINT AS missing_bytes,
  coalesce(sum(greatest(sn - dn, 0)) FILTER (WHERE sn IS NOT NULL AND dn IS NOT NULL), 0)::BIGINT AS reduced, coalesce(sum(greatest(dn - sn, 0)) FILTER (WHERE sn IS NOT NULL AND dn IS NOT NULL), 0)::BIGINT AS added,
  coalesce(sum(sn - 1), 0)::BIGINT AS source_duplicate_copies, coalesce(sum(size * (sn - 1)), 0)::BIGINT AS source_duplicate_bytes,
  round(CASE WHEN count(sn) = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * count(*) FILTER (WHERE sn IS NOT NULL AND dn IS NOT NULL) / count(sn) END, 6) AS coverage_percent,
  CASE WHEN count(*) FILTER (WHERE dn IS NULL) > 0 THEN 'incomplete' ELSE 'complete' END AS verdict FROM j"""


@query(f"WITH {SIDES} {COVERAGE}")
def byte_coverage(spark, sf_dir):
    return coverage.byte_coverage(*sides(spark, sf_dir))


@query(f"WITH {SIDES} SELECT path, size, sha256 FROM src WHERE (size, sha256) NOT IN (SELECT (size, sha256) FROM dst)")
def coverage_missing_files(spark, sf_dir):
    return coverage.missing_files(*sides(spark, sf_dir)).select("path", "size", "sha256")


@query(f"WITH {SIDES} SELECT path, size, sha256 FROM dst WHERE (size, sha256) NOT IN (SELECT (size, sha256) FROM src)")
def destination_only_files(spark, sf_dir):
    s, d = sides(spark, sf_dir)
    return coverage.missing_files(d, s).select("path", "size", "sha256")


@query(f"WITH {SIDES} SELECT size, sha256, sn AS source_n, dn AS destination_n, greatest(sn - dn, 0) AS reduced, greatest(dn - sn, 0) AS added FROM j WHERE sn <> dn")
def multiplicity(spark, sf_dir):
    return coverage.multiplicity(*sides(spark, sf_dir))


def layered_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two sides with a weaker digest (of the text without case and spacing) and a length bucket."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    more = {"weak": F.sha2(names.normalised(F.col("text")), 256), "bucket": F.floor(F.length("text") / 1000).cast("int")}
    return tuple(inventory.collection(docs.join(labels, "doc_id", how), more) for how in ("left_anti", "left_semi"))


WEAK = r"""sw AS (SELECT *, sha256(lower(trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g')))) AS weak, floor(length(text) / 1000)::INTEGER AS bucket FROM src),
dw AS (SELECT *, sha256(lower(trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g')))) AS weak, floor(length(text) / 1000)::INTEGER AS bucket FROM dst),
gone AS (SELECT DISTINCT size, sha256, weak, lang, bucket FROM sw WHERE (size, sha256) NOT IN (SELECT (size, sha256) FROM dst)),
found AS (SELECT size, sha256, bool_or(weak IN (SELECT weak FROM dw)) AS represented FROM gone GROUP BY 1, 2)"""


@query(f"WITH {SIDES}, {WEAK} SELECT * FROM found")
def second_layer_coverage(spark, sf_dir):
    return coverage.second_layer(*layered_sides(spark, sf_dir), "weak")


@query(f"""WITH {SIDES}, {WEAK} SELECT size, sha256, bool_or(hit) AS represented FROM (
  SELECT size, sha256, EXISTS (SELECT 1 FROM dw WHERE dw.weak = gone.weak AND dw.lang IS NOT DISTINCT FROM gone.lang AND dw.bucket IS NOT DISTINCT FROM gone.bucket) AS hit FROM gone) GROUP BY 1, 2""")
def bucketed_layer_coverage(spark, sf_dir):
    return coverage.second_layer(*layered_sides(spark, sf_dir), "weak", ("lang", "bucket"))


LAYERED = f"""WITH {SIDES}, {WEAK}, k AS (SELECT size, sha256, max(kind IN ('picture', 'video')) AS exact FROM src GROUP BY 1, 2), l AS (
  SELECT k.size, k.sha256, CASE WHEN dn IS NOT NULL THEN 'bytes' WHEN represented THEN 'weak' WHEN exact THEN 'missing' ELSE 'unsupported' END AS layer
  FROM k JOIN j USING (size, sha256) LEFT JOIN found USING (size, sha256))"""


@query(f"{LAYERED} SELECT * FROM l")
def layered_verdict(spark, sf_dir):
    return coverage.layered(*layered_sides(spark, sf_dir), [("weak", ())])


@query(f"""{LAYERED} SELECT count(*) AS identities, count(*) FILTER (WHERE layer = 'bytes') AS by_bytes, count(*) FILTER (WHERE layer = 'missing') AS missing, count(*) FILTER (WHERE layer = 'unsupported') AS unsupported,
  count(*) FILTER (WHERE layer = 'weak') AS by_other_layers, CASE WHEN count(*) FILTER (WHERE layer = 'unsupported') > 0 THEN 'unproven' WHEN count(*) FILTER (WHERE layer = 'missing') > 0 THEN 'incomplete' ELSE 'complete' END AS verdict FROM l""")
def preservation_report(spark, sf_dir):
    return coverage.verdict(coverage.layered(*layered_sides(spark, sf_dir), [("weak", ())]))


@query(f"WITH {SIDES.replace('IN (SELECT doc_id FROM labels)), s AS', 'IN (SELECT doc_id FROM labels)), s AS').replace('dst AS (SELECT * FROM files WHERE doc_id IN (SELECT doc_id FROM labels))', 'dst AS (SELECT * FROM files WHERE doc_id IN (SELECT doc_id FROM labels) AND NOT in_review)')} {COVERAGE}")
def simulate_without_review(spark, sf_dir):
    s, d = sides(spark, sf_dir)
    return coverage.byte_coverage(s, d.filter("not in_review"))


@query("""WITH a AS (SELECT o_orderkey::VARCHAR AS path, o_orderstatus AS s, o_totalprice AS p FROM orders),
b AS (SELECT path, s, CASE WHEN path::BIGINT % 97 = 0 THEN p + 1 ELSE p END AS p FROM a WHERE path::BIGINT % 101 <> 0 UNION ALL SELECT '+' || path, s, p FROM a WHERE path::BIGINT % 103 = 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'appeared' WHEN b.path IS NULL THEN 'missing' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p""")
def stability_diff(spark, sf_dir):
    key = F.col("path").cast("long")
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    b = a.filter(key % 101 != 0).withColumn("p", F.when(key % 97 == 0, F.col("p") + 1).otherwise(F.col("p")))
    b = b.unionByName(a.filter(key % 103 == 0).withColumn("path", F.concat(F.lit("+"), "path")))
    return coverage.stability(a, b, ("s", "p"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence derived from every document, in three versions of two runtimes."""
    f = files(spark, sf_dir)
    version = F.when(F.col("doc_id") % 3 == 0, "v2").otherwise("v1")
    return f.select(F.col("sha256").alias("file_sha256"), F.lit("exact-pixels").alias("evidence_type"), version.alias("algorithm"), F.when(F.col("doc_id") % 5 == 0, "r0").otherwise("r1").alias("runtime"), F.concat(F.lit('{"size":'), F.col("size").cast("string"), F.lit("}")).alias("payload_json"))


STORE = """store AS (SELECT sha256 AS file_sha256, 'exact-pixels' AS evidence_type, CASE WHEN doc_id % 3 = 0 THEN 'v2' ELSE 'v1' END AS algorithm, CASE WHEN doc_id % 5 = 0 THEN 'r0' ELSE 'r1' END AS runtime, '{"size":' || size || '}' AS payload_json FROM files)"""


@query(f"WITH {FILES}, {STORE}, m AS (SELECT file_sha256, max(payload_json) AS payload_json FROM store WHERE algorithm = 'v2' AND runtime = 'r1' GROUP BY 1) SELECT path, sha256, payload_json FROM files LEFT JOIN m ON sha256 = file_sha256")
def evidence_memo_join(spark, sf_dir):
    return evidence.memo_join(files(spark, sf_dir), store(spark, sf_dir), "exact-pixels", "v2", "r1").select("path", "sha256", "payload_json")


@query(f"""WITH {FILES}, {STORE}, seen AS (SELECT sha256 FROM files WHERE doc_id % 5 <> 0), fresh AS (SELECT sha256 FROM files WHERE doc_id % 5 <> 0 AND doc_id % 4 <> 0)
SELECT evidence_type, count(*) AS records, count(DISTINCT (algorithm, runtime)) AS namespaces, count(*) FILTER (WHERE file_sha256 IN (SELECT sha256 FROM seen)) AS linked, count(*) FILTER (WHERE file_sha256 NOT IN (SELECT sha256 FROM seen)) AS unlinked,
  count(*) FILTER (WHERE file_sha256 IN (SELECT sha256 FROM fresh)) AS current FROM store GROUP BY 1""")
def evidence_status(spark, sf_dir):
    f = files(spark, sf_dir)
    state = f.select("doc_id", "path", "sha256", F.lit(1).alias("device"), F.col("doc_id").alias("inode"), "size", "modified_ns", F.col("modified_ns").alias("changed_ns"))
    seen = state.filter("doc_id % 5 <> 0").withColumnsRenamed({"path": "relative_path", "sha256": "byte_sha256"})
    now = state.withColumn("changed_ns", F.when(F.col("doc_id") % 4 == 0, F.col("changed_ns") + 1).otherwise(F.col("changed_ns"))).drop("doc_id", "sha256")
    return evidence.status(store(spark, sf_dir), seen, now)


@query(f"""WITH {FILES}, {STORE}, u AS (SELECT *, 1 AS version FROM store UNION ALL SELECT file_sha256, evidence_type, algorithm, runtime, '{{"again":true}}', 2 FROM store WHERE file_sha256 < '8')
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY file_sha256, evidence_type, algorithm, runtime ORDER BY version DESC, payload_json DESC) = 1""")
def evidence_upsert(spark, sf_dir):
    old = store(spark, sf_dir).withColumn("version", F.lit(1))
    new = store(spark, sf_dir).filter("file_sha256 < '8'").withColumn("payload_json", F.lit('{"again":true}')).withColumn("version", F.lit(2))
    return evidence.upsert(old, new, "version")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    path = F.col("doc_id").cast("string").alias("path")
    one = labels.filter("toxic = 1").select(path, F.lit("error").alias("severity"), F.lit("toxic").alias("code"))
    two = labels.filter("quality = 0").select(path, F.lit("warning").alias("severity"), F.lit("low-quality").alias("code"))
    three = table(spark, sf_dir, "documents").filter(F.col("n_chars") < 500).select(path, F.lit("info").alias("severity"), F.lit("short").alias("code"))
    return one.unionByName(two).unionByName(three)


FINDINGS = """f AS (SELECT doc_id::VARCHAR AS path, 'error' AS severity, 'toxic' AS code FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id::VARCHAR, 'warning', 'low-quality' FROM labels WHERE quality = 0
UNION ALL SELECT doc_id::VARCHAR, 'info', 'short' FROM documents WHERE n_chars < 500)"""


@query(f"WITH {FINDINGS} SELECT severity, code, count(*) AS findings, count(DISTINCT path) AS paths FROM f GROUP BY 1, 2")
def findings_rollup(spark, sf_dir):
    return journal.findings_rollup(findings(spark, sf_dir))


@query(f"WITH {FINDINGS} SELECT health, count(*) AS files FROM (SELECT path, CASE max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'healthy' END AS health FROM f GROUP BY path) GROUP BY 1")
def file_health(spark, sf_dir):
    return journal.file_health(findings(spark, sf_dir))


@query(f"WITH {FILES} SELECT coalesce(nullif(ext, ''), '(none)') AS ext, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY 1 ORDER BY files DESC, lower(coalesce(nullif(ext, ''), '(none)')) LIMIT 12")
def top_extensions(spark, sf_dir):
    return inventory.top_extensions(files(spark, sf_dir))


@query(r"""WITH p AS (SELECT page_id, url, lower(regexp_replace(url, '^[a-z]+://', '')) AS path FROM pages)
SELECT page_id, url, regexp_matches(string_split(path, '/')[-1], '^(.*1|.2.*)$') OR regexp_matches(path, '^(.*1|.2.*)$') OR len(list_filter(string_split(path, '/')[:-2], lambda x: regexp_matches(x, '^.*3.*$'))) > 0 AS ignored FROM p""")
def glob_ignore(spark, sf_dir):
    path = F.upper(F.regexp_replace("url", "^[a-z]+://", ""))
    return table(spark, sf_dir, "pages").select("page_id", "url", classification.ignored(path, ("*1", "?2*"), ("*3*",)).alias("ignored"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d_%H-%M-%S') END AS stamp FROM events""")
def timestamp_from_name(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bad = F.concat(F.lit("IMG_20231341_"), F.lit("250000.jpg"))
    name = F.when(F.col("event_id") % 5 == 0, bad).when(F.col("event_id") % 2 == 0, F.date_format("ts", "'IMG_'yyyyMMdd'_'HHmmss'.jpg'")).otherwise(F.date_format("ts", "'scan 'yyyy-MM-dd HH.mm.ss'.png'"))
    return e.select("event_id", names.timestamp_from_name(name).alias("stamp"))


@query(f"""WITH {FILES} SELECT kind, path, row_number() OVER (PARTITION BY kind ORDER BY doc_id % 4 = 0, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE modified_ns % 1000000007 END, lower(path), path)::INTEGER AS sequence FROM files""")
def rename_sequence(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("stamp", F.when(F.col("doc_id") % 4 != 0, F.col("modified_ns") % 1000000007))
    return duplicates.rename_sequence(f).select("kind", "path", "sequence")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a journal: a run per conversation, turns as sequence numbers; the role tells the event, every seventh fifth turn commits."""
    event = F.when(F.col("turn") == 0, "started").when((F.col("turn") == 4) & (F.col("conv_id") % 7 != 0), "committed").when(F.col("role") == "user", "planned").otherwise("completed")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), event.alias("event"))


RUNS = """e AS (SELECT conv_id AS run_id, turn AS seq, CASE WHEN turn = 0 THEN 'started' WHEN turn = 4 AND conv_id % 7 <> 0 THEN 'committed' WHEN role = 'user' THEN 'planned' ELSE 'completed' END AS event FROM conversations),
r AS (SELECT run_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) FILTER (WHERE event = 'planned') AS planned, count(*) FILTER (WHERE event = 'completed') AS completed,
  CASE WHEN count(*) FILTER (WHERE event = 'committed') > 0 THEN 'committed' ELSE 'open' END AS state, coalesce(max(seq) > max(seq) FILTER (WHERE event = 'committed'), false) AS malformed FROM e GROUP BY run_id)"""


@query(f"WITH {RUNS} SELECT * FROM r")
def run_fold(spark, sf_dir):
    return journal.run_fold(run_events(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    undo = F.col("run_id") % 3 == 2
    return journal.run_fold(run_events(spark, sf_dir)).withColumn("mode", F.when(undo, "undo").otherwise("apply")).withColumn("target_run_id", F.when(undo, F.col("run_id") - 1)).withColumn("tool", F.concat(F.lit("tool"), (F.col("run_id") % 4).cast("string")))


@query(f"WITH {RUNS} SELECT run_id, last_seq FROM r WHERE run_id % 3 <> 2 AND state = 'committed' AND run_id NOT IN (SELECT run_id - 1 FROM r WHERE run_id % 3 = 2 AND state = 'committed')")
def active_runs(spark, sf_dir):
    return journal.active_runs(runs(spark, sf_dir)).select("run_id", "last_seq")


@query(f"WITH {RUNS} SELECT 'tool' || (run_id % 4) AS tool, max(run_id) AS run_id, arg_max(state, run_id) AS state FROM r GROUP BY 1")
def latest_per_tool(spark, sf_dir):
    return journal.latest_per(runs(spark, sf_dir), "tool", "run_id", ("state",))


@query(r"""WITH a AS (SELECT event_id % 50 AS run_no, 'u' || (user_id % 40) || CASE WHEN event_id % 3 = 0 THEN '' ELSE '/' || event_type END AS path, event_id % 977 AS inode FROM events), t AS (SELECT * FROM a WHERE run_no = 30)
SELECT DISTINCT a.run_no FROM a JOIN t ON a.run_no > 30 AND (a.path = t.path OR starts_with(a.path, t.path || '/') OR starts_with(t.path, a.path || '/') OR a.inode = t.inode)""")
def later_blockers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("/"), "event_type")))
    return journal.later_blockers(e.select((F.col("event_id") % 50).alias("run_no"), path.alias("path"), (F.col("event_id") % 977).alias("inode")), 30)


@query("SELECT event_type AS stage, max(event_id) AS event_id, arg_max(CASE WHEN value < 10 THEN 1 ELSE 0 END, event_id) AS status FROM events GROUP BY 1")
def latest_outcome(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), "event_id", F.when(F.col("value") < 10, 1).otherwise(0).alias("status"))
    return journal.latest_per(e, "stage", "event_id", ("status",))


@query("""SELECT event_type AS stage, count(*) AS attempts, count(*) FILTER (WHERE value < 10) AS findings, sum(floor(value * 1000))::BIGINT AS duration_milliseconds, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def synopsis_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return journal.synopsis(e.select(F.col("event_type").alias("stage"), F.when(F.col("value") < 10, 1).otherwise(0).alias("status"), F.floor(F.col("value") * 1000).alias("milliseconds"), F.col("user_id").alias("subject")))


@query("""WITH o AS (SELECT lang AS checkpoint, count(*) AS files, count(DISTINCT source) AS sources FROM documents GROUP BY 1)
SELECT checkpoint, CASE WHEN checkpoint = 'es' THEN 'not-authorised' WHEN checkpoint = 'en' AND files > 0 THEN 'match' ELSE 'mismatch' END AS decision FROM o""")
def policy_match(spark, sf_dir):
    observed = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("checkpoint")).agg(F.count(F.lit(1)).alias("files"), F.countDistinct("source").alias("sources"))
    expected = observed.filter("checkpoint <> 'es'").withColumn("files", F.when(F.col("checkpoint") == "en", F.col("files")).otherwise(F.lit(-1)))
    return journal.policy_match(observed, expected, ("files", "sources"))


STAGES = ("preflight", "organise", "rename", "duplicates", "verify")


@query("""WITH s AS (SELECT * FROM (VALUES ('preflight', 1), ('organise', 2), ('rename', 3), ('duplicates', 4), ('verify', 5)) AS v(stage, stage_no))
SELECT n_nationkey AS ordinal, stage, stage_no, CASE WHEN (n_nationkey + stage_no) % 3 = 0 THEN 'allow' ELSE 'ask' END AS decision FROM nation, s""")
def queue_plan_expand(spark, sf_dir):
    jobs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"))
    allowed = jobs.select("ordinal", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(i + 1).alias("no")) for i, s in enumerate(STAGES)])).alias("x")).filter((F.col("ordinal") + F.col("x.no")) % 3 == 0).select("ordinal", "x.stage", F.lit("allow").alias("decision"))
    return journal.queue_expand(jobs, STAGES, allowed)


@query("""SELECT a.n_nationkey AS "outer", b.n_nationkey AS "inner" FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey AND (a.n_nationkey = b.n_nationkey // 2 OR a.n_nationkey = b.n_nationkey // 4)""")
def endpoint_overlap(spark, sf_dir):
    k = F.col("n_nationkey").cast("int")
    half, quarter = F.floor(k / 2).cast("int"), F.floor(k / 4).cast("int")
    e = table(spark, sf_dir, "nation").select(k.alias("ordinal"), k.alias("id"), F.array(k, half, quarter).alias("ancestry"))
    return journal.overlaps(e)


@query(f"WITH {FILES}, w AS (SELECT * FROM (VALUES ('.jpg'), ('.png'), ('.gif')) AS v(ext)) SELECT ext, 'missing' AS problem FROM (SELECT ext FROM w EXCEPT SELECT ext FROM files) UNION ALL SELECT ext, 'unexpected' FROM (SELECT ext FROM files EXCEPT SELECT ext FROM w)")
def extension_cover(spark, sf_dir):
    want = spark.createDataFrame([(".jpg",), (".png",), (".gif",)], "ext string")
    return journal.exact_cover(files(spark, sf_dir), want, "ext")


@query("""WITH l AS (SELECT doc_id AS ordinal, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS value FROM documents) SELECT lower(value) AS key, min(ordinal) AS ordinal, arg_min(value, ordinal) AS value FROM l GROUP BY 1""")
def config_layering(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return journal.layered_config(docs.select(F.col("doc_id").alias("ordinal"), F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("value")))


@query("""SELECT l_orderkey, l_linenumber, count(*) OVER w AS done, sum(l_quantity) OVER w AS done_size, count(*) OVER (PARTITION BY l_orderkey) AS total
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)""")
def progress_running(spark, sf_dir):
    return journal.progress(table(spark, sf_dir, "lineitem"), "l_orderkey", ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_quantity")


@query(f"WITH {FILES} SELECT source, count(*) AS files, sum(size)::BIGINT AS bytes, (sum((size + 4095) // 4096 * 4096) + 1048576)::BIGINT AS required FROM files GROUP BY 1")
def capacity_requirement(spark, sf_dir):
    return journal.capacity(files(spark, sf_dir), "source", 4096, 1 << 20)


@query(f"WITH {FILES} SELECT path AS source, CASE kind WHEN 'picture' THEN 'pics/' ELSE 'vids/' END || string_split(path, '/')[-1] AS target, kind FROM files WHERE kind IN ('picture', 'video')")
def organize_plan(spark, sf_dir):
    return planning.organize_plan(files(spark, sf_dir), {"picture": "pics", "video": "vids"})


@query(f"""WITH {FILES}, e AS (SELECT path, ext, CASE WHEN mime_type = 'unknown' THEN NULL WHEN doc_id % 13 = 0 THEN CASE ext WHEN '.jpg' THEN 'png' WHEN '.png' THEN 'jpeg' ELSE 'exotic' END
  ELSE CASE ext WHEN '.jpg' THEN 'jpeg' WHEN '.png' THEN 'png' WHEN '.mp4' THEN 'mp4' WHEN '.mkv' THEN 'matroska' ELSE 'exotic' END END AS format FROM files),
a AS (SELECT * FROM (VALUES ('jpeg', ['.jpg', '.jpeg']), ('png', ['.png']), ('mp4', ['.mp4', '.m4v']), ('matroska', ['.mkv'])) AS v(format, extensions)),
d AS (SELECT path, ext, extensions, CASE WHEN ext = '.mp3' THEN 'protected' WHEN format IS NULL THEN 'uninspectable' WHEN extensions IS NULL THEN 'unsupported' WHEN list_contains(extensions, ext) THEN 'truthful' ELSE 'rename' END AS decision FROM e LEFT JOIN a USING (format))
SELECT path, decision, CASE WHEN decision = 'rename' THEN path[:length(path) - length(ext)] || extensions[1] END AS target FROM d""")
def extension_plan(spark, sf_dir):
    f = files(spark, sf_dir)
    right = F.when(F.col("ext") == ".jpg", "jpeg").when(F.col("ext") == ".png", "png").when(F.col("ext") == ".mp4", "mp4").when(F.col("ext") == ".mkv", "matroska").otherwise("exotic")
    wrong = F.when(F.col("ext") == ".jpg", "png").when(F.col("ext") == ".png", "jpeg").otherwise("exotic")
    seen = f.select("path", F.when(F.col("mime_type") == "unknown", None).when(F.col("doc_id") % 13 == 0, wrong).otherwise(right).alias("format"))
    accepted = spark.createDataFrame([("jpeg", [".jpg", ".jpeg"]), ("png", [".png"]), ("mp4", [".mp4", ".m4v"]), ("matroska", [".mkv"])], "format string, extensions array<string>")
    return planning.extension_plan(f, seen, accepted, (".mp3",))


@query(f"""WITH {FILES}, {RANKED}, n AS (SELECT path || '>' || rank AS l, row_number() OVER (ORDER BY path) - 1 AS n FROM ranked WHERE rank > 1), c AS (SELECT n // 16 AS c, count(*) AS rows, sha256(string_agg(l, chr(10) ORDER BY n)) AS d FROM n GROUP BY 1)
SELECT coalesce(sum(rows), 0)::BIGINT AS rows, sha256(coalesce(string_agg(d, '' ORDER BY c), '')) AS digest FROM c""")
def plan_digest(spark, sf_dir):
    moves = duplicates.ranked(files(spark, sf_dir)).filter("rank > 1")
    return digest.plan_digest(moves, F.col("path"), F.concat("path", F.lit(">"), F.col("rank").cast("string")), 16)


@query(f"""WITH {FILES}, l AS (SELECT sha256(path || ':' || size || ':' || sha256) AS d FROM files), b AS (SELECT d[1:2] AS c, count(*) AS rows, sha256(string_agg(d, '' ORDER BY d)) AS d FROM l GROUP BY 1)
SELECT sum(rows)::BIGINT AS rows, sha256(string_agg(d, '' ORDER BY c)) AS digest FROM b""")
def namespace_digest(spark, sf_dir):
    return digest.set_digest(files(spark, sf_dir), F.concat_ws(":", "path", F.col("size").cast("string"), "sha256"), 8)


@query(f"""WITH {FILES}, m AS (SELECT path, CASE WHEN doc_id % 9 = 0 THEN 'video/mp4' WHEN doc_id % 10 = 0 THEN 'application/pdf' ELSE mime_type END AS mime, doc_id % 4 <> 0 AS content, ext, CASE WHEN ext IN ('.jpg', '.png') THEN 'picture' WHEN ext IN ('.mp4', '.mkv') THEN 'video' END AS ek FROM files),
k AS (SELECT *, CASE WHEN NOT content AND ek IS NOT NULL THEN ek WHEN starts_with(mime, 'image/') THEN 'picture' WHEN starts_with(mime, 'video/') THEN 'video' WHEN mime IN ('text/plain', 'unknown') THEN coalesce(ek, 'other') ELSE 'other' END AS kind FROM m)
SELECT CASE WHEN starts_with(mime, 'audio/') THEN 'audio' WHEN kind = 'other' AND mime = 'unknown' THEN 'unknown' ELSE kind END AS kind, ek IS NOT NULL AND ek <> kind AS mismatched, count(*) AS files FROM k GROUP BY 1, 2""")
def classification_kinds(spark, sf_dir):
    f = files(spark, sf_dir)
    mime = F.when(F.col("doc_id") % 9 == 0, "video/mp4").when(F.col("doc_id") % 10 == 0, "application/pdf").otherwise(F.col("mime_type"))
    kind = classification.classify(mime, F.col("doc_id") % 4 != 0, F.col("ext"))
    rows = f.select(classification.scan_kind(kind, mime).alias("kind"), classification.mismatched(kind, F.col("ext")).alias("mismatched"))
    return rows.groupBy("kind", "mismatched").agg(F.count(F.lit(1)).alias("files"))


ACTIONS = """acts AS (SELECT doc_id AS action_id, path AS before, 'moved/' || doc_id AS after, sha256 FROM files),
snap AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'moved/' || doc_id ELSE path END AS path, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE sha256 END AS sha256 FROM files)"""


@query(f"""WITH {FILES}, {ACTIONS} SELECT action_id, before, after, CASE WHEN b.sha256 IS NULL AND a.sha256 = acts.sha256 THEN 'applied' WHEN a.sha256 IS NULL AND b.sha256 = acts.sha256 THEN 'unapplied' ELSE 'conflict' END AS state
FROM acts LEFT JOIN snap b ON b.path = before LEFT JOIN snap a ON a.path = after""")
def forward_state(spark, sf_dir):
    f = files(spark, sf_dir)
    there = F.concat(F.lit("moved/"), F.col("doc_id").cast("string"))
    actions = f.select(F.col("doc_id").alias("action_id"), F.col("path").alias("before"), there.alias("after"), "sha256")
    snapshot = f.select(F.when(F.col("doc_id") % 3 == 0, there).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return transitions.forward_state(actions, snapshot)


@query(f"WITH {FILES} SELECT CASE WHEN kind = 'picture' THEN 'pics/' || string_split(path, '/')[-1] ELSE path END AS path, path AS origin, kind FROM files")
def namespace_move(spark, sf_dir):
    f = files(spark, sf_dir).select("path", "kind")
    moves = f.filter("kind = 'picture'").select(F.col("path").alias("source"), F.concat(F.lit("pics/"), F.element_at(F.split("path", "/"), -1)).alias("target"))
    return transitions.moved(f, moves)


@query(f"""WITH {FILES}, e AS (SELECT source AS f1, source || '/' || lang AS f2, ext = '.txt' OR (source = 'src3') OR (lang = 'es' AND source IN ('src5', 'src6')) AS ig FROM files),
u AS (SELECT f1 AS folder, ig FROM e UNION ALL SELECT f2, ig FROM e) SELECT folder, count(*) AS files FROM u GROUP BY folder HAVING bool_and(ig)""")
def removable_folders(spark, sf_dir):
    ignored = (F.col("ext") == ".txt") | (F.col("source") == "src3") | ((F.col("lang") == "es") & F.col("source").isin("src5", "src6"))
    return transitions.removable_folders(files(spark, sf_dir).select("path", ignored.alias("is_ignored")))


@query("""WITH p AS (SELECT o_custkey AS id, count(*) AS p FROM orders GROUP BY 1), c AS (SELECT c_custkey AS id, count(*) AS c FROM customer GROUP BY 1)
SELECT id, CASE WHEN c IS NULL THEN 'not-completed' WHEN p IS NULL THEN 'not-planned' ELSE 'repeated' END AS problem FROM p FULL JOIN c USING (id) WHERE c IS NULL OR p IS NULL OR p > 1 OR c > 1""")
def exact_ids(spark, sf_dir):
    planned = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return transitions.exact_ids(planned, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as workflows: a turn is an attempt of the stage reached, assistants advance; some skip a stage."""
    c = table(spark, sf_dir, "conversations")
    stage = F.floor(F.col("turn") / 2) + F.when((F.col("conv_id") % 11 == 0) & (F.col("turn") > 3), 1).otherwise(0)
    return c.select(F.col("conv_id").alias("workflow"), F.col("turn").alias("seq"), stage.cast("int").alias("stage"), (F.col("role") == "assistant").alias("advance"), F.when(F.col("role") == "user", 1).otherwise(0).alias("exit_status"))


ATTEMPTS = "a AS (SELECT conv_id AS workflow, turn AS seq, (turn // 2 + CASE WHEN conv_id % 11 = 0 AND turn > 3 THEN 1 ELSE 0 END)::INTEGER AS stage, role = 'assistant' AS advance, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS exit_status FROM conversations)"


@query(f"""WITH {ATTEMPTS}, x AS (SELECT *, coalesce(sum(advance::INTEGER) OVER (PARTITION BY workflow ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS expected, coalesce(lag(seq) OVER (PARTITION BY workflow ORDER BY seq) + 1, 0) AS want FROM a)
SELECT workflow, seq, stage, expected, CASE WHEN seq <> want THEN 'sequence' ELSE 'stage' END AS error FROM x WHERE seq <> want OR stage <> expected""")
def attempt_errors(spark, sf_dir):
    return transitions.attempt_errors(attempts(spark, sf_dir))


@query(f"""WITH {ATTEMPTS} SELECT workflow, count(*) AS attempts, sum(advance::INTEGER)::BIGINT AS reached, CASE WHEN sum(advance::INTEGER) >= 3 THEN 'complete' WHEN arg_max(exit_status, seq) <> 0 THEN 'stopped' ELSE 'pending' END AS status FROM a GROUP BY 1""")
def workflow_status(spark, sf_dir):
    return transitions.workflow_status(attempts(spark, sf_dir), 3)


@query(f"""WITH {FILES}, g AS (SELECT source, size, sha256, count(*) AS n FROM files GROUP BY 1, 2, 3), d AS (SELECT source, count(*) FILTER (WHERE n > 1) AS groups, sum(n - 1) AS extra, sum(size * (n - 1)) AS dup FROM g GROUP BY 1),
o AS (SELECT source AS run, count(*) AS files, count(*) FILTER (WHERE kind = 'picture') AS p, count(*) FILTER (WHERE kind = 'video') AS v, sum(size) AS bytes FROM files GROUP BY 1)
SELECT run, CASE WHEN run = 'src2' THEN 'media-sum' ELSE 'duplicate-bytes' END AS problem FROM o JOIN d ON d.source = o.run WHERE run IN ('src2', 'src4')""")
def outcome_problems(spark, sf_dir):
    f = files(spark, sf_dir)
    one = f.groupBy(F.col("source").alias("run")).agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("kind") == "picture", 1)).alias("pictures"), F.count(F.when(F.col("kind") == "video", 1)).alias("videos"), F.sum("size").alias("scanned_bytes"))
    dup = f.groupBy(F.col("source").alias("run"), "size", "sha256").agg(F.count(F.lit(1)).alias("n")).groupBy("run").agg(F.count(F.when(F.col("n") > 1, 1)).alias("groups"), F.sum(F.col("n") - 1).alias("extra_copies"), F.sum(F.col("size") * (F.col("n") - 1)).alias("duplicate_bytes"))
    out = one.join(dup, "run").withColumn("other", F.col("files") - F.col("pictures") - F.col("videos"))
    out = out.withColumn("media", F.col("pictures") + F.col("videos") + F.when(F.col("run") == "src2", 1).otherwise(0))
    return transitions.outcome_problems(out.withColumn("scanned_bytes", F.when(F.col("run") == "src4", -1).otherwise(F.col("scanned_bytes"))))


@query(f"""WITH {FILES}, s AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN source || '/home__' || CASE kind WHEN 'picture' THEN 'image' ELSE 'video' END || '_' || lpad((doc_id + 5000)::VARCHAR, 5, '0') || '__undated' || ext ELSE path END AS named,
  CASE WHEN doc_id % 4 <> 0 THEN modified_ns % 1000000007 END AS stamp FROM files WHERE kind IN ('picture', 'video')),
m AS (SELECT kind, max(CASE WHEN doc_id % 10 = 0 THEN doc_id + 5000 ELSE 0 END) AS top FROM s GROUP BY 1),
r AS (SELECT s.*, row_number() OVER (PARTITION BY kind ORDER BY stamp IS NULL, stamp, lower(named), named) + top AS n FROM s JOIN m USING (kind) WHERE doc_id % 10 <> 0)
SELECT named AS source, regexp_extract(named, '^(.*/)', 1) || 'home__' || CASE kind WHEN 'picture' THEN 'image' ELSE 'video' END || '_' || CASE WHEN n > 9999 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 4, '0') END || '__' || coalesce(stamp::VARCHAR, 'undated') || CASE WHEN doc_id % 6 = 0 THEN '__' || lang ELSE '' END || ext AS target, n AS sequence FROM r""")
def rename_plan(spark, sf_dir):
    d = F.col("doc_id")
    word = F.when(F.col("kind") == "picture", "image").otherwise("video")
    number = F.format_string("%05d", d + 5000)  # at least five digits: lpad would cut longer numbers
    named = F.concat("source", F.lit("/home__"), word, F.lit("_"), number, F.lit("__undated"), "ext")
    f = files(spark, sf_dir).withColumns({"path": F.when(d % 10 == 0, named).otherwise(F.col("path")), "stamp": F.when(d % 4 != 0, F.col("modified_ns") % 1000000007), "descriptor": F.when(d % 6 == 0, F.col("lang"))})
    return planning.rename_plan(f, "home")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)) / 1000000, 3) AS revenue_millions FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def extra_pricing_summary(spark, sf_dir):
    """Beyond the collection operators: a plain star-schema aggregate."""
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000000, 3).alias("revenue_millions"))


@query("""SELECT n_name, count(*) AS orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1""")
def extra_orders_by_nation(spark, sf_dir):
    """Beyond the collection operators: a plain star-schema join."""
    t = lambda n: table(spark, sf_dir, n)
    geo = t("nation").join(t("region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"))


def _registered() -> None:
    """The other modules register their queries when they are imported; they import this one."""
    from veritree import catalogue_media, catalogue_plans, catalogue_trees  # noqa: F401


def queries() -> dict[str, Query]:
    _registered()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _registered()
    return dict(_sql)
