import hashlib

import pytest
from pyspark.sql import functions as F

from veritree.functions import text
from veritree.operators import classification, coverage, duplicates, evidence, inventory, journal, transitions
from veritree.plans import digest
from veritree.sinks import store
from veritree.sources import tree
from veritree.streaming import journal as stream


def files(spark, rows):
    return spark.createDataFrame([(p, len(c), hashlib.sha256(c).hexdigest(), "picture") for p, c in rows], "path string, size long, sha256 string, kind string")


def test_byte_coverage_counts_multiplicity(spark):
    src = files(spark, [("a", b"same"), ("b", b"same"), ("c", b"unique")])
    dst = files(spark, [("x", b"same"), ("y", b"additional")])
    r = coverage.byte_coverage(src, dst).first()
    assert (r.source_unique, r.represented, r.missing, r.destination_only, r.reduced, r.added) == (2, 1, 1, 1, 1, 0)
    assert (r.source_duplicate_copies, r.source_duplicate_bytes, r.coverage_percent, r.verdict) == (1, 4, 50.0, "incomplete")


def test_byte_coverage_verdicts(spark):
    one, none = files(spark, [("a", b"x")]), files(spark, [])
    assert coverage.byte_coverage(none, one).first().coverage_percent == 100.0
    assert coverage.byte_coverage(one, one).first().verdict == "complete"
    assert coverage.byte_coverage(one, none, destination_complete=False).first().verdict == "unproven"
    assert coverage.byte_coverage(one, one, destination_complete=False).first().verdict == "complete"
    assert coverage.byte_coverage(one, one, source_complete=False).first().verdict == "unproven"


def test_null_bucket_values_are_equal(spark):
    schema = "path string, size long, sha256 string, weak string, rate int"
    src = spark.createDataFrame([("a", 1, "s1", "w", None), ("b", 1, "s2", "w", 5), ("c", 1, "s3", None, None)], schema)
    dst = spark.createDataFrame([("x", 2, "d1", "w", None), ("y", 2, "d2", None, None)], schema)
    got = {r.sha256: r.represented for r in coverage.second_layer(src, dst, "weak", ("rate",)).collect()}
    assert got == {"s1": True, "s2": False, "s3": False}
    # an identity with copies in two buckets is found by any of them
    src = spark.createDataFrame([("a", 1, "s", "d1", 9), ("b", 1, "s", "d2", 1)], schema)
    dst = spark.createDataFrame([("x", 2, "d", "d1", 9)], schema)
    assert [r.represented for r in coverage.second_layer(src, dst, "weak", ("rate",)).collect()] == [True]


def test_stability(spark):
    a = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "path string, m int")
    b = spark.createDataFrame([("b", 2), ("c", None), ("d", 1)], "path string, m int")
    assert {tuple(r) for r in coverage.stability(a, b, ("m",)).collect()} == {("a", "missing"), ("b", "changed"), ("d", "appeared")}


def test_keeper_order_is_case_blind(spark):
    rows = [("B", 5), ("a", 5), ("straße", 4), ("STRASSE", 4)]
    df = spark.createDataFrame([(p, 1, "s", m) for p, m in rows], "path string, size long, sha256 string, modified_ns long")
    assert [r.path for r in duplicates.ranked(df).orderBy("rank").collect()] == ["STRASSE", "straße", "a", "B"]


def test_group_numbers_are_gapless(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("p"))
    got = duplicates.group_numbers(df, "p").orderBy("p").collect()
    assert [r.group_no for r in got] == list(range(1, 1001))


def test_numbered_targets_take_the_first_free_name(spark):
    plan = spark.createDataFrame([("1", "x", ".jpg"), ("2", "X", ".jpg"), ("3", "x", ".jpg")], "source string, name string, ext string")
    taken = spark.createDataFrame([("x (1).jpg",)], "path string")
    got = {r.source: r.target for r in duplicates.numbered_targets(plan, taken).collect()}
    assert got == {"1": "x.jpg", "2": "X (2).jpg", "3": "x (3).jpg"}


def test_evidence_ignores_other_versions_and_repeats(spark):
    f = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", None)], "path string, sha256 string")
    schema = "file_sha256 string, evidence_type string, algorithm string, runtime string, payload_json string"
    e = spark.createDataFrame([("h1", "t", "v1", "r", "{}"), ("h2", "t", "v2", "r", "{}"), ("h2", "t", "v2", "r", "{}")], schema)
    assert {r.path: r.payload_json for r in evidence.memo_join(f, e, "t", "v2", "r").collect()} == {"a": None, "b": "{}", "c": None}
    good = "a" * 64
    v = spark.createDataFrame([(good, "t", "v", "r", '{"a":1}'), (good, "t", "v", "r", '{"a":1,"a":2}'), (good, "t", "v", "r", "[1]"), ("x", "t", "v", "r", "{}")], schema)
    assert evidence.valid(v).count() == 1


def test_run_fold_marks_events_after_the_end(spark):
    events = [("r1", 0, "started"), ("r1", 1, "planned"), ("r1", 2, "completed"), ("r1", 3, "committed"), ("r2", 0, "started"), ("r2", 1, "incomplete"), ("r2", 2, "planned"), ("r3", 0, "started")]
    got = {r.run_id: (r.planned, r.completed, r.state, r.malformed) for r in journal.run_fold(spark.createDataFrame(events, "run_id string, seq long, event string")).collect()}
    assert got == {"r1": (1, 1, "committed", False), "r2": (1, 0, "incomplete", True), "r3": (0, 0, "open", False)}


def test_later_blockers_by_prefix_and_inode(spark):
    rows = [(1, "a/b", 1), (2, "a/b/c", 9), (3, "a", 9), (4, "a/bc", 9), (5, "z", 1), (0, "a/b", 1)]
    assert {r.run_no for r in journal.later_blockers(spark.createDataFrame(rows, "run_no int, path string, inode long"), 1).collect()} == {2, 3, 5}


def test_health_takes_the_worst(spark):
    rows = [("a", "error", "x"), ("a", "warning", "y"), ("b", "warning", "y"), ("c", "info", "z")]
    assert {tuple(r) for r in journal.file_health(spark.createDataFrame(rows, "path string, severity string, code string")).collect()} == {("error", 1), ("warning", 1), ("healthy", 1)}


def test_names(spark):
    names = {
        "IMG_20230102_030405.jpg": "2023-01-02_03-04-05",
        "vid_20230102_030405_678_1.mp4": "2023-01-02_03-04-05-678",
        "photo_2023-01-02_03-04-05.jpg": "2023-01-02_03-04-05",
        "x 2023-01-02 03.04.05-123.png": "2023-01-02_03-04-05-123",
        "2023_01_02_03_04_05": "2023-01-02_03-04-05",
        "on 2023-01-02 at noon": "2023-01-02",
        "IMG_20231341_000000 2023-01-02": None,
        "2023-01-02-03": None,
        "plain.jpg": None,
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(text.timestamp_from_name(F.col("n"))).collect()] == list(names.values())
    stems = {"IMG_20230102_030405 Été plage copy 1080p": "ete_plage", "homemovie cat 640x480 deadbeef x a1b2": "movie_cat", "12 34": None, "one two three four five six seven": "one_two_three_four_five_six"}
    df = spark.createDataFrame([(n,) for n in stems], "n string")
    assert [r[0] for r in df.select(text.descriptors(F.col("n"), "home", ("copy",))).collect()] == list(stems.values())
    assert text.slug("Été à la Plage!") == "ete_a_la_plage" and text.slug("日本") == "collection"
    values = spark.createDataFrame([("0.0000005",), ("1.5",), ("N/A",), (None,)], "v string")
    assert [r[0] for r in values.select(text.decimal_microseconds(F.col("v"), 0)).collect()] == [1, 1500000, 0, 0]
    ext = spark.createDataFrame([("a/b.JPG",), ("a.d/b",), ("a/.hidden",)], "p string")
    assert [r[0] for r in ext.select(inventory.extension(F.col("p"))).collect()] == [".jpg", "", ""]


def test_digests_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("x"))
    for f in (lambda d: digest.plan_digest(d, F.col("x"), F.col("x")), lambda d: digest.set_digest(d, F.col("x"))):
        assert f(df.repartition(7)).collect() == f(df.repartition(3, "x")).collect()


def test_tree_source(spark, tmp_path):
    (tmp_path / "pics").mkdir()
    (tmp_path / "pics" / "a.png").write_bytes(b"abc")
    (tmp_path / "top.txt").write_bytes(b"")
    (tmp_path / "link").symlink_to("top.txt")
    tree.register(spark)
    got = {r.path: r for r in spark.read.format("tree").option("checksums", "true").load(str(tmp_path)).collect()}
    assert {p: r.category for p, r in got.items()} == {"pics": "directory", "pics/a.png": "file", "top.txt": "file", "link": "symbolic_link"}
    assert got["pics/a.png"].sha256 == hashlib.sha256(b"abc").hexdigest() and got["pics/a.png"].size == 3


def test_streaming_fold_equals_batch_fold(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    events = [("r1", 0, "started"), ("r1", 1, "planned"), ("r2", 0, "started"), ("r1", 2, "committed"), ("r2", 1, "committed"), ("r2", 2, "planned")]
    frame = spark.createDataFrame(events, "run_id string, seq long, event string")
    frame.coalesce(1).write.mode("overwrite").json(str(source))
    q = stream.run_states(stream.read_journal(spark, str(source))).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.run_id: (r.planned, r.state, r.malformed) for r in spark.table("states").collect()}
    assert got == {r.run_id: (r.planned, r.state, r.malformed) for r in journal.run_fold(frame).collect()}


def test_ignore_rules_reach_below_folders(spark):
    paths = ["a/.DS_Store", "a/b.txt", "Cache/x/y.png", "keep/cache.png", "Icon\r", "dups", "dups/pics/a.png"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [tuple(r) for r in df.select(classification.ignored(F.col("path"), (".ds_store", "icon\r"), ("cache",)), classification.in_review(F.col("path"))).collect()]
    assert [g[0] for g in got] == [True, False, True, False, True, False, False]
    assert [g[1] for g in got] == [False] * 6 + [True]


def test_relative_paths_and_canonical_names(spark):
    df = spark.createDataFrame([(p,) for p in ("a/b", "", "/a", "a//b", "a/../b", "a\x00", None)], "p string")
    assert [r[0] for r in df.select(classification.relative_path_ok(F.col("p"))).collect()] == [True] + [False] * 6
    n = spark.createDataFrame([("HOME__image_0012__undated.jpg",), ("home__video_0003__x.mp4",)], "n string")
    assert [r[0] for r in n.select(classification.canonical_number(F.col("n"), "home", "image")).collect()] == [12, None]


def test_simulated_replay(spark):
    entries = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "run_id long, path string")
    actions = spark.createDataFrame([(1, 0, "a", "c"), (1, 1, "b", "a"), (1, 2, "c", "a"), (2, 0, "x", "y"), (3, 0, "p", "q")], "run_id long, seq long, before string, after string")
    assert {tuple(r) for r in transitions.simulate(actions, entries).collect()} == {(1, 2, "occupied"), (2, 0, "missing"), (3, 0, "missing")}


def test_store_publishes_whole_versions(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "file_sha256 string, evidence_type string, algorithm string, runtime string, payload_json string"
    rows = lambda *p: spark.createDataFrame([("a" * 64, "t", "v", "r", p[0]), ("b" * 64, "t", "v", "r", p[-1])], schema)
    assert store.read(spark, path).count() == 0
    assert store.publish(spark, path, rows('{"n":1}')) == 1
    assert store.publish(spark, path, rows('{"n":2}').limit(1)) == 2
    got = {r.file_sha256[0]: r.payload_json for r in store.payloads(spark, path, "t", "v", "r").collect()}
    assert sorted(got.values()) == ['{"n":1}', '{"n":2}'] and store.read(spark, path, 1).count() == 2
    with pytest.raises(ValueError):
        store.publish(spark, path, rows("[]"))
    assert store.read(spark, path).select("version").distinct().count() == 2


def test_media_numbers(spark):
    df = spark.createDataFrame([("90.5", 59), ("-90", 61), ("45", 3700), ("x", 90000)], "r string, s long")
    got = [tuple(x) for x in df.select(text.rotation(F.col("r")), text.format_duration(F.col("s"))).collect()]
    assert got == [(90, "59s"), (270, "1m 1s"), (None, "1h 1m"), (None, "1d 1h")]
