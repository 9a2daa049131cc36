import json
import os
import random

import pytest
from pyspark.sql import functions as F

from veritree.functions import text
from veritree.operators import duplicates, journal, media, planning, validation
from veritree.plans.ordering import numbered
from veritree.plans.shared import scratch, shared_dir, written
from veritree.sinks import files, store
from veritree.sources import records, tree


def test_folding_and_slugs_follow_unicode(spark):
    chars = [chr(i) for i in range(1, 0x1F000) if not 0xD800 <= i < 0xE000 and chr(i).isprintable()]
    names = ["a" + "".join(chars[k : k + 7]) + "Z é" for k in range(0, len(chars), 7)]
    df = spark.createDataFrame([(n,) for n in names], "n string").repartition(4)
    got = {r.n: (r.f, r.s) for r in df.select("n", duplicates.folded(F.col("n")).alias("f"), text.slugs(F.col("n")).alias("s")).collect()}
    folded = [n for n in names if got[n][0] != n.casefold()]
    # the two libraries may know letters of different Unicode versions
    assert len(folded) <= 0.005 * len(names), folded[:3]
    assert [n for n in names if got[n][1] != text.slug(n)] == []
    odd = spark.createDataFrame([("Straße ΣΑΣ ﬁ İ",), (None,), ("",), ("日本",)], "n string")
    assert [r[0] for r in odd.select(duplicates.folded(F.col("n"))).collect()] == ["Straße ΣΑΣ ﬁ İ".casefold(), None, "", "日本"]
    assert [r[0] for r in odd.select(text.slugs(F.col("n"))).collect()] == [text.slug("Straße ΣΑΣ ﬁ İ"), None, "collection", "collection"]


def test_descriptors_of_file_names(spark):
    # fixed values: words that the cases below treat as noise
    noise = ("com", "join", "pic", "promo", "promochannel", "site", "source", "telegram", "tg", "thumb", "tp", "us")
    cases = {
        "Media Collection Garden Fern": "garden_fern",
        "Lisbon Ceramic Planter": "lisbon_ceramic_planter",
        "media_collection-Kyoto-4-thumb-1024x578": "kyoto",
        "media_collectionsunflowers-pic-100": "sunflowers",
        "5f4bdaaf27f8c5bc73a5a_source": None,
        "@site001 join us TG 2020-11-03 08.33.55": None,
        "2020-09-09_1242x2688_c8c3ed12887dd5768610e078c4af88c4-SOURCE-SITE.COM": None,
        "TG-PromoChannel103": None,
        "TP (15)": None,
    }
    df = spark.createDataFrame([(n,) for n in cases], "n string")
    assert [r[0] for r in df.select(text.descriptors(F.col("n"), "media_collection", noise)).collect()] == list(cases.values())


def test_numbers_over_ranges(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.6 else r.choice("abc"), r.randrange(50), k) for k in range(2000)] + [(None, 1, -1)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(5)
    got = {x.k: x.number for x in numbered(df, [F.col("v"), F.col("k")], ("g",)).collect()}
    for g in {x[0] for x in rows}:
        mine = sorted((x[1], x[2]) for x in rows if x[0] == g)
        assert [got[k] for _, k in mine] == list(range(1, len(mine) + 1))
    got = {x.k: x.n for x in numbered(df, [F.col("v"), F.col("k")], name="n", ranges=7).collect()}
    assert [got[x[2]] for x in sorted(rows, key=lambda x: (x[1], x[2]))] == list(range(1, 2002))
    assert numbered(df.limit(0), [F.col("v")]).count() == 0


def test_scratch_deletes_only_its_own(spark):
    kept_outside = written(spark.range(5))
    with scratch(spark) as keep:
        a = written(spark.range(7))
        with scratch(spark) as inner:
            b = inner(written(spark.range(9)))
        keep(b)
    assert kept_outside.count() == 5 and b.count() == 9
    assert not os.path.exists(a.veritree_path.removeprefix("file://")) and shared_dir(spark) in a.veritree_path


def test_organize_takes_free_names_and_keeps_old_ones(spark):
    rows = [("a/x.jpg", "picture"), ("b/X.jpg", "picture"), ("pics/x (1).jpg", "picture"), ("c/y.mp4", "video"), ("vids/z.mp4", "video"), ("n.txt", "other"), ("top.jpg", "picture")]
    got = {r.source: r.target for r in planning.organize_plan(spark.createDataFrame(rows, "path string, kind string"), {"picture": "pics", "video": "vids"}).collect()}
    assert got == {"a/x.jpg": "pics/x.jpg", "b/X.jpg": "pics/X (2).jpg", "c/y.mp4": "vids/y.mp4", "top.jpg": "pics/top.jpg"}


def test_plans_are_checked(spark):
    f = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    plan = spark.createDataFrame([("a", "x"), ("b", "X"), ("gone", "C")], "source string, target string")
    assert {tuple(r) for r in planning.plan_problems(plan, f).collect()} == {("X", "planned-twice"), ("C", "taken"), ("gone", "no-source")}


def test_events_in_a_strict_journal(spark):
    cols = "seq long, run_id string, event string, tool string, mode string, target_run_id string, action_id string, action_count long, reason string"
    start = lambda s, run, mode="APPLY", target=None, tool="t": (s, run, "RUN_STARTED", tool, mode, target, None, None, None)
    do = lambda s, run, event, action=None, count=None, target=None, reason=None: (s, run, event, None, None, target, action, count, reason)
    good = [start(0, "r"), do(1, "r", "ACTION_PLANNED", "a"), do(2, "r", "ACTION_COMPLETED", "a"), do(3, "r", "RUN_COMMITTED", count=1)]
    good += [start(4, "u", "UNDO", "r"), do(5, "u", "RUN_COMMITTED", count=0, target="r"), start(6, "s"), do(7, "s", "RUN_INCOMPLETE", reason="x")]
    bad = [start(10, "b"), start(11, "b"), do(12, "b", "ACTION_COMPLETED", "a"), do(13, "b", "ACTION_PLANNED", ""), do(14, "b", "RUN_COMMITTED", count=3), do(15, "b", "ACTION_PLANNED", "z"), do(16, "c", "ACTION_PLANNED", "z"), do(17, "c", "NOISE")]
    read = lambda rows: {(r.seq, r.problem) for r in journal.event_problems(spark.createDataFrame(rows, cols), ("t",)).collect()}
    assert read(good) == set()
    assert read(good + bad) == {(11, "duplicate-run"), (12, "not-planned"), (13, "no-action"), (14, "count"), (15, "after-end"), (16, "unknown-run"), (17, "unknown-event")}
    runs = journal.run_records(spark.createDataFrame(good, cols))
    assert journal.undo_problems(runs).count() == 0
    assert [(r.tool, r.run_id, r.blocked) for r in journal.undo_targets(runs).collect()] == [("t", "s", False)]


def test_playback_needs_an_equal_bucket(spark):
    f = spark.createDataFrame([(p, s, 9, 1, "video") for p, s in (("a", "h1"), ("b", "h2"), ("c", "h3"))], "path string, sha256 string, size long, modified_ns long, kind string")
    probe = "sha256 string, display_width int, display_height int, has_audio boolean, audio_sample_rate int, audio_channels int, audio_layout string"
    p = spark.createDataFrame([("h1", 2, 2, False, None, None, None), ("h2", 2, 2, False, None, None, None), ("h3", 4, 2, False, None, None, None)], probe)
    prints = spark.createDataFrame([("h1", "p"), ("h2", "p"), ("h3", "p")], "sha256 string, playback_sha256 string")
    assert {r.path for r in media.playback_groups(f, p, prints).collect()} == {"a", "b"}
    assert [r.sha256 for r in media.to_decode(f, p, prints.filter("sha256 <> 'h2'")).collect()] == ["h2"]
    wrong = spark.createDataFrame([("x", 0, 2, False, None, None, None), ("y", 1, 2, True, 1, None, "m"), ("z", 1, 2, False, 1, None, None)], probe)
    assert {tuple(r) for r in media.probe_problems(p.unionByName(wrong)).collect()} == {("x", "dimensions"), ("y", "audio-missing"), ("z", "audio-unexpected")}


def test_a_changed_file_has_one_finding(spark):
    c = spark.createDataFrame([("a", "video", "video", 5, True), ("b", "video", "video", 0, False), ("c", "picture", None, 5, False)], "path string, kind string, ext_kind string, size long, changed boolean")
    p = spark.createDataFrame([], "path string, ok boolean, decoder boolean, format_matches boolean, streams array<struct<codec_type: string, codec_name: string, width: int, height: int>>, duration double, family string, score int, accepted array<string>")
    got = {(r.path, r.code) for r in validation.file_findings(c, p).collect()}
    assert got == {("a", "changed_during_validation"), ("b", "empty_file"), ("c", "unrecognized_media_extension"), ("c", "invalid_image")}


def test_records_are_read_strictly(tmp_path):
    at = str(tmp_path / "m.json")
    files.create(at, {"schema_version": 1, "jobs": [{"name": "a", "source": "/s", "working": "/w"}]})
    assert records.manifest(at) == [{"ordinal": 0, "name": "a", "source": "/s", "working": "/w"}]
    with pytest.raises(FileExistsError):
        files.create(at, {})
    with pytest.raises(ValueError):
        files.create(str(tmp_path / "n.json"), {}, (str(tmp_path),))
    files.replace(at, {"schema_version": 1, "jobs": [{"name": "a", "source": "/s/../t", "working": "/w"}]})
    with pytest.raises(ValueError):
        records.manifest(at)
    (tmp_path / "r.json").write_text('{"schema_version": 1, "schema_version": 1}')
    with pytest.raises(ValueError):
        records.record(str(tmp_path / "r.json"), (), 1)
    assert records.config('[a]\nx = ["P"]\nn = 1\n[b]\nk = 1', '[a]\nx = ["p", "q", "Q"]\nn = 2', ("b",)) == {"a": {"x": ["P", "q"], "n": 2}, "b": {"k": 1}, "added": {"a": {"x": ["q"]}}}
    for custom in ("[b]\nk = 2", "[c]\nk = 2", '[a]\nn = "x"'):
        with pytest.raises(ValueError):
            records.config("[a]\nn = 1\n[b]\nk = 1", custom, ("b",))
    assert records.accepted_problems({"jpeg": [".jpg", ".jpg"], "gif": [".GIF"]}, ("jpeg", "png"), ()) == ["missing png", "unexpected gif", ".jpg is accepted for jpeg and jpeg", "bad extension '.GIF'"]


def test_journal_files_name_the_line(spark, tmp_path):
    at = str(tmp_path / "j.jsonl")
    for k in range(3):
        files.append(at, {"schema_version": 1, "seq": k, "run_id": "r", "event": "RUN_STARTED"})
    with open(at, "a") as f:
        f.write('{"seq": }\n' + json.dumps({"schema_version": 2, "seq": 9}) + "\n")
    got = [(r.line, r.seq, r.problem) for r in records.journal(spark, at).orderBy("line").collect()]
    assert [(a, c) for a, _, c in got] == [(1, None), (2, None), (3, None), (4, "syntax"), (5, "version")] and [b for _, b, _ in got][:3] == [0, 1, 2]


def test_walks_leave_out_what_they_are_told(spark, tmp_path):
    (tmp_path / "pics" / "Cache").mkdir(parents=True)
    (tmp_path / "pics" / "Cache" / "in.jpg").write_bytes(b"x")
    (tmp_path / "pics" / "a.TMP").write_bytes(b"x")
    (tmp_path / "pics" / "b.jpg").write_bytes(b"x")
    (tmp_path / ".tool-db").write_bytes(b"x")
    tree.register(spark)
    read = spark.read.format("tree").option("ignored_files", "*.tmp").option("ignored_folders", "cache").option("tool_state", ".tool*")
    assert {(r.path, r.category) for r in read.load(str(tmp_path)).collect()} == {("pics", "directory"), ("pics/Cache", "ignored"), ("pics/a.TMP", "ignored"), ("pics/b.jpg", "file"), (".tool-db", "tool_state")}


def test_older_schemas_as_records(spark):
    old = spark.createDataFrame([("b" * 64, 3, None)], "file_sha256 string, width int, height int")
    assert [r.payload_json for r in store.legacy_records(old, "probe", "v0", "r", ("width", "height")).collect()] == ['{"height":null,"width":3}']


def test_replay_equals_a_loop(spark):
    from veritree.operators import transitions

    r = random.Random(6)
    names = "abcdef"
    entries = [(run, p) for run in range(60) for p in r.sample(names, 4)]
    actions = [(run, k, r.choice(names), r.choice(names)) for run in range(60) for k in range(r.randrange(1, 7))]
    want = set()
    for run in range(60):
        now = {p for i, p in entries if i == run}
        for _, k, a, b in sorted(x for x in actions if x[0] == run):
            problem = "missing" if a not in now else "occupied" if b in now and a != b else None
            if problem:
                want.add((run, k, problem))
                break
            now = now - {a} | {b}
    got = transitions.simulate(spark.createDataFrame(actions, "run_id int, seq int, before string, after string"), spark.createDataFrame(entries, "run_id int, path string"))
    assert {tuple(x) for x in got.collect()} == want and len(want) > 20


@pytest.mark.parametrize("given", [False, True])
def test_replay_is_dealt_out_by_rows(spark, monkeypatch, given):
    from veritree.operators import transitions

    monkeypatch.setattr(transitions, "TASK_ROWS", 20, raising=False)
    actions = [(run, k, "a" if k % 2 == 0 else "b", "b" if k % 2 == 0 else "a") for run in [*range(50), None] for k in range(2)] + [(7, 2, "c", "a"), (8, 2, "c", "d"), (None, 2, None, "d")]
    entries = [(run, p) for run in [*range(50), None] for p in ("a", "a", "c", None)]  # repeated entries count once; no path is no entry
    actions, entries = spark.createDataFrame(actions, "run_id int, seq int, before string, after string"), spark.createDataFrame(entries, "run_id int, path string")
    got = transitions.simulate(actions, entries, **({"rows": 400} if given else {}))
    assert {tuple(x) for x in got.collect()} == {(7, 2, "occupied"), (None, 2, "missing")} and got.schema["run_id"].dataType.simpleString() == "int"
    assert got.rdd.getNumPartitions() == -(-(400 if given else 2 * actions.count() + entries.count()) // 20)  # what a task sorts does not grow with the rows


def test_small_predicates(spark, tmp_path):
    from veritree.operators import listing

    f = spark.createDataFrame([("a", "video", 0), ("b", "picture", 5)], "path string, kind string, size long")
    assert not listing.needs_decoding(f) and listing.needs_decoding(f.withColumn("size", F.lit(1)))
    rows = spark.createDataFrame([("empty_file", "secret")], "code string, detail string")
    assert [tuple(r) for r in listing.chosen(rows, ("code",), ("empty_file",)).collect()] == [("empty_file",)]
    with pytest.raises(Exception, match="may not be shown"):
        listing.chosen(rows, ("code",), ("other",)).collect()
    pairs = spark.createDataFrame([(None, 1), (1, 1), (2, 1), (2, None)], "e int, o int")
    assert [r[0] for r in pairs.select(listing.expected_or_any(F.col("e"), F.col("o"))).collect()] == [True, True, False, False]
    assert listing.all_of((".a", ".b"), (".b", ".c")) == (".a", ".b", ".c")
    real = os.path.realpath(tmp_path)
    (tmp_path / "d").mkdir()
    os.symlink(tmp_path / "d", tmp_path / "l")
    up = listing.ancestry(os.path.join(real, "d"))
    assert up[1:] == listing.ancestry(real) and len(up) == len(set(up)) == len(os.path.join(real, "d").split("/"))
    for bad in (os.path.join(real, "l"), "d", real + "/../x"):
        with pytest.raises(ValueError):
            listing.ancestry(bad)
