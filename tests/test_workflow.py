import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritree import api, workflow
from veritree.functions import content


def stages(log, fail):
    return [workflow.Stage(n, lambda n=n: (log.append(n), fail.pop(n, 0))[1]) for n in ("scan", "organise", "verify")] + [workflow.Stage("sign-off", lambda: 1, accepts=(0, 1))]


def test_a_workflow_goes_on_where_it_stopped(tmp_path):
    log, fail = [], {"organise": 1}
    w = workflow.Workflow(str(tmp_path / "s.json"), stages(log, fail))
    assert w.status() == "not-started" and w.run() == 1 and w.status() == "stopped" and log == ["scan", "organise"]
    assert w.run() == 0 and w.status() == "complete" and log == ["scan", "organise", "organise", "verify"]
    assert [a["status"] for a in w.state()["attempts"]] == [0, 1, 0, 0, 1]
    with pytest.raises(ValueError):
        workflow.Workflow(str(tmp_path / "s.json"), stages(log, {})[:2]).state()


def test_a_queue_stops_at_the_first_that_does_not_end(tmp_path):
    log = []
    jobs = [workflow.Workflow(str(tmp_path / f"{k}.json"), stages(log, {"verify": 2} if k == 1 else {})) for k in range(3)]
    assert workflow.run_queue(jobs) == [(0, "complete"), (1, "stopped"), (2, "not-started")]
    assert workflow.run_queue(jobs) == [(0, "complete"), (1, "stopped"), (2, "not-started")]
    assert workflow.run_queue(jobs, frozenset({1})) == [(0, "complete"), (1, "complete"), (2, "complete")]


def test_stages_over_a_virtual_namespace(spark):
    ns = spark.createDataFrame([("a/x.jpg", "picture"), ("b/x.jpg", "picture")], "path string, kind string")
    to = lambda fixed: lambda now: now.select(F.col("path").alias("source"), F.concat(F.lit("pics/"), F.lit("x.jpg") if fixed else F.translate("path", "/", "_")).alias("target"))
    got = workflow.virtual_stages(ns, [("organise", to(False)), ("rename", lambda now: now.select(F.col("path").alias("source"), F.col("path").alias("target")))])
    assert [g["moves"] for g in got] == [0, 2, 2] and got[0]["digest"] != got[1]["digest"] == got[2]["digest"]
    assert workflow.virtual_stages(ns, [("organise", to(True)), ("never", to(True))])[-1]["collisions"] == 1
    accepted = {"baseline": "b", "configuration": "c", "stages": 2, "namespaces": ["n0", "n1", "n2"]}
    seen = {"baseline": "b", "configuration": "d", "stages": 2, "stage": 1, "namespace": "n0"}
    assert workflow.plan_bound(accepted, seen) == ["configuration", "namespace"]


def test_evidence_is_computed_once_for_each_content(spark, tmp_path):
    h = ["%064x" % k for k in range(3)]
    f = spark.createDataFrame([("a", h[0]), ("b", h[0]), ("c", h[1]), ("d", h[2])], "path string, sha256 string")

    def provider(frames):
        for frame in frames:
            yield pd.DataFrame({"sha256": frame["sha256"], "payload_json": ['{"p":"%s"}' % p if p != "d" else None for p in frame["path"]]})

    at = str(tmp_path / "store")
    assert api.warm(spark, at, f, ("probe", "v1", "r"), provider) == {"discovered": 4, "distinct_hashes": 3, "reused": 0, "to_compute": 3, "version": 1}
    assert api.warm(spark, at, f.filter("path <> 'd'"), ("probe", "v1", "r"), provider)["version"] is None
    assert api.warm(spark, at, f, ("probe", "v1", "r"), provider, reuse=False)["to_compute"] == 3


def exif(order, tags):
    """A TIFF block with DateTime (306) and, below 34665, DateTimeOriginal (36867)."""
    main = [(306, tags[306])] if 306 in tags else []
    sub = [(36867, tags[36867])] if 36867 in tags else []
    n = len(main) + bool(sub)
    at = 8 + 2 + 12 * n + 4
    sub_at = at + 20 * len(main)
    out = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "IH", 8, n)
    for k, (tag, _) in enumerate(main):
        out += struct.pack(order + "HHII", tag, 2, 20, at + 20 * k)
    if sub:
        out += struct.pack(order + "HHII", 34665, 4, 1, sub_at)
    out += b"\0" * 4 + b"".join(v.encode() + b"\0" for _, v in main)
    if sub:
        out += struct.pack(order + "H", 1) + struct.pack(order + "HHII", 36867, 2, 20, sub_at + 18) + b"\0" * 4 + sub[0][1].encode() + b"\0"
    return b"\xff\xd8\xff\xe1\0\0Exif\0\0" + out


def test_dates_and_types_from_content(spark):
    both = {306: "2021:02:03 04:05:06", 36867: "2020:01:02 03:04:05"}
    rows = [exif("<", both), exif(">", both), exif("<", {306: both[306]}), exif("<", {306: "0000:00:00 00:00:00"}), b"", b"\xff\xd8\xff", None]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, b binary").coalesce(1)
    got = df.select(content.exif_timestamp(F.col("b")).alias("t"), content.content_type(F.col("b")).alias("m"), content.picture_format(F.col("b")).alias("f")).collect()
    assert [r.t for r in got] == ["2020-01-02_03-04-05", "2020-01-02_03-04-05", "2021-02-03_04-05-06", None, None, None, None]
    assert [r.m for r in got] == ["image/jpeg"] * 4 + [None, "image/jpeg", None] and [r.f for r in got][5] == "JPEG"
    paths = spark.createDataFrame([("/a/b",), ("/",), ("a",), ("/a//b",), ("/a/..",), (None,)], "p string")
    assert [r[0] for r in paths.select(content.absolute_path_ok(F.col("p"))).collect()] == [True, True, False, False, False, False]
    assert content.runtime_name({"b": 1, "a": None}) == '{"a":null,"b":1}'


def test_moves_are_journalled_and_undone(spark, tmp_path):
    from veritree.operators import journal
    from veritree.sinks import moves
    from veritree.sources import records

    root, log = tmp_path / "c", str(tmp_path / "log.jsonl")
    (root / "in").mkdir(parents=True)
    (root / "in" / "a").write_text("1")
    (root / "in" / "b").write_text("2")
    first = moves.apply([("in/a", "out/a"), ("in/b", "out/b")], log, "organize", str(root))
    assert sorted(p.name for p in (root / "out").iterdir()) == ["a", "b"]
    with pytest.raises(FileExistsError):
        (root / "in" / "a").write_text("3")
        moves.apply([("in/a", "out/a")], log, "organize", str(root))
    (root / "in" / "a").unlink()
    with pytest.raises(ValueError):
        moves.apply([("../x", "out/x")], log, "organize", str(root))
    events = records.journal(spark, log)
    assert events.filter("problem is not null").count() == 0 and journal.event_problems(events, ("organize",)).count() == 0
    assert {r.state for r in journal.run_records(events).collect()} == {"committed", "incomplete"}
    moves.undo([("out/b", "in/b"), ("out/a", "in/a")], log, "organize", str(root), first)
    runs = journal.run_records(records.journal(spark, log))
    assert journal.undo_problems(runs).count() == 0 and (root / "in" / "a").read_text() == "1"
    assert runs.filter("state = 'committed' and mode = 'UNDO'").first().target_run_id == first
