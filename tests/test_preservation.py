import random

from veritree.operators import preservation

FILE = "path string, size long, sha256 string, kind string, ext string"
EVIDENCE = "sha256 string, pixel_sha256 string, candidate string, playback_sha256 string"


def invented(r):
    kinds = [("picture", ".jpg"), ("picture", ".JPG"), ("picture", ".png"), ("video", ".mp4"), ("other", ".txt")]
    content = {f"c{k}": (k * 7, r.choice(kinds)) for k in range(40)}
    side = lambda name, n: [(f"{name}/{i}", content[c][0], c, *(content[c][1] if r.random() < 0.9 else r.choice(kinds))) for i in range(n) for c in [r.choice(list(content))]]
    known = [(c, r.choice([None, "p1", "p2", f"p{c}"]), r.choice([None, "k1", "k2"]), r.choice([None, "v1", "v2"])) for c in content if r.random() < 0.9]
    return side("s", 50), side("d", 30), known


def brute(source, destination, known, complete=True):
    have = {d[2] for d in destination}
    pixels, plays = {k[0]: k[1] for k in known}, {k[0]: (k[2], k[3]) if k[2] and k[3] else None for k in known}
    jpg = lambda f: f[4].lower() == ".jpg"
    there_p = {pixels.get(f[2]) for f in destination if jpg(f)} - {None}
    there_v = {plays.get(f[2]) for f in destination if f[3] == "video"} - {None}
    gone = {f[2] for f in source} - have
    pictures, videos = {f[2] for f in source if jpg(f)} & gone, {f[2] for f in source if f[3] == "video"} & gone
    image = {c for c in pictures if pixels.get(c) in there_p}
    video = {c for c in videos if plays.get(c) in there_v}
    lost = gone - image - video
    odd = {c for c in pictures if not pixels.get(c)} | {c for c in videos if not plays.get(c)} | {f[2] for f in source if f[4].lower() == ".png"}
    unsupported = lost & odd
    status = lambda hit, own, issue, blind: "not-needed" if not own else "unproven" if issue or (own - hit - issue and blind) else "incomplete" if own - hit else "complete"
    i = status(image, pictures, {c for c in pictures if not pixels.get(c)}, any(jpg(f) and not pixels.get(f[2]) for f in destination))
    v = status(video, videos, {c for c in videos if not plays.get(c)}, any(f[3] == "video" and not plays.get(f[2]) for f in destination))
    reason = "filesystem-evidence-incomplete" if not complete else "unsupported-source-media" if unsupported else "media-equivalence-evidence-incomplete" if lost and "unproven" in (i, v) else "source-content-unaccounted" if lost else None
    verdict = "complete" if reason is None else "incomplete" if reason == "source-content-unaccounted" else "unproven"
    return {"verdict": verdict, "reason": reason, "by_bytes": len({f[2] for f in source} & have), "by_image": len(image), "by_video": len(video - image), "unaccounted": len(lost), "unaccounted_files": sum(f[2] in lost for f in source), "unsupported": len(unsupported)}, i, v, lost


def test_report_equals_brute_force(spark):
    seen = set()
    for seed in range(8):
        r = random.Random(seed)
        s, d, known = invented(r)
        if seed == 5:
            d = s
        if seed == 6:
            s, d, known = [("s/1", 3, "x", "other", ".txt")], [("d/1", 4, "y", "other", ".txt")], []
        contents = preservation.outcomes(spark.createDataFrame(s, FILE), spark.createDataFrame(d, FILE), spark.createDataFrame(known, EVIDENCE), (".jpg",), (".jpg", ".png"))
        got = preservation.report(contents, destination_complete=seed != 7).first()
        want, i, v, lost = brute(s, d, known, seed != 7)
        assert {k: got.preservation[k] for k in want} == want
        assert (got.image_content.verdict, got.video_content.verdict) == (i, v)
        assert got.coverage.source_files == len(s) and got.multiplicity.source_copies == len(s) - len({f[2] for f in s})
        assert {x.path for x in preservation.unaccounted_files(spark.createDataFrame(s, FILE), contents).collect()} == {f[0] for f in s if f[2] in lost}
        seen.add(want["reason"])
    assert len(seen) >= 4


def test_few_exchanges(spark):
    s, d, known = invented(random.Random(1))
    # tables, so that nothing is planned as a local relation
    frames = [spark.createDataFrame(x, schema).repartition(2) for x, schema in ((s, FILE), (d, FILE), (known, EVIDENCE))]
    plan = preservation.report(preservation.outcomes(*frames, (".jpg",), (".jpg", ".png")))._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "Exchange" in x and "RoundRobin" not in x]) <= 6


def test_two_sizes_of_a_digest_prove_nothing(spark):
    one = spark.createDataFrame([("a", 1, "x", "other", ".txt"), ("b", 2, "x", "other", ".txt")], FILE)
    got = preservation.report(preservation.outcomes(one, one, spark.createDataFrame([], EVIDENCE), (".jpg",), (".jpg",))).first()
    assert got.preservation.verdict == "unproven" and got.coverage.conflicts == 1
    empty = spark.createDataFrame([], FILE)
    none = preservation.report(preservation.outcomes(empty, empty, spark.createDataFrame([], EVIDENCE), (".jpg",), (".jpg",))).first()
    assert none.preservation.verdict == "complete" and none.coverage.unique_percent == 100.0


def test_report_by_command(spark):
    from veritree import api

    entry = "path string, category string, size long, sha256 string, kind string, ext string"
    s = spark.createDataFrame([("a.jpg", "file", 1, "x", "picture", ".jpg"), ("b.txt", "file", 2, "y", "other", ".txt"), ("l", "directory", None, None, None, "")], entry)
    d = spark.createDataFrame([("pics/c.jpg", "file", 3, "z", "picture", ".jpg"), ("dups/b.txt", "file", 2, "y", "other", ".txt")], entry)
    known = spark.createDataFrame([("x", "p", None, None), ("z", "p", None, None)], EVIDENCE)
    out, lost = api.media_preservation_report(s, d, known, (".jpg",), (".jpg",))
    assert out["preservation"]["verdict"] == "complete" and out["preservation"]["by_image"] == 1 and lost.count() == 0
    out, lost = api.media_preservation_report(s, d, known, (".jpg",), (".jpg",), without_review=True)
    assert (out["result_kind"], out["preservation"]["verdict"]) == ("simulated", "incomplete") and [r.path for r in lost.collect()] == ["b.txt"]
    out, _ = api.media_preservation_report(s, d, known, (".jpg",), (".jpg",), stability=spark.createDataFrame([("a", "changed")], "path string, change string"))
    assert out["preservation"]["reason"] == "filesystem-evidence-incomplete"
