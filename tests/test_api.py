import pytest
from pyspark.sql import functions as F

from veritree import api


@pytest.fixture
def folder(tmp_path):
    for name, data in {"pics/ready.png": b"1", "incoming/first.png": b"same", "incoming/second.png": b"same", "incoming/notes.txt": b"notes", "vids/ready.mp4": b"", "dups/pics/review.png": b"1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_scan_report(spark, folder):
    report = api.inventory_report(api.scan(spark, str(folder), True), True)
    assert report["kinds"]["picture"] == {"files": 4, "bytes": 10} and report["kinds"]["video"] == {"files": 1, "bytes": 0}
    assert report["extensions"][".txt"]["files"] == 1 and report["review"] == {"picture": {"files": 1, "bytes": 1}}
    assert report["same_size"] == {"groups": 1, "files": 2, "bytes": 4} and report["exact_duplicates"] == {"groups": 1, "files": 2, "bytes": 4}


def test_preservation_report(spark, folder, tmp_path_factory):
    other = tmp_path_factory.mktemp("dst")
    for name, data in {"a.png": b"1", "b.png": b"same", "n.txt": b"notes", "e.mp4": b""}.items():
        (other / name).write_bytes(data)
    src, dst = api.scan(spark, str(folder), True), api.scan(spark, str(other), True)
    assert api.preservation_report(src, dst)["verdict"] == "complete"
    assert api.preservation_report(dst, src, without_review=True)["verdict"] == "complete"
    (other / "link").symlink_to("a.png")
    report = api.preservation_report(api.scan(spark, str(other), True), src)
    assert report["verdict"] == "unproven" and report["issues"]["source"] == {"symbolic_link": 1}
    assert api.duplicate_report(src)["duplicates"] == 2
    assert [tuple(r) for r in api.duplicate_plan(src.filter("category = 'file'").withColumn("modified_ns", F.lit(1))).select("source", "target", "copy_no").collect()] == [("incoming/second.png", "dups/set_0001/first_copy(1).png", 1)]


def test_validation_report(spark):
    entries = spark.createDataFrame([("a", "candidate"), ("b", "candidate"), ("l", "symlink"), ("t", "other")], "path string, disposition string")
    candidates = spark.createDataFrame([("a", "picture", "picture", 5, False), ("b", "video", "video", 0, False)], "path string, kind string, ext_kind string, size long, changed boolean")
    probes = spark.createDataFrame([("a", True, True, True, None, None, None, None, None)], "path string, ok boolean, decoder boolean, format_matches boolean, streams array<struct<codec_type: string, codec_name: string, width: int, height: int>>, duration double, family string, score int, accepted array<string>")
    report = api.validation_report(entries, candidates, probes, show_files=True)
    assert report["health"] == {"files_with_errors": 1, "files_with_warnings": 1, "healthy_files": 1} and report["status"] == 1
    assert [(f["code"], f["count"]) for f in report["findings"]] == [("empty_file", 1), ("symbolic_link_skipped", 1)] and report["finding_files"].count() == 2
    old = spark.createDataFrame([("s", "picture", "healthy")], "sha256 string, kind string, outcome string")
    more = api.validation_report(entries, candidates.withColumn("sha256", F.lit("s")).withColumn("changed", F.col("path") == "b"), probes, fallback=True, stored=old)
    assert {f["code"]: (f["severity"], f["count"]) for f in more["findings"]}["classification_fallback"] == ("warning", 1)
    assert more["reuse"] == {"reused": 1, "checked": 1} and more["changed_during_validation"] == 1 and report["changed_during_validation"] == 0
    assert report["inventory"]["media_files"] == 2 and report["inventory"]["media_bytes"] == 5 and report["inventory"]["other_files"] == 1


def test_plans_by_name(spark):
    f = spark.createDataFrame([("a/x.jpg", "picture", ".jpg", None, None), ("pics/y.png", "picture", ".png", "2020-01-01", "sea")], "path string, kind string, ext string, stamp string, descriptor string")
    plan, one = api.organize(f)
    assert [tuple(r)[:2] for r in plan.collect()] == [("a/x.jpg", "pics/x.jpg")] and one.first()["rows"] == 1
    plan, _ = api.rename(f, "home")
    assert {r.source: r.target for r in plan.collect()} == {"pics/y.png": "pics/home__image_0001__2020-01-01__sea.png", "a/x.jpg": "a/home__image_0002__undated.jpg"}
    formats = spark.createDataFrame([("a/x.jpg", "png"), ("pics/y.png", "png")], "path string, format string")
    accepted = spark.createDataFrame([("png", [".png"])], "format string, extensions array<string>")
    plan, one = api.correct_extensions(f, formats, accepted)
    assert {r.path: r.target for r in plan.collect()} == {"a/x.jpg": "a/x.png", "pics/y.png": None} and one.first()["rows"] == 1


def test_a_review_tree_is_weighed_before_it_is_copied(spark):
    t = spark.createDataFrame([("a", "file", 5, "s", 1, 2), ("b", "file", 5, "s", 1, 2)], "path string, category string, size long, sha256 string, device long, inode long")
    got = api.quarantine_plan(t, {"device": 1, "ancestry": ["1:9", "1:2"]}, {"device": 1, "ancestry": ["1:7", "1:9"], "free": 10})
    assert got["problems"] == ["hard-links", "nested", "no-space", "same-device"] and got["manifest"]["files"] == 2 and got["required"] == (1 << 20) + 8192
