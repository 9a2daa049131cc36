import hashlib
import os

from pyspark.sql import functions as F

from veritree.sources import tree


def made(path, names):
    for n in names:
        f = path / n
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(n.encode())


def reader(path, **filters):
    r = tree.TreeReader(str(path), True, [], [], [])
    list(r.pushFilters(filters.get("filters", [])))
    return r


def all_rows(r):
    return [x for p in r.partitions() for x in r.read(p)]


def test_only_chosen_files_are_read(spark, tmp_path, monkeypatch):
    made(tmp_path, ["a/x.jpg", "a/y.txt", "b/c/z.jpg", "b/large.jpg"])
    (tmp_path / "b/large.jpg").write_bytes(b"x" * 5000)
    tree.register(spark)
    df = spark.read.format("tree").option("checksums", "true").load(str(tmp_path)).filter((F.col("category") == "file") & (F.col("size") > 100) & F.endswith("path", F.lit(".jpg")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan.replace("RuntimeFilters", "")  # all of them are the source's
    assert [(r.path, r.sha256) for r in df.collect()] == [("b/large.jpg", hashlib.sha256(b"x" * 5000).hexdigest())]
    assert df.filter(F.col("sha256") == "no").count() == 0
    read = []
    monkeypatch.setattr(tree.TreeReader, "_digest", lambda self, fd, name, state: (read.append(name), ("file", None))[1])
    r = tree.TreeReader(str(tmp_path), True, [], [], [])
    assert list(r.pushFilters([tree.GreaterThan(("size",), 100), tree.StringStartsWith(("path",), "b/")])) == []
    assert [x[0] for x in all_rows(r) if x[1] == "file"] == ["b/large.jpg"] and read == ["large.jpg"]


def test_a_filter_on_paths_keeps_folders_shut(tmp_path, monkeypatch):
    made(tmp_path, ["a/b/x", "a/c/y", "d/z", "ab/q"])
    opened = []
    own = tree.TreeReader._open
    monkeypatch.setattr(tree.TreeReader, "_open", lambda self, path: (opened.append(path), own(self, path))[1])
    r = reader(tmp_path, filters=[tree.StringStartsWith(("path",), "a/b")])
    assert sorted(x[0] for x in all_rows(r)) == ["a/b", "a/b/x"] and set(opened) == {"", "a", "a/b"}


def test_one_deep_folder_is_read_by_many_parts(tmp_path, monkeypatch):
    names = [f"one/two/three/f{k}/g{k % 3}/x{k}" for k in range(60)] + [f"one/wide/{k}" for k in range(40)]
    made(tmp_path, names)
    monkeypatch.setattr(tree, "SHARE", 10)
    r = reader(tmp_path)
    parts = r.partitions()
    assert len(parts) > 60 and sum(p.value[0] == "one/wide" for p in parts) == 4
    rows = [[x[0] for x in r.read(p)] for p in parts]
    flat = [x for p in rows for x in p]
    folders = {"/".join(n.split("/")[:k]) for n in names for k in range(1, len(n.split("/")))}
    assert sorted(flat) == sorted({*names, *folders}) and max(map(len, rows)) <= 70
    monkeypatch.setattr(tree, "LISTED", 2)
    assert sorted(x[0] for x in all_rows(r)) == sorted(flat)


def test_a_link_put_in_a_parents_place_is_refused(tmp_path):
    made(tmp_path / "t", ["a/b/x", "c/y"])
    made(tmp_path / "secret", ["b/x"])
    r = reader(tmp_path / "t")
    parts = r.partitions()
    os.rename(tmp_path / "t/a", tmp_path / "t/was")
    os.symlink(tmp_path / "secret", tmp_path / "t/a")
    rows = {x[0]: x[1] for p in parts for x in r.read(p)}
    assert "a/b/x" not in rows and rows["a/b"] == "unreadable" and rows["a"] in ("symbolic_link", "unreadable")
    assert rows["c/y"] == "file"


def test_a_folder_that_was_exchanged_while_reading_is_changed(tmp_path, monkeypatch):
    made(tmp_path, ["a/b/x", "a/z/y"])
    r = reader(tmp_path)
    own = tree.TreeReader._open

    def exchanged(self, path):
        if path == "a/b" and os.path.isdir(tmp_path / "a/b/../z"):
            os.rename(tmp_path / "a/b", tmp_path / "a/old")
            os.rename(tmp_path / "a/z", tmp_path / "a/b")
        return own(self, path)

    part = tree.Part("a", True)
    monkeypatch.setattr(tree.TreeReader, "_open", exchanged)
    rows = {(x[0], x[1]) for x in r.read(part)}
    assert ("a/b", "changed") in rows and not any(p.startswith("a/b/") for p, _ in rows)
