import random

import pytest
from pyspark.sql import functions as F

from veritree.operators import planning
from veritree.plans import gaps, ordering


def greedy(rows, home):
    """The first free name of each file in order of path; names are never freed."""
    taken, out = {p.casefold() for p, _ in rows}, {}
    for path, kind in sorted(rows, key=lambda r: r[0].encode()):
        at, _, name = path.rpartition("/")
        folder = home.get(kind)
        if folder is None or folder == at:
            continue
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        n = 0
        while True:
            target = f"{folder}/{stem}{f' ({n})' if n else ''}{ext}"
            if target.casefold() not in taken:
                break
            n += 1
        taken.add(target.casefold())
        out[path] = target
    return out


@pytest.mark.parametrize("seed", range(6))
def test_free_names_equal_a_greedy_search(spark, seed):
    r = random.Random(seed)
    stems = ["x", "X", "x (1)", "x (2)", "X (1)", "x (1) (1)", "x (2) (3)", "x (02)", "é", "É (1)", ".hidden", "x.tar", "y (1"]
    rows = {}
    for _ in range(r.choice([20, 150])):
        folder = r.choice(["a", "b", "c/d", "pics", "pics", "vids", "e", "f"])
        rows[f"{folder}/{r.choice(stems)}{r.choice(['.jpg', '.jpg', '.JPG', ''])}"] = r.choice(["picture", "picture", "video", "other"])
    rows = list(rows.items())
    home = {"picture": "pics", "video": "vids"}
    plan = planning.organize_plan(spark.createDataFrame(rows, "path string, kind string"), home)
    assert {x.source: x.target for x in plan.collect()} == greedy(rows, home)


def test_one_name_many_times(spark):
    """100,000 files of one name into a folder with occupied holes, some of them by files that move there themselves."""
    n = 100_000
    base = spark.range(n).select(F.format_string("in/%06d/x.jpg", "id").alias("path"))
    held = spark.range(1, 3000).filter("id % 3 <> 0").select(F.format_string("pics/X (%d).jpg", "id").alias("path"))
    late = spark.range(5000, 5003).select(F.format_string("zz/x (%d).jpg", "id").alias("path"))  # the others come first
    early = spark.range(6000, 6003).select(F.format_string("aa/x (%d).jpg", "id").alias("path"))
    f = base.union(held).union(late).union(early).withColumn("kind", F.lit("picture"))
    got = {r.source: r.target for r in planning.organize_plan(f, {"picture": "pics"}).collect()}
    taken = {k for k in range(1, 3000) if k % 3} | {6000, 6001, 6002}
    free = (k for k in range(10**7) if k not in taken)
    for k in range(n):
        number = next(free)
        assert got[f"in/{k:06d}/x.jpg"] == ("pics/x.jpg" if number == 0 else f"pics/x ({number}).jpg")
    assert [got[f"aa/x ({k}).jpg"] for k in (6000, 6001, 6002)] == [f"pics/x ({k}).jpg" for k in (6000, 6001, 6002)]
    assert [got[f"zz/x ({k}).jpg"] for k in (5000, 5001, 5002)] == [f"pics/x ({k}) (1).jpg" for k in (5000, 5001, 5002)]
    assert len({t.casefold() for t in got.values()}) == n + 6


def bumped(rows, collection, more=()):
    """Numbers in order, each one at which the due file's name exists left out."""
    import re

    taken, out = {p.casefold() for p, *_ in rows} | {p.casefold() for p in more}, {}
    for kind, word in (("picture", "image"), ("video", "video")):
        mine, top = [], 0
        for path, k, ext, stamp, word2 in rows:
            if k == kind:
                m = re.match(rf"(?i)^{collection}__{word}_([0-9]{{4,}})__", path.rsplit("/", 1)[-1])
                if m:
                    top = max(top, int(m[1]))
                else:
                    mine.append((path, ext, stamp, word2))
        number = top + 1
        for path, ext, stamp, descriptor in sorted(mine, key=lambda x: (x[2] is None, x[2] or "", x[0].casefold(), x[0])):
            while True:
                folder = path.rpartition("/")[0]
                target = (folder + "/" if folder else "") + f"{collection}__{word}_{number:04d}__{stamp or 'undated'}" + (f"__{descriptor}" if descriptor else "") + ext
                if target.casefold() not in taken:
                    break
                number += 1
            out[path] = (target, number)
            taken.add(target.casefold())
            number += 1
    return out


@pytest.mark.parametrize("seed", range(5))
def test_occupied_numbers_are_left_out(spark, seed, monkeypatch):
    monkeypatch.setattr(planning, "RANGE_NUMBERS", (1 << 17, 7)[seed % 2])
    r = random.Random(seed)
    rows = {}
    for k in range(60):
        folder, kind = r.choice(["a/", "", "b/"]), r.choice(["picture", "video"])
        rows[f"{folder}f{k}.jpg"] = (kind, ".jpg", r.choice([None, "1999", "2001"]), r.choice([None, "sea"]))
    for _ in range(80):  # names that look canonical, of other kinds or other files
        name = f"{r.choice(['a/', '', 'B/'])}{r.choice(['home', 'HOME'])}__{r.choice(['image', 'video'])}_{r.choice(['%04d', '%04d', '%05d']) % r.randrange(1, 50)}__{r.choice(['undated', '1999', '2001', '2001__sea', '1999__SEA'])}.jpg"
        rows.setdefault(name, (r.choice(["other", "other", "picture", "video"] if seed % 2 else ["other"]), ".jpg", None, None))
    rows = [(p, *v) for p, v in rows.items()]
    more = [f"a/home__image_{k:04d}__undated.jpg" for k in range(70, 75)]
    plan = planning.rename_plan(spark.createDataFrame(rows, "path string, kind string, ext string, stamp string, descriptor string"), "home", occupied=spark.createDataFrame([(m,) for m in more], "path string"))
    assert {x.source: (x.target, x.sequence) for x in plan.collect()} == bumped(rows, "home", more)


def test_a_long_stretch_of_occupied_numbers(spark):
    rows = [(f"home__image_{k:04d}__undated.jpg", "other", ".jpg", None, None) for k in range(1, 800)] + [("one.jpg", "picture", ".jpg", None, None), ("two.jpg", "picture", ".jpg", None, None)]
    plan = planning.rename_plan(spark.createDataFrame(rows, "path string, kind string, ext string, stamp string, descriptor string"), "home")
    assert {x.source: x.sequence for x in plan.collect()} == {"one.jpg": 800, "two.jpg": 801}


def test_running_sums_and_free_numbers_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 50)
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "a", None]), k, r.randrange(5)) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(3)
    got = {x.k: x.s for x in ordering.running(df, [F.col("k")], ("g",), {"s": F.col("v")}).collect()}
    sums = {}
    for g, k, v in rows:
        sums[g] = sums.get(g, 0) + v
        assert got[k] == sums[g]
    taken = {g: sorted(r.sample(range(300), n)) for g, n in (("hot", 120), ("a", 3), ("b", 5))}
    wanted = [(g, k) for g, n in (("hot", 250), ("a", 40), ("c", 9)) for k in range(n)]
    out = gaps.free_numbers(spark.createDataFrame(wanted, "g string, rank long"), spark.createDataFrame([(g, n) for g, x in taken.items() for n in x], "g string, number long"), ("g",)).collect()
    for x in out:
        assert x.number == [k for k in range(1000) if k not in taken.get(x.g, [])][x.rank]
