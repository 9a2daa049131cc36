import random

from pyspark.sql import functions as F

from veritree.operators import journal, namespace


def replay(base, moves, stages):
    """(path -> (origin, moves)), problems, and the origins of moves, stage by stage."""
    now, problems, traced = {p: (p, 0) for p in base}, set(), set()
    for s in range(1, stages + 1):
        own = [(a, b) for t, a, b in moves if t == s]
        gone = {a for a, _ in own if a in now}
        left = {p: v for p, v in now.items() if p not in gone}
        for a, b in own:
            if a not in now:
                problems.add((s, a, b, "no-source"))
            elif b in left:
                problems.add((s, a, b, "occupied"))
        for a, b in own:
            if a in now:
                traced.add((s, a, b, now[a][0]))
                left[b] = (now[a][0], now[a][1] + 1)
        now = left
    return now, problems, traced


def invented(r, stages, bad=0.0):
    base = [f"p{k}" for k in range(12)]
    now, moves = set(base), []
    for s in range(1, stages + 1):
        sources = r.sample(sorted(now), r.randrange(0, 6))
        free = [f"p{k}" for k in range(30) if f"p{k}" not in now or f"p{k}" in sources]
        targets = r.sample(free, len(sources))
        pairs = [(a, b) for a, b in zip(sources, targets) if a != b]
        pairs = [(a, b) for a, b in pairs if b not in now or b in {x for x, _ in pairs}]
        kept = {a for a, _ in pairs}
        pairs = [(a, b) for a, b in pairs if b not in now or b in kept]
        if len({b for _, b in pairs}) != len(pairs) or any(b in now and b not in {a for a, _ in pairs} for _, b in pairs):
            continue
        moves += [(s, a, b) for a, b in pairs]
        now = (now - {a for a, _ in pairs}) | {b for _, b in pairs}
    return base, moves


def test_origins_equal_a_replay(spark):
    for seed, stages in ((1, 3), (2, 40), (3, 130)):
        base, moves = invented(random.Random(seed), stages)
        final, problems, traced = replay(base, moves, stages)
        assert not problems and moves
        b, m = spark.createDataFrame([(p,) for p in base], "path string"), spark.createDataFrame(moves, "stage int, source string, target string")
        assert namespace.move_problems(b, m).count() == 0
        got, of = namespace.origins(b, m)
        assert {r.path: (r.origin, r.moves) for r in got.collect()} == final
        assert {(r.stage, r.source, r.target, r.origin) for r in of.collect()} == traced


def test_impossible_moves_and_folders(spark):
    b = spark.createDataFrame([("a",), ("b",)], "path string")
    m = spark.createDataFrame([(1, "x", "y"), (1, "a", "b"), (2, "b", "c"), (3, "a", "d")], "stage int, source string, target string")
    assert {tuple(r) for r in namespace.move_problems(b, m).collect()} == {(1, "x", "y", "no-source"), (1, "a", "b", "occupied"), (3, "a", "d", "no-source")}
    f = spark.createDataFrame([("k",), ("z",)], "path string")
    c = spark.createDataFrame([(1, "k", "removed"), (2, "k", "created"), (2, "n", "created"), (3, "n", "removed"), (4, "z", "created"), (4, "q", "removed")], "stage int, path string, change string")
    assert {tuple(r) for r in namespace.folders_after(f, c.filter("stage < 4")).collect()} == {("k", 2), ("z", 0)}
    assert {tuple(r) for r in namespace.folder_problems(f, c).collect()} == {(4, "z", "exists"), (4, "q", "absent")}
    empty = spark.createDataFrame([], "stage int, source string, target string")
    assert {tuple(r) for r in namespace.origins(b, empty)[0].collect()} == {("a", "a", 0), ("b", "b", 0)}


def test_blockers_equal_brute_force(spark):
    r = random.Random(7)
    for _ in range(3):
        parts = ["a", "b", "a-", "a b", "é", "z"]
        rows = [(run, "/".join(r.choice(parts) for _ in range(r.randrange(1, 6))), r.randrange(4000)) for run in range(40) for _ in range(2)]
        rows += [(run, "deep/" + "/".join(["d"] * r.randrange(1, 200)), 5000 + run) for run in range(15, 40)]
        target, active = 20, {k for k in range(40) if k % 3}
        meets = lambda p, q: p == q or p.startswith(q + "/") or q.startswith(p + "/")
        own = [x for x in rows if x[0] == target]
        want = {x[0] for x in rows if x[0] > target and any(meets(x[1], o[1]) or x[2] == o[2] for o in own)}
        df = spark.createDataFrame(rows, "run_no int, path string, inode int")
        assert {x.run_no for x in journal.later_blockers(df, target).collect()} == want
        assert {x.run_no for x in journal.later_blockers(df, target, spark.createDataFrame([(k,) for k in active], "run_no int")).collect()} == want & active
    assert journal.later_blockers(df.limit(0), 1).count() == 0


def test_paths_sort_as_trees(spark):
    paths = ["a", "a/b", "a/b/c", "a-", "a b", "a/é", "b", "ab"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").orderBy(journal.path_key(F.col("path")))
    got = [r.path for r in df.collect()]
    for k, p in enumerate(got):
        inside = [i for i, q in enumerate(got) if q.startswith(p + "/")]
        assert inside == list(range(k + 1, k + 1 + len(inside)))
