import hashlib
import random

from veritree.operators import merkle

ENTRY = "tree string, path string, category string, size long, sha256 string, meta string"


def field(x):
    x = "" if x is None else str(x)
    return f"{len(x.encode())}:{x}"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows, chunk):
    """path -> digest of one tree by recursion."""
    out = {}

    def listed(items, k):
        if k == 0:
            return sha("".join(line for _, line, _ in sorted(items, key=lambda x: x[0].encode())))
        low = {}
        for at, line, key in items:
            low.setdefault(key[:k], []).append((at, line, key))
        return listed([(key, field(key) + listed(own, 0), key) for key, own in low.items()], k - 1)

    def folder(path, meta):
        below = {}
        for p, c, *_ in rows:
            if p != path and (path == "" or p.startswith(path + "/")):
                below.setdefault(p[len(path) + 1 if path else 0 :].split("/")[0], []).append((p, c))
        items = []
        for name in below:
            p = f"{path}/{name}" if path else name
            own = next((r for r in rows if r[0] == p), (p, "directory", None, None, None))
            items.append((name, field(name) + node(own), sha(name)))
        rounds = 0
        while len(items) > chunk << 4 * rounds:
            rounds += 1
        out[path] = sha("D" + field(meta) + field(listed(items, rounds) if items else None))
        return out[path]

    def node(r):
        path, category, size, digest, meta = r
        if category == "directory":
            return folder(path, meta)
        out[path] = sha("F" + field(category) + field(meta) + field(size) + field(digest))
        return out[path]

    node(next((r for r in rows if r[0] == ""), ("", "directory", None, None, None)))
    return out


def invented(r):
    names = ["a", "B", "é", "a b", "z:1", "日", "a-"] + [f"n{k}" for k in range(r.choice([3, 40]))]
    rows = {}
    for _ in range(r.randrange(1, 120)):
        parts = [r.choice(names) for _ in range(r.randrange(1, 5))]
        path = "/".join(parts)
        if any("/".join(parts[:k]) in rows and rows["/".join(parts[:k])][0] != "directory" for k in range(1, len(parts))) or any(p.startswith(path + "/") for p in rows):
            continue
        rows[path] = r.choice([("file", r.randrange(9), f"h{r.randrange(9)}", "m"), ("directory", None, None, r.choice([None, "rx"])), ("symbolic_link", None, None, "->x")])
    return [(p, *v) for p, v in rows.items()]


def test_digests_equal_recursion(spark):
    r = random.Random(4)
    trees = {f"t{k}": invented(r) for k in range(6)}
    rows = [(t, *x) for t, rows in trees.items() for x in rows]
    for chunk in (2, 4096):
        got = {(x.tree, x.path): x for x in merkle.tree(spark.createDataFrame(rows, ENTRY), chunk=chunk).collect()}
        want = {(t, p): d for t, x in trees.items() for p, d in brute(x, chunk).items()}
        assert {k: v.digest for k, v in got.items()} == want
    for t, x in trees.items():
        assert got[t, ""].files == sum(e[1] == "file" for e in x) and got[t, ""].bytes == sum(e[2] or 0 for e in x)


def preorder(rows):
    return sorted(rows, key=lambda x: [p.encode() for p in x[0].split("/")] if x[0] else [])


def test_swapped_folders_are_found_where_they_are(spark):
    rows = [("t", f"{a}/{n}", "file", 1, h, "m") for a, h in (("one", "h1"), ("two", "h2"), ("six", "h3")) for n in ("x", "y")] + [("t", "one", "directory", None, None, "keep"), ("t", "two", "directory", None, None, "keep")]
    swap = {"one": "two", "two": "one"}
    after = [(t, "/".join([swap.get(p.split("/")[0], p.split("/")[0]), *p.split("/")[1:]]) if c == "file" else p, c, s, h, m) for t, p, c, s, h, m in rows]
    a, b = merkle.tree(spark.createDataFrame(rows, ENTRY)), merkle.tree(spark.createDataFrame(after, ENTRY))
    # the sums of what a tree holds do not see it, the manifest does
    assert [m.drop("digest").collect() for m in [merkle.manifests(a)]] == [m.drop("digest").collect() for m in [merkle.manifests(b)]]
    assert merkle.manifests(a).collect() != merkle.manifests(b).collect()
    assert {tuple(r) for r in merkle.differences(a, b).collect()} == {("t", f"{f}/{n}", "content") for f in ("one", "two") for n in ("x", "y")}
    assert [tuple(r) for r in merkle.differences(a, b, first=True).collect()] == [("t", "one/x", "content")]
    assert merkle.differences(a, a).count() == 0


def test_differences_equal_brute_force(spark):
    r = random.Random(9)
    before, after = {f"t{k}": invented(r) for k in range(8)}, {}
    for t, rows in before.items():
        x = [e for e in rows if r.random() > 0.08]
        after[t] = [(p, c, s, "other" if r.random() < 0.1 and c == "file" else h, "other" if r.random() < 0.1 else m) for p, c, s, h, m in x]
    del after["t7"]
    made = [merkle.tree(spark.createDataFrame([(t, *x) for t, rows in d.items() for x in rows], ENTRY), chunk=3) for d in (before, after)]
    got = {tuple(x) for x in merkle.differences(*made).collect()}
    want = set()
    for t, rows in before.items():
        if t == "t7" or not after[t]:
            want.add((t, "", "missing"))
            continue

        def nodes(rows):
            out = {p: (c, (s, h), m) for p, c, s, h, m in rows}
            for p in list(out):
                parts = p.split("/")
                for k in range(len(parts)):
                    out.setdefault("/".join(parts[:k]), ("directory", (None, None), None))
            return out

        a, b = nodes(rows), nodes(after[t])
        for p in a.keys() | b.keys():
            up = "/".join(p.split("/")[:-1]) if p else None
            if up is not None and not (up in a and up in b and a[up][0] == b[up][0] == "directory"):
                continue
            x, y = a.get(p), b.get(p)
            d = "missing" if y is None else "unexpected" if x is None else "kind" if x[0] != y[0] else "content" if x[1] != y[1] else "metadata" if x[2] != y[2] else None
            if d:
                want.add((t, p, d))
    assert got == want
    first = {x.tree: (x.path, x.difference) for x in merkle.differences(*made, first=True).collect()}
    assert first == {t: preorder([(p, d) for u, p, d in want if u == t])[0] for t in {x[0] for x in want}}


def test_empty_tables_and_deep_chains(spark):
    empty = spark.createDataFrame([], ENTRY)
    assert merkle.tree(empty).count() == 0 and merkle.differences(merkle.tree(empty), merkle.tree(empty)).count() == 0
    deep = "/".join(f"d{k}" for k in range(9))
    a, b = (merkle.tree(spark.createDataFrame([("t", f"{deep}/f", "file", 1, h, None)], ENTRY)) for h in ("x", "y"))
    assert a.count() == 11 and [tuple(r) for r in merkle.differences(a, b, first=True).collect()] == [("t", f"{deep}/f", "content")]
