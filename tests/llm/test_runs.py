import hashlib
import random
import re
import zlib

import pytest

from tests.llm.cases import LONG, no_documents, odd_documents
from veritree.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """Every run by trying all periods and stretches."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e - s + q if e > s else 0
            if length >= max(12, 2 * q) and not any(all(w[i] == w[i + p] for i in range(s, s + length - p)) for p in range(1, q)):
                out.append((s, length, q))
            s = e + 1
    return sorted(out)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def texts():
    r = random.Random(3)
    for _ in range(300):
        kind = r.randrange(4)
        n, letters = r.randrange(0, 70), "ab" if kind == 0 else "abcd"
        x = [r.choice(letters) for _ in range(n)]
        if kind > 1:
            part = [r.choice("abcdefgh") for _ in range(r.randrange(1, 20))]
            x += part * r.randrange(1, 6) + part[: r.randrange(0, 9)] + x
        yield x
    yield from (list(fibonacci(150)), list(morse(160)), ["a"] * 90, list("abcdef" * 2 + "abcdeg" * 2), list("abcdefg" * 2), list("x" + "abcdefg" * 2 + "y" + "abcdefg" * 2 + "g"))


def test_runs_equal_brute_force():
    for x in texts():
        assert runs.find([c.encode() for c in x]) == brute(x)


def test_the_scan_alone_and_without_hashes():
    import numpy as np

    for x in texts():
        ids = np.array([ord(c) for c in x], np.int64)
        for direct in (False, True):
            if len(x):
                assert runs._Stretch(ids, direct).runs() == brute(x)


def test_long_texts_are_cut_at_no_run():
    words = [b"%d" % k for k in range(5000)]
    assert runs.find(words * 3) == [(0, 15000, 5000)]
    assert runs.find([b"a"] * 60_000) == [(0, 60_000, 1)]
    x = [c.encode() for c in morse(8192)]
    assert all(length >= 12 and length < 3 * period for _, length, period in runs.find(x))


def test_equal_hashes_are_found_out(monkeypatch):
    x = list("abcabcabcabcab" + "xyz" + "abcabdabcabdabcabd")
    monkeypatch.setattr(runs._Stretch, "equal", lambda self, i, j, m: True if not self.direct else self.plain[i : i + m] == self.plain[j : j + m])
    same = runs._Stretch._same
    monkeypatch.setattr(runs._Stretch, "_same", lambda self, i, j, m, back: same(self, i, j, m, back) if self.direct else same(self, i, j, m, back) | True)
    assert runs.find([c.encode() for c in x]) == brute(x)


def planted(i, w):
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def expected(i, text):
    w = planted(i, WORD.findall(text or ""))
    found = brute(w) if len(w) < 1500 else runs.find([x.encode() for x in w])
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (i, len(found), s, length, q, None if q is None else 1000 * length // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_the_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    out = queries.op13_runs(spark, sf)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(tuple(r) for r in out.collect())
    want = sorted(expected(r.doc_id, r.text) for r in docs)
    assert got == want and sum(r[1] > 0 for r in got) > 10


def test_odd_rows(spark):
    df = odd_documents(spark)
    got = [tuple(r) for r in runs.summary(runs.find_runs(runs.with_planted_runs(df))).collect()]
    assert sorted(map(str, got)) == sorted(str(expected(r.doc_id, r.text)) for r in df.collect())
    # the long text repeats five words: one run, of which five words stay
    long = runs.find_runs(df).filter("doc_id = 6").collect()[0]
    assert [tuple(r) for r in long.runs] == [(0, len(LONG.split()), 5)] and long.collapsed == "lorem ipsum dolor sit amet"
    assert runs.find_runs(no_documents(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 5, 11])
def test_short_texts_have_no_run(n):
    assert runs.find([b"a"] * n) == []
