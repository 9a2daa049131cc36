import hashlib
import pathlib
import random
import re
import zlib

from pyspark.sql import functions as F

from tests.llm.cases import LONG, no_documents, odd_documents
from veritree.llm import licenses, line_dedup, quality_rules, queries, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeat_words(w):
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)})


def test_quality_measures_equal_brute_force(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["a ", "b ", "c", "\n", "# ", "é\t", "日 "]) for _ in range(r.randrange(120))) for _ in range(60)] + ["a a a", "a a a a", "a b c a b c", None, ""]
    got = {x.doc_id: x for x in quality_rules.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"))
        assert (got[i].n_dup_lines, got[i].n_repeat_words) == (len(lines) - len(set(lines)), repeat_words(w))


def test_quality_odd_rows_and_ablation(spark):
    led = quality_rules.ledger(odd_documents(spark))
    assert led.count() == 12
    rows = quality_rules.apply_policy(led).collect()
    assert [x.kept for x in rows if x.doc_id == 1] == [False] and len([x for x in rows if x.doc_id == 4]) == 2
    assert quality_rules.filtered(odd_documents(spark)).columns == odd_documents(spark).columns
    ab = {x.rule: x for x in quality_rules.ablation(led).collect()}
    bits = [x.fail_bits & quality_rules.POLICIES["v1"] for x in rows]
    for name, bit in quality_rules.BIT.items():
        assert (ab[name].n_failed, ab[name].n_only) == (sum(1 for b in bits if b & bit), bits.count(bit))
        assert ab[name].n_kept_without == bits.count(0) + bits.count(bit)
    assert quality_rules.ablation(quality_rules.ledger(no_documents(spark))).count() == len(quality_rules.BIT)


def check_shards(rows, n):
    rows = sorted(rows, key=lambda x: (x.hi, x.lo, x.shard, x.slot))  # rows of one key are alike
    total, below = sum(x.size for x in rows), 0
    seen = {}
    for x in rows:
        assert x.shard == below * n // total
        seen.setdefault(x.shard, []).append((x.hi, x.lo, x.slot))
        below += x.size
    for s in seen.values():
        assert [x[2] for x in sorted(s)] == list(range(len(s)))


def test_shards_are_exact_cuts(spark, monkeypatch):
    r = random.Random(2)
    texts = [r.choice(["same", "x" * r.randrange(300), None, "é" * r.randrange(50)]) for _ in range(900)]
    df = spark.createDataFrame([(r.choice([i, -i, 7]), t) for i, t in enumerate(texts)], "doc_id long, text string")
    one = spark.createDataFrame([(i, f"text {i}" * (i % 9)) for i in range(500)], "doc_id long, text string")
    for few, n, rows in ((8192, 16, 250_000), (3, 5, 37), (1, 7, 20)):
        monkeypatch.setattr(sharding, "FEW_ROWS", few)
        got = sharding.shard(df, n, range_rows=rows).collect()
        assert len(got) == 900 and sum(x.size for x in got) == sum(len((t or "").encode()) + 1 for t in texts)
        check_shards(got, n)
        check_shards(sharding.shard(one, n, range_rows=rows).collect(), n)


def test_equal_rows_are_cut_as_well(spark):
    rows = [(None, "copies of one text")] * 10_000 + [(5, "again")] * 3000 + [(i, f"own text {i}") for i in range(400)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 16, range_rows=1000).collect()
    check_shards(got, 16)
    sizes = [sum(x.size for x in got if x.shard == k) for k in range(16)]
    assert max(sizes) - min(sizes) <= 2 * max(x.size for x in got)


def test_the_sharding_query(spark):
    got = queries.op5_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(x.doc_id for x in got) == sorted(docs) and {x.law for x in got} == {"bytes"} and {x.grown_shard for x in got} == {None}
    assert all((x.size, x.text_crc32) == (len((docs[x.doc_id] or "").encode()) + 1, zlib.crc32((docs[x.doc_id] or "").encode())) for x in got)
    for k in range(16):
        assert sorted(x.slot for x in got if x.shard == k) == list(range(sum(x.shard == k for x in got)))
    sizes = [sum(x.size for x in got if x.shard == k) for k in range(16)]
    assert max(sizes) - min(sizes) <= 2 * max(x.size for x in got)


def test_shards_of_odd_rows(spark):
    got = sharding.shard(odd_documents(spark), 4).collect()
    assert len(got) == 12 and sharding.shard(no_documents(spark)).count() == 0
    assert {(x.doc_id, x.text_crc32) for x in got} >= {(1, 0), (6, zlib.crc32(LONG.encode()))}
    for k in range(4):
        slots = sorted(x.slot for x in got if x.shard == k)
        assert slots == list(range(len(slots)))


def test_spread_lines_go_and_copies_stay(spark):
    rows = []
    for i in range(12):
        rows.append((i, f"own words of page {i} that nobody else has here\n  Accept cookies \n\nmore text for page {i} alone", f"site{i % 6}"))
        rows.append((100 + i, "a copied page\nwith two lines", f"site{i % 6}"))
    rows += [(200 + i, f"unique {i} words are here and many\nseen on four sites", f"site{i % 4}") for i in range(8)]
    got = {x.doc_id: x for x in line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("__row.doc_id", "n_lines", "n_removed", "clean").collect()}
    assert got[3].n_removed == 1 and got[3].clean == "own words of page 3 that nobody else has here\n\nmore text for page 3 alone"
    assert got[103].n_removed == 0 and got[103].clean == "a copied page\nwith two lines"
    assert all(got[200 + i].n_removed == 0 for i in range(8))


def test_spread_lines_go_however_short_the_rest(spark):
    foot = " ".join(f"word{k}" for k in range(50))
    rows = [(i, f"page {i}\n{foot}\n{foot}\npage {i} ends", f"site{i}") for i in range(7)]
    # one doc_id with two texts, of which each loses its own lines; and a long text of many lines
    rows += [(3, f"{foot}\nanother text of the same id", "site0"), (50, "\n".join(["x y", foot] * 3000), "site1")]
    got = [(x.doc_id, x.n_removed, x.clean) for x in line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("__row.doc_id", "n_removed", "clean").collect()]
    want = [(i, 2, f"page {i}\npage {i} ends") for i in range(7)] + [(3, 1, "another text of the same id"), (50, 3000, "\n".join(["x y"] * 3000))]
    assert sorted(got) == sorted(want)


def test_lines_of_odd_rows(spark):
    df = odd_documents(spark)
    out = line_dedup.deduplicated(df)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert line_dedup.deduplicated(no_documents(spark)).count() == 0


def test_long_licences_wrapped_notices_and_blocks(spark):
    names = {n: f for n, f in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("LGPL-2.1", "LGPL-2.1"))}
    texts = {}
    for n, f in names.items():
        path = pathlib.Path(licenses.LONG_TEXTS, f)
        if path.exists():
            texts[n] = path.read_text(encoding="utf-8")
    rows = [(k, " ".join(t.split(" ")).replace("\n\n", "\n \n").upper()) for k, t in enumerate(texts.values())]
    unlicense = dict(licenses.LICENSES)["Unlicense"]
    rows += [(90, unlicense.replace("software", "software\n")), (91, "a page\n\nLicensed under the Apache License,\nVersion 2.0.\n\nmore"), (92, "a page\nLicensed under the Apache License, version 2.0.")]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].text_license for k in range(len(texts))] == list(texts)
    assert got[90].text_license == "Unlicense" and (got[91].block_licenses, got[91].line_licenses) == (["Apache-2.0"], [])
    assert (got[92].block_licenses, got[92].line_licenses) == ([], ["Apache-2.0"])


def test_licences_by_entire_text_and_line(spark):
    mit = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + dict(licenses.LICENSES[:1])["MIT"].replace("software", "SOFTWARE") + "\n"
    rows = [(1, mit), (2, "story\nReleased under the MIT licence\nend"), (3, "see MIT License text"), (4, None), (5, ""), (6, mit + " and more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.scan(df).collect()}
    assert got[1].text_license == "MIT" and got[2].text_license is None and got[2].line_licenses == ["MIT"]
    assert all(got[i].text_license is None and got[i].line_licenses == [] for i in (3, 4, 5, 6)) and got[4].text_digest is None
    before, licenses.MAX_BROADCAST = licenses.MAX_BROADCAST, 0  # the same by a shuffled join
    again = {x.doc_id: x for x in licenses.scan(df).collect()}
    licenses.MAX_BROADCAST = before
    assert again == got
    assert licenses.scan(odd_documents(spark)).count() == 12 and licenses.scan(no_documents(spark)).count() == 0
    texts = [mit, "A  b,C\n© 2020 x\nWhilst", "  "]
    one = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = [hashlib.md5(c.encode()).hexdigest() if (c := licenses.canonical_text(t)) else None for t in texts]
    assert [x.text_digest for x in licenses.scan(one).orderBy("doc_id").collect()] == want
    assert licenses.scan(one.withColumn("name", F.lit("z")), keep=("name",)).columns[:2] == ["doc_id", "name"]
