import collections
import hashlib
import re

import tiktoken

import corpus_pipeline
from tests.llm.cases import odd_documents
from tests.llm.test_duplicates_leaks import groups
from tests.llm.test_language_chat_bpe import reference  # noqa: F401
from tests.llm.test_rules_shards_lines import WORD, repeat_words
from veritree.llm import queries
from veritree.llm.common import written


def good(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    chars, symbols, dup = sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))
    return len(w) >= 50 and repeat_words(w) * 2 <= len(w) and 10 * symbols <= 3 * len(w) and 10 * dup <= 4 * len(lines) and 2 * len(w) <= chars <= 15 * len(w)


def without_boilerplate(rows):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    sites = collections.defaultdict(set)
    for _, text, site in rows:
        for x in (text or "").split("\n"):
            sites[strip(x)].add(site)
    out = []
    for i, text, site in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (WORD.search(x) and len(sites[strip(x)]) >= 5)]
        out.append((i, "\n".join(kept) if any(WORD.search(x) for x in kept) else text, site))
    return out


def plain(text):
    return " " + " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) + " "


def test_stages_equal_brute_force(spark, sf, reference: tiktoken.Encoding):  # noqa: F811
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = [lambda x: [r for r in x if good(r[1])], without_boilerplate, None, lambda x: [r for r in x if not any(i in plain(r[1]) for i in items)]]
    for (_, stage), brute in zip(corpus_pipeline.STAGES[:-1], expected):
        out = written(stage(spark, docs, sf))
        assert out.columns == docs.columns
        if brute is None:
            root = groups([r[:2] for r in rows])
            rows = [r for r in rows if root[r[0]] == r[0]]
        else:
            rows = brute(rows)
        assert sorted((r.doc_id, r.text, r.source) for r in out.collect()) == sorted(rows)
        assert all(r.n_chars == len(r.text) for r in out.collect())
        docs = out
    want = {(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in rows for ids in [reference.encode_ordinary(t)]}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()} == want
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_every_stage_takes_odd_rows(spark, sf):
    df = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns and out.count() <= 12
    kept = corpus_pipeline.near_duplicates(spark, df, sf).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "6", "7", "8", "9", "None", "None"]


def test_rows_of_one_id_with_different_texts_stay(spark, sf):
    a, b = "one text of many words that nobody else has here", "quite another story told in other words by other people"
    rows = [(5, a, "x"), (5, b, "y"), (5, a, "x"), (2, a, "z"), (7, "a third text stands alone among the others here", "z")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), sf).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(2, a), (5, b), (7, rows[4][1])]


def test_a_pending_result_survives_a_run(spark, sf):
    pending = [queries.queries()[q](spark, sf) for q in ("op4_line_dedup", "op5_sharding", "op7_licenses", "op9_suffix_dedup", "op10_minhash")]
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    first = corpus_pipeline.run(spark, sf)
    assert corpus_pipeline.run(spark, sf).count() == first.count() > 0
    assert [x.count() for x in pending] == [n] * 5
