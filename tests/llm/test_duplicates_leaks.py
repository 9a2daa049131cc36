import collections
import hashlib
import pathlib
import random
import re

import numpy as np
import pytest

from tests.llm.cases import no_documents, odd_documents
from veritree.llm import components, decontamination, minhash, suffix_array, suffix_dedup
from veritree.plans import shared
from veritree.plans.shared import written
from veritree.llm.wordhash import shingle_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    """component of each row by all pairs."""
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for a, sa in sets:
        for b, sb in sets:
            if sa and sb and 100 * len(sa & sb) >= 75 * len(sa | sb):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(seed, groups_=6, size=18, length=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    rows = []
    for _ in range(groups_):
        base = [r.choice(vocabulary) for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append(" ".join(w))
    rows += [" ".join([r.choice(vocabulary) for _ in range(40)] + passage) for _ in range(40)]
    rows += ["one two", "One  Two", "one two three", "a b c d e", "A b c d e"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("ball,most,small", [(1024, 1 << 16, 16), (5, 1 << 16, 3), (6, 4, 3)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, ball, most, small):
    monkeypatch.setattr(minhash, "BALL", ball)
    monkeypatch.setattr(minhash, "MOST_BALL", most)
    monkeypatch.setattr(minhash, "SMALL_LIST", small)
    rows = near_copies(ball)
    got = {x.doc_id: x for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = groups(rows)
    assert {i: x.component_id for i, x in got.items()} == want
    assert all(got[i].n_shingles == len(shingles(t)) and got[i].kept == (want[i] == i) for i, t in rows)


def test_near_duplicates_of_odd_rows(spark):
    got = minhash.near_duplicates(odd_documents(spark)).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == 12 and minhash.near_duplicates(no_documents(spark)).count() == 0
    assert all(by[i].component_id == i and by[i].n_shingles == 0 and by[i].kept for i in (1, 2, 3))
    assert by[4].component_id == by[5].component_id == 4 and not by[5].kept
    assert all(not x.kept for x in got if x.doc_id is None)


def test_shingle_sets_and_intersections():
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("a b")) == 1 and len(shingle_set(" \n")) == 0
    assert (shingle_set("A B c d e") == shingle_set("a b  C D E")).all()
    sets = [np.unique(np.random.default_rng(i).integers(0, 60, 30)) for i in range(9)]
    want = [[len(set(a) & set(b)) for b in sets] for a in sets]
    assert (minhash.intersections(sets) - np.array(want))[~np.eye(9, dtype=bool)].any() == False  # noqa: E712


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 60), (7, 7), (1, 0)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 100: 50}


def test_cover_and_suffix_order():
    c = set(suffix_array.cover().tolist())
    assert {(a - b) % suffix_array.V for a in c for b in c} == set(range(suffix_array.V))
    r = np.random.default_rng(0)
    for t in range(12):
        n = int(r.integers(60, 900))
        text = r.integers(97, 97 + r.integers(1, 4), n).astype(np.uint8)
        starts = np.arange(n - 49)
        seen = collections.Counter(text[i : i + 50].tobytes() for i in starts)
        assert suffix_array.repeated(text, starts, 50).tolist() == [seen[text[i : i + 50].tobytes()] > 1 for i in starts]
        order = suffix_array.suffix_order(text, starts, 50)
        assert all(text[a : a + 50].tobytes() <= text[b : b + 50].tobytes() for a, b in zip(order, order[1:]))


def removed(texts):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i : i + 200] for x in data for i in range(len(x) - 199))
    out = []
    for x in data:
        cover = bytearray(len(x))
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                cover[i : i + 200] = b"\1" * 200
        left = bytes(b for b, c in zip(x, cover) if not c)
        out.append((len(x), sum(cover), sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1])), left))
    return out


@pytest.mark.parametrize("hot", [2 << 20, 1500])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot):
    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh é") for _ in range(r.randrange(150, 900))) for _ in range(12)]
    texts = [None, "", "x" * 199, "x" * 200, "x" * 201, "y" * 3000, "ab" * 300, base[0], base[0], base[1][:210], base[1][:200] + "Q"]
    texts += [a[: r.randrange(len(a))] + b[r.randrange(len(b)) :] for a, b in ((r.choice(base), r.choice(base)) for _ in range(30))]
    texts += ["p" * 30 + base[2][:260] + "q" * i for i in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", ("doc_id", "text", hot))
    got = suffix_dedup.digests(df).orderBy("doc_id").collect()
    want = removed(texts)
    assert [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got] == [(*w[:3], hashlib.sha256(w[3]).hexdigest()) for w in want]
    if hot > 1500:
        assert [bytes(x.kept) for x in suffix_dedup.kept(df).orderBy("doc_id").collect()] == [w[3] for w in want]


def test_suffix_dedup_of_odd_rows(spark):
    got = suffix_dedup.digests(odd_documents(spark)).collect()
    assert len(got) == 12 and suffix_dedup.digests(no_documents(spark)).count() == 0
    assert {x.n_removed for x in got if x.doc_id in (1, 2, 3, 4, 8)} == {0}


def test_suffix_dedup_of_copies_and_one_id(spark):
    """Copies with the same and with other doc_ids (or none) are removed whole, and what other texts share with them is found."""
    r = random.Random(5)
    a, b = ("".join(r.choice("abcdefgh") for _ in range(900)) for _ in range(2))
    rows = [(1, a), (1, a), (2, a), (None, a), (1, b), (3, "z" * 50 + b[100:600] + "y" * 20), (4, a[:450] + "x" * 30), (5, b[:230])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.digests(df).collect())
    assert got == sorted((d or 0, *w[:3], hashlib.sha256(w[3]).hexdigest()) for (d, _), w in zip(rows, removed([t for _, t in rows])))


def on_disk(spark, job):
    """Bytes that a job writes into shuffles and tables if nothing is deleted meanwhile."""
    sc = spark.sparkContext._jsc.sc()
    stages = lambda: sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    top = pathlib.Path(shared.shared_dir(spark).removeprefix("file://"))
    sizes = lambda: {p: p.stat().st_size for p in top.rglob("*.parquet")}
    sc.listenerBus().waitUntilEmpty()
    before, tables = {stages().apply(i).stageId() for i in range(stages().size())}, sizes()
    job()
    sc.listenerBus().waitUntilEmpty()
    found = stages()
    shuffled = sum(x.shuffleWriteBytes() for x in (found.apply(i) for i in range(found.size())) if x.stageId() not in before)
    return shuffled + sum(n for p, n in sizes().items() if p not in tables)


def test_suffix_dedup_takes_little_disk(spark, monkeypatch):
    """All tables and shuffles together, as old shuffles stay until the driver collects its garbage: texts move once, bytes of pieces only where digests leave something open."""
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(5000)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(500)) for _ in range(600)]
    for i in range(0, 270):  # some take over half of another text, the half of these with a change
        t = texts[300 + i][:1500]
        texts[i] = (t[:700] + "#" * (i % 2) + t[700:]) + texts[i][1500:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for where in (shared, suffix_dedup):
        monkeypatch.setattr(where, "dropped", lambda *_: None, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        took = on_disk(spark, lambda: suffix_dedup.digests(df).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    size = sum(map(len, texts))
    assert took < 4 * size


def item(r, vocabulary, n):
    return ". ".join(" ".join(r.choice(vocabulary) for _ in range(n // 2)).capitalize() for _ in range(2)) + "."


def test_texts_of_one_id_are_one_component(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "nobody has these words but me alone")
    rows = [(5, a), (5, b), (2, a), (3, b), (9, c), (9, b)]
    got = sorted({(x.doc_id, x.component_id, x.kept) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()})
    assert got == [(2, 2, True), (3, 2, False), (5, 2, False), (9, 2, False)]


def test_leaks_are_found_and_clean_documents_left(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 8))) for _ in range(3000)]
    items = [(k, item(r, vocabulary, r.randrange(16, 58))) for k in range(30)] + [(98, None), (99, "?!")]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows, want, loose = [], set(), set()
    for i in range(150):
        t = text(r.randrange(5, 400))
        if i % 3 == 0:
            k = r.randrange(30)
            t, want = t + " " + items[k][1].upper() + " " + text(r.randrange(60)), want | {(i, k)}
        elif i % 10 == 1:
            k = r.randrange(30)
            w = items[k][1].split()
            t, loose = t + " " + " ".join(x for j, x in enumerate(w) if j % 8 != 3) + " " + text(20), loose | {(i, k)}
        rows.append((i, t))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.leaks(docs, bench).collect()}
    assert want <= got and got <= want | loose and len(got & loose) >= 0.8 * len(loose)
    left = decontamination.decontaminated(docs, bench)
    assert {x.doc_id for x in left.collect()} == set(range(150)) - {i for i, _ in got}


def brute_leaks(rows, items):
    """Every window of an item's length with as many words on either side, by plain longest common subsequences."""

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    out = set()
    for i, t in rows:
        w = decontamination.hashed_words(t).tolist()
        for it in (decontamination.read_item(k, x) for k, x in items):
            n = len(it.words)
            if n and len(set(w) & set(it.words)) >= decontamination.LIKELY * len(set(it.words)):
                for at in range(max(1, len(w) - n + 1)):
                    around = w[max(0, at - n) : at + 2 * n]
                    share = lcs(it.words, around) / n
                    answered = lcs(it.answer, around) / len(it.answer) if it.answer else 1.0
                    if share >= decontamination.CERTAIN or share >= decontamination.LIKELY and answered >= decontamination.CERTAIN:
                        out.add((i, it.item_id))
                        break
    return out


@pytest.mark.parametrize("mass, max_df", [(decontamination.LEAST_MASS, decontamination.MAX_DF), (0.0, 1.0)])
def test_recall_of_edited_leaks(spark, monkeypatch, mass, max_df):
    monkeypatch.setattr(decontamination, "LEAST_MASS", mass)
    monkeypatch.setattr(decontamination, "MAX_DF", max_df)
    r = random.Random(13)
    common = ["the", "of", "and", "to", "in", "is", "it", "for", "on", "with"]
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 8))) for _ in range(1500)]
    draw = lambda n: [r.choice(common) if r.random() < 0.4 else r.choice(vocabulary) for _ in range(n)]
    items = [(f"q{k}", " ".join(draw(r.randrange(16, 40))) + ". " + " ".join(draw(4)) + ".") for k in range(40)]
    rows = []
    for i in range(160):
        k = i % 40
        question, answer = items[k][1].split(". ")
        w = [x if r.random() >= (0.1, 0.2, 0.3, 0.38)[i // 40] else r.choice(vocabulary) for x in question.split()]
        rows.append((i, " ".join(draw(r.randrange(20, 80)) + w) + ". " + answer + " " + " ".join(draw(r.randrange(60)))))
    rows += [(200 + i, " ".join(draw(200))) for i in range(40)]
    true = brute_leaks(rows, items)
    got = {(x.doc_id, x.item_id) for x in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert len(true) >= 120 and got <= true and len(got) >= 0.9 * len(true), (len(got), len(true))


def test_candidate_recall_on_the_tables(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: " " + " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) + " "
    items = [(x.item_id, norm(x.text)) for x in bench.collect()]
    true = {(x.doc_id, k) for x in docs.collect() for k, s in items if s in norm(x.text)}
    got = {(x.doc_id, x.item_id) for x in decontamination.leaks(docs, bench).collect()}
    assert true and true <= got and len(got - true) <= 0.05 * len(true)


def test_leaks_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs far")], "item_id long, text string")
    got = decontamination.leaks(odd_documents(spark), bench).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got) == [(False, 4), (False, 4), (False, 5), (True, 0)]
    assert decontamination.leaks(no_documents(spark), bench).count() == 0
    assert decontamination.leaks(odd_documents(spark), bench.limit(0)).count() == 0
    assert decontamination.lcs(decontamination.bit_masks((1, 2, 3, 4)), 4, [9, 1, 3, 2, 4]) == 3


def test_the_space_is_of_all_documents(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(600)]
    bench = spark.createDataFrame([(k, item(r, vocabulary, 24)) for k in range(80)], "item_id long, text string")
    items = [x.text for x in bench.orderBy("item_id").collect()]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(40)) + (" " + items[i % 80] if i % 10 == 0 else "")) for i in range(3000)]
    got = []
    for move in (0, 1 << 20):
        docs = spark.createDataFrame([(i + move, t) for i, t in rows], "doc_id long, text string").repartition(7)
        got.append({(x.doc_id - move, x.item_id): (x.cosine, x.lcs_share, x.first_word) for x in decontamination.leaks(docs, bench).collect()})
    assert {(i, i % 80) for i in range(0, 3000, 10)} <= got[0].keys() == got[1].keys()
    assert all(abs(a - b) < 1e-3 for k in got[0] for a, b in zip(got[0][k], got[1][k]))


def test_products_are_of_every_passage(spark, monkeypatch):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(150)]
    items = [decontamination.read_item(k, " ".join(r.choice(vocabulary) for _ in range(12))) for k in range(20)]
    vocab = decontamination.Vocabulary(items)
    texts = [None, "", "none of it"] + [" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 200))) for _ in range(1500)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    monkeypatch.setattr(decontamination, "RANK", 40)
    monkeypatch.setattr(decontamination, "OVERSAMPLE", 200)  # the whole range: no approximation
    columns = decontamination.vocabulary_columns(docs, vocab)
    n, df = decontamination.document_frequencies(columns, len(vocab))
    cols = [vocab.columns(decontamination.hashed_words(t)) for t in texts]
    assert n == len(texts) and df.tolist() == [sum(k in c for c in cols) for k in range(len(vocab))]
    idf, telling = np.linspace(1, 2, len(vocab)).astype(np.float32), np.ones(len(vocab), bool)

    def gram(passages):
        a = np.array([np.bincount(c[c >= 0], minlength=len(vocab)) * idf for c in passages if (c >= 0).any()])
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        return a.T @ a, len(a)

    of_docs, n = gram([c[i : i + decontamination.PASSAGE] for c in cols for i in range(0, len(c), decontamination.PASSAGE)])
    want = of_docs / n + decontamination.ITEM_WEIGHT * gram([vocab.columns(np.array(i.words, np.uint64)) for i in items])[0]
    space = decontamination.latent_space(columns, items, vocab, idf, telling)
    assert np.trace(space.T @ want @ space) > 0.9999 * np.linalg.eigvalsh(want)[::-1][: space.shape[1]].sum()


def test_a_leak_takes_only_its_own_row(spark):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs far"), (2, "lorem ipsum dolor sit amet")], "item_id long, text string")
    df = odd_documents(spark).unionByName(odd_documents(spark).filter("doc_id = 8").selectExpr("4L as doc_id", "text", "lang", "source", "n_chars", "n_words", "shard", "`clean`"))
    for items in (400, 1):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(decontamination, "ITEMS", items)
            out = decontamination.decontaminated(df, bench)
            got = out.collect()
        assert out.columns == df.columns
        want = [r for r in df.collect() if not re.search("brown|lorem", r.text or "")]
        assert len(want) == 8 and sorted(map(str, got)) == sorted(map(str, want))


def test_components_do_not_run_rounds_on_stars(spark, monkeypatch):
    from veritree.llm import components as module

    made = []
    monkeypatch.setattr(module, "written", lambda df, name: made.append(name) or written(df, name))
    links = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = lambda rows: {r.node: r.component for r in module.components(links(rows)).collect()}
    assert got([(1, 2), (3, 1), (9, 9), (7, 8), (8, 7)]) == {1: 1, 2: 1, 3: 1, 9: 9, 7: 7, 8: 7} and len(made) == 1
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 99), (98, 99), (50, 50)]
    assert got(chain) == {k: 1 for k in range(1, 41)} | {98: 98, 99: 98, 100: 98, 50: 50}
    assert got([(5, 1), (5, 2), (6, 2)]) == {1: 1, 2: 1, 5: 1, 6: 1}
    assert got([]) == {}


def test_texts_are_hashed_and_compared_together(monkeypatch):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [decontamination.read_item(k, " ".join(r.choice(vocabulary) for _ in range(14))) for k in range(6)] + [decontamination.read_item(6, "rare one. rare two")]
    vocab = decontamination.Vocabulary(items)
    model = decontamination.Model(items, vocab, np.ones(len(vocab), np.float32), np.eye(len(vocab), dtype=np.float32))
    model.prepare()
    spell = dict(zip(decontamination.hashed_words(" ".join(vocabulary)).tolist(), vocabulary))
    texts = [" ".join(r.choice(vocabulary) for _ in range(30)) for _ in range(400)]
    texts += [" ".join(r.choice(vocabulary) for _ in range(9)) + " " + " ".join(spell[w] for w in i.words) for i in items[:6]]
    texts += ["x " * 20 + " ".join(spell[w] for w in items[0].words[:8]) + " x" * 20] * 50  # near by cosine, with too few of its words
    texts += [None, "", " ", "w1", "w2", "éW1-w2\x00", "w3 " * 40000, "rare one rare two"]
    each = [decontamination.hashed_words(t) for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(each, decontamination.hashed_texts(texts), strict=True)) and not decontamination.hashed_texts([])
    alone = [model.leaks([t])[0] for t in texts]
    calls = collections.Counter()
    for name in ("word_hashes", "lcs"):
        monkeypatch.setattr(decontamination, name, lambda *a, f=getattr(decontamination, name), n=name, **b: (calls.update([n]), f(*a, **b))[1])
    got = model.leaks(texts)
    assert [[(x[0], *x[2:]) for x in g] for g in got] == [[(x[0], *x[2:]) for x in g] for g in alone]
    assert [k for g in got[400:406] for k, *_ in g] == list(range(6)) and got[-1][0][0] == 6
    twice = " ".join(spell[w] for w in items[3].words)
    assert {g[0][4] for g in model.leaks([texts[0], *[f"{twice} {'x ' * 40}{t} {twice}" for t in texts[:300]]])[1:]} == {0}  # of equal places the first
    calls.clear()
    model.leaks(texts)
    near = len(model.candidates(each))
    assert calls["word_hashes"] <= 5 and 0 < calls["lcs"] < near


def test_running_sums_and_columns():
    r = np.random.default_rng(2)
    for n in (0, 1, 31, 32, 33, 1000):
        rows = r.random((n, 5))
        assert np.allclose(decontamination.running_sums(rows), np.r_[np.zeros((1, 5)), np.cumsum(rows, axis=0)])
    # words that share their first 16 bits, in the vocabulary and outside
    hashes = np.array([5 << 48, (5 << 48) + 1, (5 << 48) + 9, 7 << 48], np.uint64)
    vocab = decontamination.Vocabulary([], hashes)
    assert vocab.columns(np.r_[hashes, hashes + np.uint64(2), np.array([0, 1 << 63], np.uint64)]).tolist() == [0, 1, 2, 3, -1, -1, -1, -1, -1, -1]
