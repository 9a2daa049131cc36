import base64
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.cases import no_documents, odd_documents
from veritree.llm import bpe, chat, language_id, queries


def test_codewords_are_far_apart():
    for k in (2, 3, 4, 5, 9):
        c = language_id.codewords(k)
        assert min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) >= max(1, c.shape[1] // 4)


def test_held_out_accuracy(spark):
    out = queries.op3_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    m = out.merge(truth, on="doc_id")
    held = m[m.held_out & m.lang.notna()]
    assert len(out) == len(truth) and len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.97
    assert out.score.between(0, 1).all()


def plain_features(data):
    """The features by loops over bytes, n-gram by n-gram."""
    low = lambda c: c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32
    b = [low(c) for c in b" " + data + b" "]
    total = [0] * language_id.DIMS
    cut = lambda x: x & 0xFFFFFFFF
    for i, x in enumerate(b):
        grams = [cut(x * 2654435761)]
        if i + 1 < len(b):
            two = cut(x * 257 + b[i + 1])
            grams.append(cut(two * 2246822519))
            if i + 2 < len(b):
                grams.append(cut(cut(two * 65599 + b[i + 2] * 31) * 3266489917))
        for g in grams:
            total[g >> 21] += 1
    norm = math.sqrt(sum(total))
    return [math.sqrt(t) / norm for t in total]


def plain_decode(model, x):
    """The language, score and margin by loops over codewords and bits."""
    f = [sum(a * w for a, w in zip(x, model.weights[:, j])) + model.bias[j] for j in range(len(model.bias))]
    losses = [sum(s * math.log1p(math.exp(-c * y)) for s, c, y in zip(sure, code, f)) for sure, code in zip(model.sure, model.codes)]
    shares = [math.exp(min(losses) - x) for x in losses]
    ranked = sorted((s / sum(shares) for s in shares), reverse=True)
    return model.languages[losses.index(min(losses))], ranked[0], ranked[0] - ranked[1]


def test_predictions_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs.filter("doc_id % 2 = 0"))
    rows = [r for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)][:60]
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for r in rows:
        x = plain_features(r.text.encode())
        assert max(abs(a - b) for a, b in zip(x, language_id.features(r.text.encode()))) < 1e-5
        lang, score, margin = plain_decode(model, x)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-3
        assert abs(margin - model.margin) < 1e-3 or got[r.doc_id].ambiguous == (margin < model.margin)


def test_training_descends_to_the_same_loss_as_plain_descent():
    r = np.random.default_rng(3)
    y = np.arange(90) % 3
    x = np.abs(r.standard_normal((90, 12)) + 2 * np.eye(3)[y].repeat(4, 1)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = language_id.fit(x, y, ["a", "b", "c"], rounds=400)
    assert (model.predict(x)[0] == y).mean() > 0.9 and np.allclose(model.sure.mean(1), 1)
    for j in range(model.codes.shape[1]):
        t = model.codes[y, j]
        loss = lambda w, b: float(np.logaddexp(0, -t * (x @ w + b)).mean())
        w, b = np.zeros(12), 0.0
        for _ in range(20000):
            g = -t / (1 + np.exp(t * (x @ w + b))) / 90
            w, b = w - 2.0 * (x.T @ g), b - 0.2 * g.sum()
        assert loss(model.weights[:, j], model.bias[j]) < loss(w, b) + 0.05 < loss(np.zeros(12), 0.0)


def test_a_loop_over_nothing_is_an_error_of_the_template():
    with pytest.raises(chat.TemplateError):
        chat.render("{% for x in missing %}a{% endfor %}", [])


def test_language_of_odd_rows(spark):
    df = odd_documents(spark)
    got = language_id.identify(df, language_id.train(df)).toPandas()
    assert len(got) == 12 and (got[got.doc_id.isin([1, 2, 3, 7])].lang_pred == "und").all()
    empty = language_id.train(no_documents(spark))
    assert set(language_id.identify(df, empty).toPandas().lang_pred) == {"und"}
    assert language_id.identify(no_documents(spark), empty).count() == 0


@pytest.mark.parametrize("text", ["", "<", "<|", "<\\|x", "<|im_end|><|im_start|>", "a\\nb\n<\\\\|", "\\", "<<|\\|"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_templates_fold_and_are_sandboxed():
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% else %}d{% endif %}{# no #}{{ x.y }}"))
    assert tree[0] == chat.Emit(chat.Const("abCd")) and len(tree) == 2
    for bad in ("{{ x.__class__ }}", "{{ f() }}", "{% import os %}", "{{ x | system }}", "{% for a in b %}", "{{ }}", "{{ a['b'] }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    text, spans = chat.render("{% for m in messages %}{% if loop.first and not m.skip %}>{% endif %}{% generation %}{{ m.text }}{% endgeneration %};{% endfor %}", [{"text": "one"}, {"text": None}])
    assert text == ">one;;" and [text[a:b] for a, b in spans] == ["one"]
    with pytest.raises(chat.TemplateError):
        chat.render("{{ messages.append }}", [])


def test_conversations_read_back(spark):
    r = random.Random(1)
    parts = ["<|im_end|>", "<", "\\", "|", "\n", "<|im_start|>assistant\n", "hi", "é", ""]
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "odd\nrole"]), r.choice([None, "".join(r.choices(parts, k=6))])) for c in (1, 2, 3, None) for t in range(15)]
    rows += rows[:3] + [(9, None, "assistant", "x")]
    got = {x.conv_id: x for x in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 5
    for conv, x in got.items():
        mine = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        turns = "".join(f"{m[2]}\n{m[3]}\n" for m in mine)
        loss = "".join(m[3] for m in mine if m[2] == "assistant")
        assert (x.n_turns, x.turns_sha256) == (len(mine), hashlib.sha256(turns.encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        whole, spans = chat.render(chat.CHATML, [{"role": m[2], "text": m[3]} for m in mine])
        assert x.formatted_chars == len(whole) and "".join(chat.unescape(whole[a:b]) for a, b in spans) == loss
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.fixture(scope="module")
def vocab():
    return bpe.public_vocabulary()


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(vocab, reference):
    r = random.Random(4)
    texts = [None, "", " ", "a" * 1001, "ab" * 300, " " * 500, "日本語" * 200, "'s it's <|endoftext|>\x00", "".join(r.choice("abcde") for _ in range(1500))]
    texts += ["".join(r.choice("aA1 .\n日é'") for _ in range(r.randrange(200))) for _ in range(150)]
    codec = bpe.Codec(vocab)
    ids = [np.frombuffer(x, np.int32) for x in codec.encode(texts)]
    assert [x.tolist() for x in ids] == [reference.encode_ordinary(t or "") for t in texts]
    assert list(codec.decode(ids)) == [(t or "").encode() for t in texts]
    with pytest.raises(ValueError):
        list(codec.decode([np.array([50256], np.int32)]))


def test_long_texts_go_in_pieces(vocab, reference, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    monkeypatch.setattr(bpe, "BLOCK_TOKENS", 7)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    texts = ["some words that go on and on, far beyond a block of fifty characters", "short", "again some words that go on and on"]
    codec = bpe.Codec(vocab)
    ids = [np.frombuffer(x, np.int32) for x in codec.encode(texts)]
    assert [x.tolist() for x in ids] == [reference.encode_ordinary(t) for t in texts]
    assert [x.decode() for x in codec.decode(ids)] == texts


class Counted:
    """A connection that counts its queries."""

    def __init__(self, con):
        self.con, self.queries = con, []

    def __getattr__(self, name):
        return getattr(self.con, name)

    def sql(self, query):
        self.queries.append(query)
        return self.con.sql(query)


def test_new_words_of_many_texts_are_one_query(vocab, reference):
    r = random.Random(5)
    texts = [" ".join("".join(r.choices("abcdefghé", k=9)) for _ in range(1000)) for _ in range(40)]
    codec = bpe.Codec(vocab)
    codec.con = Counted(codec.con)
    ids = list(codec.encode(texts))
    assert [x.tolist() for x in ids] == [reference.encode_ordinary(t) for t in texts]
    assert len(codec.con.queries) == 1
    assert [x.tolist() for x in codec.encode(texts[::-1])] == [x.tolist() for x in ids[::-1]] and len(codec.con.queries) == 1
    assert list(codec.decode(ids)) == [t.encode() for t in texts]
    assert len(codec.con.queries) == 2 and "ORDER BY i" not in codec.con.queries[-1]


@pytest.mark.parametrize("words, chars", [(3, 10**6), (10**6, 12)])
def test_full_generations_hand_on_their_words(vocab, reference, monkeypatch, words, chars):
    monkeypatch.setattr(bpe, "CACHE_WORDS", words)
    monkeypatch.setattr(bpe, "CACHE_CHARS", chars)
    codec = bpe.Codec(vocab)
    codec.con = Counted(codec.con)
    for text in ("one two three", "one four two", "two five one", "x" * 3000 + " one two", "one two " + "z" * 300, "six", "seven six one"):
        assert [x.tolist() for x in codec.encode([text, None, text])] == [reference.encode_ordinary(t) for t in (text, "", text)]
        assert len(codec.known) + len(codec.older) <= 8
    asked = len(codec.con.queries)
    assert [x.tolist() for x in codec.encode(["seven six one"])] == [reference.encode_ordinary("seven six one")]
    assert len(codec.con.queries) == asked


def test_no_id_beyond_the_vocabulary_is_decoded(vocab):
    codec = bpe.Codec(vocab)
    last = len(vocab.tokens) - 1
    assert list(codec.decode([np.array([last, 0], np.int32), np.zeros(0, np.int32)])) == [vocab.tokens[last] + vocab.tokens[0], b""]
    for bad in (-1, last + 1, 2**31 - 1):
        with pytest.raises(ValueError):
            list(codec.decode([np.array([0, bad, 0], np.int32)]))


def test_digests_of_odd_rows(spark, vocab, reference):
    df = odd_documents(spark)
    got = bpe.digests(df, vocab).collect()
    want = sorted((hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), len(ids)) for x in df.collect() for ids in [reference.encode_ordinary(x.text or "")])
    assert sorted((x.ids_sha256, x.n_tokens) for x in got) == want
    assert sorted(x.decoded_sha256 for x in got) == sorted(hashlib.sha256((x.text or "").encode()).hexdigest() for x in df.collect())
    assert bpe.digests(no_documents(spark), vocab).count() == 0
    two = bpe.decode(bpe.encode(df, vocab), vocab).select(F.col("decoded").cast("string"))
    assert sorted(x[0] for x in two.collect()) == sorted(x.text or "" for x in df.collect())
