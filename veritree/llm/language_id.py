"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier per code bit, over hashed byte n-grams, predicts
that bit, and loss-weighted decoding picks the codeword with the least total logistic loss, each bit of a codeword weighted by how
often its classifier was right on that language's training rows. With k <= 5
languages the code is exhaustive (2^(k-1)-1 bits), beyond that the best of many random dense codes.

Training: a bounded sample of labelled rows, the distinct texts of `per_language` rows expected of each language, chosen by a
hash of the text with a rate from exact counts; at most twice that many in all are fetched, those of least hash
(documented bound: languages x per_language x 2 feature rows of a few kB). Every text is used whole, in
training and prediction, and every row is predicted.

Rows: null text, or text without any letter, is `und` with score 0. Rows without a label are not learned
from. Without any labelled row everything is `und`. Repeated rows are predicted alike. Extra columns are
ignored; the label is read in training only. Ties between languages go to the first in sorted order.

Scale: prediction is one map over the scan, without any shuffle; the model is languages x 2^dims floats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 1 << 11
PER_LANGUAGE = 800
#: Bytes of text that are turned into n-grams at once.
BLOCK = 1 << 22
LETTER = regex.compile(r"\p{L}")


def _lut() -> np.ndarray:
    """Lower-case ASCII letters and non-ASCII bytes stay, everything else is a space."""
    out = np.full(256, 32, np.uint32)
    out[128:] = np.arange(128, 256)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out


LUT = _lut()


def features(data: bytes) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 3-byte n-grams in a whole text, unit length."""
    total = np.zeros(DIMS, np.int64)
    raw = np.frombuffer(b" " + data + b" ", np.uint8)
    for at in range(0, len(raw), BLOCK):
        b = LUT[raw[at : at + BLOCK + 2]]
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(65599) + b[2:] * np.uint32(31)
        for h in (b * np.uint32(2654435761), two * np.uint32(2246822519), three * np.uint32(3266489917)):
            total += np.bincount(h >> np.uint32(32 - 11), minlength=DIMS)
    out = np.sqrt(total.astype(np.float32))
    return out / max(1e-9, float(np.sqrt((out * out).sum())))


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of +1 and -1."""
    if k <= 1:
        return np.ones((k, 1), np.float32)
    if k <= 5:
        bits = np.array([[(n >> i) & 1 for n in range(1 << (k - 1))] for i in range(k - 1)], np.float32)[:, 1:]
        return np.vstack([np.ones((1, bits.shape[1]), np.float32), 1 - 2 * bits]) * np.array([[1]] + [[1]] * (k - 1), np.float32)
    rng, best = np.random.default_rng(seed), None
    for _ in range(200):
        c = rng.choice(np.array([-1, 1], np.float32), (k, max(15, math.ceil(10 * math.log2(k)))))
        if (np.abs(c.sum(0)) == k).any():
            continue
        far = int(((c[:, None] != c[None]).sum(2) + np.eye(k, dtype=int) * 10**6).min())
        if best is None or far > best[0]:
            best = (far, c)
    return best[1]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # dims x bits
    bias: np.ndarray  # bits
    sure: np.ndarray  # languages x bits: how often a bit's classifier was right on a language's training rows, as a weight of mean 1
    margin: float = 0.1

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For feature rows: the language's index, its score, and whether a second codeword is about as near."""
        f = x @ self.weights + self.bias
        # the loss of each codeword, each bit weighted by how sure its classifier was in training
        loss = (self.sure[None] * np.logaddexp(0, -f[:, None, :] * self.codes[None])).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        order = np.sort(p, 1)
        second = order[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, p[np.arange(len(p)), best], order[:, -1] - second < self.margin


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 150, penalty: float = 1e-5) -> Model:
    """One logistic classifier per code bit, by accelerated gradient descent from zero; no randomness."""
    codes = codewords(len(languages))
    target = codes[y]
    w, b = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    n = np.bincount(y, minlength=len(languages))
    each = (1 / (n[y] * len(languages))).astype(np.float32)[:, None]  # languages weigh the same
    vw, vb, rate = np.zeros_like(w), np.zeros_like(b), np.float32(8.0)
    for i in range(rounds):
        pull = np.float32(i / (i + 3))
        lw, lb = w + pull * (w - vw), b + pull * (b - vb)
        m = target * (x @ lw + lb)
        g = -target * each / (1 + np.exp(np.clip(m, -30, 30)))
        vw, vb = w, b
        w, b = lw - rate * (x.T @ g + np.float32(penalty) * lw), lb - rate * g.sum(0) * np.float32(0.1)
    right = (target * (x @ w + b) > 0).astype(np.float64)
    sure = np.stack([right[y == k].mean(0) for k in range(len(languages))])
    sure *= codes.shape[1] / np.maximum(sure.sum(1, keepdims=True), 1e-9)
    return Model(tuple(languages), codes, w.astype(np.float32), b.astype(np.float32), sure)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _none() -> Model:
    return Model((), np.zeros((0, 1), np.float32), np.zeros((DIMS, 1), np.float32), np.zeros(1, np.float32), np.zeros((0, 1)))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, text: str = "text", label: str = "lang") -> Model:
    """A model from the labelled rows of docs: about per_language distinct texts of each language, chosen by a hash of the text."""
    rows = docs.select(F.col(text).alias("text"), F.col(label).alias("label"), F.xxhash64(text).alias("h")).filter(F.col("label").isNotNull() & has_letter(F.col("text")))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row per language
    if not counts:
        return _none()
    languages = sorted(counts)
    grain = 1 << 30
    rate = F.lit(0)
    for name, n in counts.items():
        rate = F.when(F.col("label") == name, F.lit(min(grain, per_language * grain // n))).otherwise(rate)
    chosen = rows.filter(F.pmod("h", F.lit(grain)) < rate).dropDuplicates(["h", "label"]).orderBy("h", "label").limit(2 * per_language * len(languages)).select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist()):
                x = features(t.as_py().encode())
                yield pa.RecordBatch.from_pydict({"label": [y], "x": [x.astype(np.float32).tobytes()]})

    got = chosen.mapInArrow(run, "label string, x binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["label"], r["x"]))
    if not got:
        return _none()
    present = sorted({r["label"] for r in got})
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    return fit(x, np.array([present.index(r["label"]) for r in got]), present)


def identify(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns, lang_pred, score, ambiguous; only the text is used."""
    shown = docs.select(*carry, F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema.fields[:-1]] + ["lang_pred string", "score double", "ambiguous boolean"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages x DIMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                n = b.num_rows
                lang, score, unsure = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
                texts = b.column(b.num_columns - 1)
                rows, xs = [], []
                for i in range(n):
                    t = texts[i].as_py()
                    if t and m.languages and LETTER.search(t):
                        rows.append(i)
                        xs.append(features(t.encode()))
                if rows:
                    best, p, close = m.predict(np.stack(xs))
                    lang[rows], score[rows], unsure[rows] = np.array(m.languages, object)[best], p, close
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], [*b.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    return shown.mapInArrow(run, schema)
