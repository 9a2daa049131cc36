"""Benchmark decontamination by latent semantic retrieval.

The benchmark's words are the vocabulary. Inverse document frequencies come from all documents. A
distributed randomised SVD of TF-IDF passages (those of every document, and every benchmark item)
gives a latent space; each document is searched in windows of words about as long as the items, projected
into that space, for a cosine of SCORE or more with an item. A candidate is confirmed by the longest common
subsequence of words between the item and the window with as many words as the item has on either side: a leak holds CERTAIN of the item's words in
order, or LIKELY of them, as a paraphrase, along with its answer. The answer of an item is its last
sentence; it is present if CERTAIN of its words are in order among the surroundings.

Words are runs of letters and digits, ASCII letters in lower case. Null or empty texts hold no
leak. Null doc_id is carried. Items without words leak nowhere; equal items are reported each. Repeated rows are reported each.
Extra columns are ignored. An empty table on either side gives no leak. A document may leak several items, each once, at its best place.

Scale: two maps over all documents without shuffle (the vocabulary's columns, written once; search). The fit
reads all columns in POWERS + 1 rounds; each of its tasks gives one partial product, vocabulary x rank in floats, and
partials are added up in blocks of ROWS words. The benchmark is a stated query set and is collected; what is
broadcast, or sent to the driver in a round, is the vocabulary of ITEMS items x their rank in floats, whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from veritree.llm.common import scratch, written
from veritree.llm.wordhash import word_hashes

#: Dimensions, extra columns of the range finder, its rounds, words of a passage.
RANK, OVERSAMPLE, POWERS, PASSAGE = 128, 16, 2, 48
#: What an item weighs in the fit, as a share of what all passages of the corpus weigh together, however many.
ITEM_WEIGHT = 1 / 128
#: Passages that are multiplied at once, by their own words only; words whose partial products are added up in one place.
TILE, ROWS = 32, 32
SCORE, CERTAIN, LIKELY = 0.6, 0.8, 0.6
#: Words in more than this share of all documents are left to the subsequence check, unless an item has no LEAST_WORDS rarer ones.
MAX_DF, LEAST_WORDS = 0.1, 8
#: A window is projected if its squared TF-IDF weights sum to this share of what a part of an item of its length has: SCORE squared, less a sixth.
LEAST_MASS = 0.3
#: Benchmark items searched at once, in a latent space of their own; more are searched in blocks of so many.
ITEMS = 400
#: Words that are projected at once, rows whose texts are searched at once, bytes that are hashed at once, and words of a text whose windows are compared together.
BLOCK, SLICE, HASHED, STRETCH = 1 << 16, 256, 1 << 16, 1 << 12

_LUT = np.full(256, 32, np.uint8)
_LUT[128:] = np.arange(128, 256)
for _a, _z in ((48, 58), (97, 123)):
    _LUT[_a:_z] = np.arange(_a, _z)
_LUT[65:91] = np.arange(97, 123)


def hashed_words(text: str | None) -> np.ndarray:
    """The hash of each word of a text."""
    return word_hashes(_LUT[np.frombuffer((text or "").encode(), np.uint8)], fold=False)[0]


def hashed_texts(texts: list[str | None]) -> list[np.ndarray]:
    """The hash of each word of each text; texts are laid end to end, a space between, and hashed in blocks of about HASHED bytes."""
    out: list[np.ndarray] = []
    block: list[bytes] = []
    size = 0
    for k, t in enumerate(texts):
        block.append((t or "").encode())
        size += len(block[-1])
        if size >= HASHED or k == len(texts) - 1:
            h, starts, _ = word_hashes(_LUT[np.frombuffer(b" ".join(block), np.uint8)], fold=False)
            cuts = np.searchsorted(starts, np.cumsum([0, *(len(b) + 1 for b in block)])).tolist()
            out += [h[lo:hi] for lo, hi in zip(cuts, cuts[1:])]
            block, size = [], 0
    return out


@dataclass(frozen=True)
class Item:
    item_id: object
    words: tuple[int, ...]
    answer: tuple[int, ...]


def read_item(item_id: object, text: str | None) -> Item:
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text or "") if len(hashed_words(s))]
    answer = hashed_words(sentences[-1]).tolist() if len(sentences) > 1 else []
    return Item(item_id, tuple(hashed_words(text).tolist()), tuple(answer))


class Vocabulary:
    """Columns of the benchmark's words, found by a table on 16 bits of the hash, and by order where words share these."""

    def __init__(self, items: list[Item], only: np.ndarray | None = None):
        self.hashes = np.unique(np.array([w for i in items for w in i.words], np.uint64)) if only is None else only

    def __len__(self) -> int:
        return len(self.hashes)

    def columns(self, h: np.ndarray) -> np.ndarray:
        """The column of each word, -1 for words outside."""
        if not len(self.hashes) or not len(h):
            return np.full(len(h), -1, np.int64)
        if not hasattr(self, "_first"):
            self._first = np.full(1 << 16, -1, np.int32)
            self._first[(self.hashes >> np.uint64(48))[::-1]] = np.arange(len(self.hashes), dtype=np.int32)[::-1]
        out = self._first[h >> np.uint64(48)].astype(np.int64)
        # words whose bits stand for no word, or for another one first
        at = np.flatnonzero((self.hashes[out] != h) & (out >= 0))
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        out[at] = np.where(self.hashes[place] == h[at], place, -1)
        return out

    def __getstate__(self):
        return {"hashes": self.hashes}


def lcs(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of a pattern of n words, given as bit masks, and words."""
    full = (1 << n) - 1
    row = full
    for w in words:
        if m := masks.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def bit_masks(words: tuple[int, ...]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def window_size(n: int) -> tuple[int, int]:
    """Words and step of the windows for an item of n words: wherever it stands, some window lies inside it."""
    size = 4
    while (bigger := max(size + 1, size * 5 // 4)) + max(1, bigger // 4) - 1 <= n:
        size = bigger
    return (size, max(1, size // 4)) if n >= 4 else (max(1, n), 1)


def running_sums(rows: np.ndarray, stride: int = 32) -> np.ndarray:
    """Sums of the first 0, 1, ... rows; rows of all strides are added up side by side."""
    out = np.zeros((1 + -(-len(rows) // stride) * stride, rows.shape[1]), rows.dtype)
    out[1 : len(rows) + 1] = rows
    steps = out[1:].reshape(-1, stride, rows.shape[1])
    for i in range(1, stride):
        steps[:, i] += steps[:, i - 1]
    if len(steps) > 1:
        steps[1:] += np.cumsum(steps[:-1, -1], axis=0)[:, None]
    return out[: len(rows) + 1]


@dataclass
class Model:
    items: list[Item]
    vocab: Vocabulary
    idf: np.ndarray
    space: np.ndarray  # columns x rank
    least_mass: float = LEAST_MASS

    def prepare(self) -> None:
        """Items by window size, in the latent space."""
        weighted = self.space * self.idf[:, None].astype(np.float32)
        self.weighted = np.ascontiguousarray(weighted, np.float32)
        self.mass = self.idf.astype(np.float64) ** 2
        self.groups = []
        by: dict[tuple[int, int], list[int]] = {}
        for k, item in enumerate(self.items):
            if item.words:
                by.setdefault(window_size(len(item.words)), []).append(k)
        for (size, step), members in sorted(by.items()):
            cols = [c[c >= 0] for c in (self.vocab.columns(np.array(self.items[k].words, np.uint64)) for k in members)]
            vectors = np.stack([self.weighted[c].sum(0) for c in cols])
            norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
            share = size / np.array([len(self.items[k].words) for k in members])
            mass = np.array([self.mass[c].sum() for c in cols])
            self.groups.append((size, step, np.array(members), np.ascontiguousarray((vectors / norms[:, None]).T), norms * 0.9 * np.sqrt(share), self.least_mass * float((share * mass).min())))
        self.masks = [(np.unique(np.array(i.words, np.uint64)), bit_masks(i.words), bit_masks(i.answer)) for i in self.items]

    def candidates(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, cosine) of the windows near an item, of texts given by their words' hashes; texts are laid end to end in blocks."""
        out: list[tuple[int, int, int, int, float]] = []
        longest = max((g[0] for g in self.groups), default=0)
        block: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for k, h in enumerate(texts):
            # a long text goes in parts that overlap by a window; windows that start behind BLOCK belong to the next part
            for at in range(0, len(h), BLOCK):
                block.append((k, at, h[at : at + BLOCK + longest]))
                size += len(block[-1][2])
                if size >= BLOCK:
                    self._scan(block, out)
                    block, size = [], 0
        if block:
            self._scan(block, out)
        return out

    def _scan(self, block: list[tuple[int, int, np.ndarray]], out: list[tuple[int, int, int, int, float]]) -> None:
        cols = self.vocab.columns(np.concatenate([h for _, _, h in block]))
        where = np.flatnonzero(cols >= 0)
        if not len(where):
            return
        lengths = np.array([len(h) for _, _, h in block])
        offsets = np.cumsum(lengths) - lengths
        heavy = np.r_[0.0, np.cumsum(self.mass[cols[where]])]
        # places in `where` of every word's place, so that windows need no search
        place = np.zeros(len(cols) + 1, np.int32)
        np.cumsum(cols >= 0, out=place[1:])
        windows = []
        open_at = np.zeros(len(where) + 1, np.int64)
        for size, step, _, _, _, floor in self.groups:
            last = np.maximum(lengths - size, 0)
            counts = np.where(last < BLOCK, -(-last // step) + 1, (BLOCK - 1) // step + 1)
            part = np.repeat(np.arange(len(block)), counts)
            inner = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * step
            starts = np.minimum(inner, last[part]) + offsets[part]
            lo, hi = place[starts], place[np.minimum(starts + size, offsets[part] + lengths[part])]
            some = np.flatnonzero((hi > lo) & (heavy[hi] - heavy[lo] >= floor))
            part, starts, lo, hi = part[some], starts[some], lo[some], hi[some]
            windows.append((part, starts, lo, hi))
            open_at += np.bincount(lo, minlength=len(open_at)) - np.bincount(hi, minlength=len(open_at))
        # only words of windows that are projected are summed up; a window has all of its own
        inside = np.cumsum(open_at)[:-1] > 0
        at = np.zeros(len(where) + 1, np.int64)
        np.cumsum(inside, out=at[1:])
        sums = running_sums(self.weighted[cols[where[inside]]])
        for (size, _, members, vectors, least, _), (part, starts, lo, hi) in zip(self.groups, windows):
            for b in range(0, len(part), 4096):
                w = slice(b, b + 4096)
                x = sums[at[hi[w]]] - sums[at[lo[w]]]
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                score = (x @ vectors) / np.maximum(norm[:, None], least[None])
                for i, j in zip(*np.nonzero(score >= SCORE)):
                    k, before, _ = block[part[b + i]]
                    out.append((k, int(members[j]), int(before + starts[b + i] - offsets[part[b + i]]), size, float(score[i, j])))

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float, int]]]:
        """For each text (item, cosine, share of the item, share of its answer, first word) of the items that it leaks."""
        hashes = hashed_texts(texts)
        best: list[dict[int, tuple]] = [{} for _ in texts]
        near = sorted(self.candidates(hashes)) if self.groups else []
        for (t, k, _), group in groupby(near, key=lambda c: (c[0], c[1], c[2] // STRETCH)):
            windows = [(start, size, score) for _, _, start, size, score in group]
            item, (own, masks, answer_masks) = self.items[k], self.masks[k]
            n = len(item.words)
            # the places of the item's words in all that surrounds the windows; no other word counts in a subsequence
            first = max(0, windows[0][0] - n)
            text = hashes[t][first : windows[-1][0] + windows[-1][1] + n]
            found_at = np.flatnonzero(own[np.minimum(np.searchsorted(own, text), len(own) - 1)] == text)
            words = text[found_at].tolist()
            bounds = np.searchsorted(found_at, [(max(0, start - n) - first, start + size + n - first) for start, size, _ in windows]).tolist()
            for (start, _, score), (lo, hi) in zip(windows, bounds):
                if (hi - lo) / n < LIKELY:
                    continue
                share = lcs(masks, n, words[lo:hi]) / n
                if share < LIKELY:
                    continue
                answered = lcs(answer_masks, len(item.answer), words[lo:hi]) / len(item.answer) if item.answer else 1.0
                if share >= CERTAIN or answered >= CERTAIN:
                    # rounded, as equal windows differ by what was summed up before them
                    found = (share, round(score, 4), answered, -start, score)
                    if k not in best[t] or found > best[t][k]:
                        best[t][k] = found
        return [[(k, s[4], s[0], s[2], -s[3]) for k, s in sorted(b.items())] for b in best]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batch in parts of at most SLICE rows, with their texts."""
    for at in range(0, batch.num_rows, SLICE):
        b = batch.slice(at, SLICE)
        yield b, b.column(column).to_pylist()


def _pieces(numbers: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Numbers in 32 bits, as one binary value between each two cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 4).astype(np.int32).tobytes()), pa.py_buffer(numbers.astype(np.int32).tobytes())])


def vocabulary_columns(docs: DataFrame, vocab: Vocabulary, text: str = "text") -> DataFrame:
    """passage and col, for each document: the number of its passage and the column of each of its words in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b, texts in (x for batch in batches for x in _texts(batch, 0)):
            hashes = hashed_texts(texts)
            ends = np.cumsum([0, *(len(h) for h in hashes)])
            cols = v.columns(np.concatenate(hashes))
            inside = np.flatnonzero(cols >= 0)
            cuts = np.searchsorted(inside, ends)
            passage = (inside - np.repeat(ends[:-1], np.diff(cuts))) // PASSAGE
            yield pa.RecordBatch.from_arrays([_pieces(x, cuts) for x in (passage, cols[inside])], ["passage", "col"])

    return written(docs.select(F.col(text)).mapInArrow(run, "passage binary, col binary"), "columns")


def document_frequencies(columns: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """The number of documents, and how many hold each word of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(size, np.int64), 0
        for b in batches:
            rows += b.num_rows
            for c in b.column(0):
                total[np.unique(np.frombuffer(c.as_py(), np.int32))] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[rows, total[some]])], ["col", "n"])

    got = columns.select("col").mapInArrow(run, "col long, n long").groupBy("col").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(size, np.int64), 0
    for r in got:
        if r["col"] < 0:
            n = r["n"]
        else:
            out[r["col"]] = r["n"]
    return n, out


def informative(items: list[Item], vocab: Vocabulary, n_docs: int, df: np.ndarray) -> np.ndarray:
    """Which words span the space: those in at most MAX_DF of the documents, and each item's LEAST_WORDS rarest in any case."""
    out = df <= MAX_DF * n_docs
    for item in items:
        cols = np.unique(vocab.columns(np.array(item.words, np.uint64)))
        out[cols[np.argsort(df[cols], kind="stable")[:LEAST_WORDS]]] = True
    return out


def _product(passage: np.ndarray, col: np.ndarray, weights: np.ndarray, m: np.ndarray, total: np.ndarray) -> int:
    """Adds A'Am to total, for the TF-IDF rows A, of unit length, of passages given by their words in order; the number of passages."""
    edges = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.zeros(0, np.int64)
    row = np.cumsum(np.r_[False, passage[1:] != passage[:-1]])
    for at in range(0, len(edges), TILE):
        lo, hi = edges[at], edges[at + TILE] if at + TILE < len(edges) else len(passage)
        own, place = np.unique(col[lo:hi], return_inverse=True)
        n = min(TILE, len(edges) - at)
        tf = np.bincount((row[lo:hi] - at) * len(own) + place, minlength=n * len(own)).reshape(n, len(own))
        a = tf.astype(np.float32) * weights[own]
        a /= np.maximum(np.sqrt(np.einsum("ij,ij->i", a, a)), 1e-9)[:, None]
        total[own] += a.T @ (a @ m[own])
    return len(edges)


def latent_space(columns: DataFrame, items: list[Item], vocab: Vocabulary, idf: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of the passages of all documents and the items. columns are of the whole vocabulary, of which the telling words span the space."""
    spark, size = columns.sparkSession, len(vocab)
    rank = min(RANK, size)
    width = min(size, rank + OVERSAMPLE)
    kept = np.where(telling, np.cumsum(telling) - 1, -1).astype(np.int32)
    cols = [vocab.columns(np.array(i.words, np.uint64)) for i in items if i.words]
    item, col = np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate(cols)

    def product(q: np.ndarray) -> np.ndarray:
        m = q.astype(np.float32)
        shared = spark.sparkContext.broadcast((kept, idf, m))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, weights, m = shared.value
            total, n = np.zeros_like(m), 0
            for b in batches:
                held: list[tuple[np.ndarray, np.ndarray]] = []
                first = waiting = 0
                for k, (p, c) in enumerate(zip(b.column(0), b.column(1))):
                    p, c = np.frombuffer(p.as_py(), np.int32), at[np.frombuffer(c.as_py(), np.int32)]
                    if len(p):
                        held.append((p[c >= 0].astype(np.int64) + first, c[c >= 0]))
                        first += int(p[-1]) + 1
                        waiting += len(p)
                    if held and (waiting >= BLOCK or k == b.num_rows - 1):
                        n += _product(*(np.concatenate(x) for x in zip(*held)), weights, m, total)
                        held, first, waiting = [], 0, 0
            parts = range(0, size, ROWS)
            yield pa.RecordBatch.from_pydict({"part": pa.array([-1, *parts], pa.int32()), "z": [np.array([n], np.float64).tobytes(), *[total[i : i + ROWS].tobytes() for i in parts]]})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, z in zip(b.column(0).to_pylist(), b.column(1)):
                    z = np.frombuffer(z.as_py(), np.float64 if k < 0 else np.float32).astype(np.float64)
                    sums[k] = sums[k] + z if k in sums else z
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "z": pa.array([z.tobytes() for z in sums.values()], pa.binary())})

        got = columns.select("passage", "col").mapInArrow(run, "part int, z binary").repartition("part").mapInArrow(add, "part int, z binary").toArrow().to_pylist()
        shared.unpersist()
        found = {r["part"]: np.frombuffer(r["z"]) for r in got}
        own = np.zeros_like(m)
        _product(item[col >= 0], col[col >= 0], idf, m, own)
        z = own.astype(np.float64) * ITEM_WEIGHT
        if n := found.get(-1, np.zeros(1))[0]:
            z += np.concatenate([found[i] for i in range(0, size, ROWS)]).reshape(size, width) / n
        return z

    q = np.linalg.qr(np.random.default_rng(11).standard_normal((size, width)))[0]
    for _ in range(POWERS):
        q = np.linalg.qr(product(q))[0]
    small = q.T @ product(q)  # the Gram matrix in the space found
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return np.ascontiguousarray((q @ vectors[:, ::-1])[:, :rank], np.float32)


LEAKS = "cosine double, lcs_share double, answer_share double, first_word long"


def _models(own: DataFrame, benchmark: DataFrame) -> Iterator[Model]:
    """A model of each block of ITEMS items with words; own has the text."""
    given = [read_item(r[0], r[1]) for r in benchmark.select("item_id", "text").collect()]
    given = sorted((i for i in given if i.words), key=lambda i: (i.item_id is not None, "" if i.item_id is None else i.item_id, i.words))
    for at in range(0, len(given), ITEMS):
        items = given[at : at + ITEMS]
        vocab = Vocabulary(items)
        with scratch(own.sparkSession):
            columns = vocabulary_columns(own, vocab)
            n_docs, df = document_frequencies(columns, len(vocab))
            telling = informative(items, vocab, n_docs, df)
            vocab, df = Vocabulary(items, vocab.hashes[telling]), df[telling]
            idf = (np.log((1 + n_docs) / (1 + df)) + 0.1).astype(np.float32)
            model = Model(items, vocab, idf, latent_space(columns, items, vocab, idf, telling), LEAST_MASS)
        yield model


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share, first_word: one row for each item that a document leaks."""
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    items = benchmark.schema["item_id"].dataType
    out = None
    for model in _models(own, benchmark):
        found = _search(own, model, kind, items)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {items.simpleString()}, {LEAKS}") if out is None else out


def _search(own: DataFrame, model: Model, kind: str, items: DataType) -> DataFrame:
    item_kind = to_arrow_type(items)
    shared = own.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        m.prepare()
        for b, texts in (x for batch in batches for x in _texts(batch, 1)):
            rows, where = [], []
            for i, found in enumerate(m.leaks(texts)):
                for k, score, share, answered, start in found:
                    rows.append((m.items[k].item_id, score, share, answered, start))
                    where.append(i)
            kinds = (item_kind, pa.float64(), pa.float64(), pa.float64(), pa.int64())
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(where, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds)]], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "first_word"])

    return own.mapInArrow(run, f"doc_id {kind}, item_id {items.simpleString()}, {LEAKS}")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose own text leaks no benchmark item, with all their columns; whatever other rows of their doc_id hold."""
    out = docs
    for model in _models(docs.select("text"), benchmark):
        out = _clean(out, model)
    return out


def _clean(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        m.prepare()
        for b, texts in (x for batch in batches for x in _texts(batch, at)):
            yield b.filter(pa.array([not found for found in m.leaks(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
