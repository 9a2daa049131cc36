"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

A vocabulary file gives byte strings by rank; a text is split by a pattern, and in each word the
leftmost pair of least rank is merged until no pair has a rank. Here each task splits its texts and numbers their words, hands
the distinct words it has not met yet to DuckDB, and joins the answers up again. In DuckDB a word is a
string with one character for each id, whose positions become rows that join the merge table; each step of the
recursive query contracts the minimum-rank pair of every word that still has one, until the fixpoint. The leftmost occurrence of that
pair goes first, then its others in the same step, which they would be next anyway: a merge makes only pairs of higher
rank, since a token's parts are found by lower ranks (load_vocabulary). Words of all lengths take this one way. Decoding is a
DuckDB query as well: it selects the ids of a text from the list of the vocabulary's byte strings, in their order.

Null text is empty and has no tokens; so has empty text. Invalid ids in decoding raise ValueError.
Repeated rows are encoded alike; extra columns are carried if named in `carry`. No special tokens are
recognised in texts. An empty table gives an empty table.

Scale: a map over the scan, without shuffle. A task holds one slice of texts (SLICE_BYTES), the words of one text, or of
a piece of a long one, and two generations of a word cache, each closed by the block of texts that makes it full (CACHE_WORDS, CACHE_CHARS).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text split at once, words of a piece of a longer one and tokens decoded at once, tokens of one row that is decoded.
BLOCK_CHARS, BLOCK_TOKENS, PIECE_TOKENS = 1_000_000, 250_000, 4096
#: Words of texts that are numbered before the new ones among them are encoded.
BLOCK_WORDS = 1_000_000
#: Characters of the words of one recursive query; tokens of a word that are scanned as one string.
BLOCK_BYTES, PART = 600_000, 256
#: Words and characters with which a generation of the cache is full.
CACHE_WORDS, CACHE_CHARS = 300_000, 12_000_000
#: Rows and bytes of texts that are encoded and decoded before they are sent on.
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20
DUCK_MEMORY = "150MB"


@dataclass(frozen=True)
class Vocabulary:
    """Byte strings by rank, the id of each byte, and the merges (pair of ids -> id)."""

    name: str
    pattern: str
    tokens: tuple[bytes, ...]
    byte_ids: np.ndarray
    pairs: np.ndarray
    merged: np.ndarray


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    """From a rank file: a line has a base64 byte string and its rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    pairs, merged = [], []
    for token, rank in ranks.items():
        # a token's two parts are what its bytes merge to by lower ranks
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None and r < rank]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            pairs.append((ranks[parts[0]] << 32) | ranks[parts[1]])
            merged.append(rank)
    if missing := [i for i in range(256) if bytes([i]) not in ranks]:
        raise ValueError(f"the vocabulary lacks the byte {missing[0]}")
    ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
    return Vocabulary(path, pattern, tuple(tokens), ids, np.array(pairs, np.int64), np.array(merged, np.int32))


#: One step: the positions of every word join the merge table; its minimum-rank pair (k is the merged token and its two parts, one
#: character each) is contracted, leftmost first, wherever it stands. A word without such a pair has no next step: its last one is the answer.
ENCODE = """
WITH RECURSIVE t AS (
  SELECT w, s, 0 AS step FROM words
  UNION ALL
  SELECT w, replace(s, k[2:], k[1]), step
  FROM (
    SELECT w, first(s) AS s, min(k) AS k, first(step) + 1 AS step
    FROM (
      SELECT w, s, step, substring(part, unnest(range(1, length(part))), 2) AS pair
      FROM (SELECT w, s, step, {part} AS part FROM t)
    ) JOIN merges USING (pair)
    GROUP BY w
  )
)
SELECT w, arg_max(s, step) AS s FROM t GROUP BY w ORDER BY w
"""
#: What is scanned as one string: a word, or its parts of PART tokens, each with the first one of the next.
WHOLE, PARTS = "s", "CASE WHEN length(s) <= {0} THEN s ELSE substring(s, unnest(range(1, greatest(length(s), 2), {0})), {0} + 1) END"

#: Bytes as characters below 256; places count from 1.
DECODE = "SELECT array_to_string(list_select(v, places), '') AS b FROM lists, vocab ORDER BY d"


def _characters(ids: np.ndarray) -> np.ndarray:
    """A character for each id: never NUL, nor a surrogate."""
    up = ids.astype(np.uint32) + 1
    return up + (up >= 0xD800) * np.uint32(0x800)


def _ids(characters: str) -> np.ndarray:
    up = np.frombuffer(characters.encode("utf-32-le"), np.uint32)
    return (up - (up >= 0xE000) * np.uint32(0x800)).astype(np.int32) - 1


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[i], ..., starts[i] + lens[i] - 1 for each i in turn."""
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(lens.sum())


class Words(dict):
    """A generation of the cache: word -> its place. A word asked for the first time gets the next place and is fresh until its ids are known."""

    def __init__(self):
        self.fresh: list[str] = []
        self.chars = 0
        #: the ids of place p are ids[ends[p] : ends[p + 1]]
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = place = len(self)
        return place

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def spans(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of places begin, and how many they are."""
        return self.ends[places], self.ends[places + 1] - self.ends[places]

    def of(self, places: np.ndarray) -> np.ndarray:
        """The ids of places, joined up."""
        return self.ids[_ranges(*self.spans(places))]


class Codec:
    """One DuckDB connection with the merge table and the vocabulary, and a cache of encoded words."""

    def __init__(self, vocab: Vocabulary):
        import duckdb

        self.vocab, self.pattern = vocab, regex.compile(vocab.pattern)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY, "preserve_insertion_order": False})
        shown = _characters(np.arange(len(vocab.tokens))).tobytes().decode("utf-32-le")
        pairs = [shown[p >> 32] + shown[p & 0xFFFFFFFF] for p in vocab.pairs.tolist()]
        merges = pa.table({"pair": pairs, "k": [shown[m] + p for m, p in zip(vocab.merged.tolist(), pairs)]})
        names = pa.table({"v": [[t.decode("latin-1") for t in vocab.tokens]]})
        for name, data in (("merges", merges), ("vocab", names)):
            self.con.register("given", data)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        self.byte_characters = _characters(vocab.byte_ids)
        #: two generations, as a full one is only dropped when the next is full as well
        self.known, self.older = Words(), Words()

    def _solve(self, words: list[str]) -> list[str]:
        """The ids of each word, as characters."""
        every = [w.encode() for w in words]
        shown = self.byte_characters[np.frombuffer(b"".join(every), np.uint8)].tobytes().decode("utf-32-le")
        ends = list(accumulate(map(len, every)))
        self.con.register("words", pa.table({"w": pa.array(np.arange(len(words)), pa.int32()), "s": [shown[a:b] for a, b in zip([0, *ends], ends)]}))
        part = WHOLE if max(map(len, every)) <= PART else PARTS.format(PART)
        out = self.con.sql(ENCODE.format(part=part)).to_arrow_table()["s"].to_pylist()
        self.con.unregister("words")
        return out

    def _learn(self) -> None:
        """The ids of all fresh words: from the older generation, or by queries over blocks of BLOCK_BYTES characters."""
        known, older = self.known, self.older
        if not (fresh := known.fresh):
            return
        places = np.fromiter(map(older.get, fresh, repeat(-1)), np.int32, len(fresh))
        new = places < 0
        unmet = [fresh[i] for i in np.flatnonzero(new).tolist()]
        ends = np.cumsum([len(w) for w in unmet], dtype=np.int64)
        solved: list[str] = []
        while (at := len(solved)) < len(unmet):
            end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES)) + 1
            solved += self._solve(unmet[at:end])
        lens, starts = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        starts[~new], lens[~new] = older.spans(places[~new])
        lens[new] = [len(s) for s in solved]
        starts[new] = len(older.ids) + np.cumsum(lens[new]) - lens[new]
        ids = np.concatenate([older.ids, _ids("".join(solved))])[_ranges(starts, lens)]
        known.ids = np.concatenate([known.ids, ids])
        known.ends = np.concatenate([known.ends, known.ends[-1] + np.cumsum(lens)])
        known.chars += sum(map(len, fresh))
        known.fresh = []

    def _words(self) -> Words:
        """The generation that takes new words now."""
        if len(self.known) >= CACHE_WORDS or self.known.chars >= CACHE_CHARS:
            self.older, self.known = self.known, Words()
        return self.known

    def words_to_ids(self, words: list[str]) -> np.ndarray:
        """The ids of a sequence of words."""
        known = self._words()
        places = known.places(words)
        self._learn()
        return known.of(places)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """For each text its ids; texts are taken in blocks."""
        at = 0
        while at < len(texts):
            if len(texts[at] or "") > BLOCK_CHARS:
                matches = self.pattern.finditer(texts[at])
                parts = []
                while part := [m[0] for m in islice(matches, BLOCK_TOKENS)]:
                    parts.append(self.words_to_ids(part))
                yield np.concatenate(parts)
                at += 1
                continue
            known, split, held = self._words(), [], 0
            while at < len(texts) and held < BLOCK_WORDS and len(texts[at] or "") <= BLOCK_CHARS:
                split.append(known.places(self.pattern.findall(texts[at] or "")))
                held += len(split[-1])
                at += 1
            self._learn()
            yield from map(known.of, split)

    def decode(self, ids: list[np.ndarray]) -> Iterator[bytes]:
        """For each array of ids its bytes; long arrays are decoded in pieces."""
        pieces: list[np.ndarray] = []
        owner: list[int] = []
        out: list[list[bytes]] = [[] for _ in ids]

        def flush():
            if pieces:
                flat = np.concatenate(pieces)
                if flat.min() < 0 or flat.max() >= len(self.vocab.tokens):
                    raise ValueError("ids that the vocabulary does not have")
                self.con.register("lists", pa.table({"d": np.arange(len(pieces), dtype=np.int32), "places": _lists([p + 1 for p in pieces])}))
                for k, b in zip(owner, self.con.sql(DECODE).to_arrow_table()["b"].to_pylist()):
                    out[k].append(b.encode("latin-1"))
                self.con.unregister("lists")
                pieces.clear()
                owner.clear()

        held = 0
        for k, a in enumerate(ids):
            for at in range(0, len(a), PIECE_TOKENS):
                pieces.append(a[at : at + PIECE_TOKENS])
                owner.append(k)
                held += len(pieces[-1])
                if held >= BLOCK_TOKENS:
                    flush()
                    held = 0
        flush()
        for o in out:
            yield b"".join(o)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most SLICE_ROWS rows, which end where the last column's texts pass SLICE_BYTES."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(batch.num_columns - 1)).fill_null(0), np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    at = 0
    while at < batch.num_rows:
        end = min(at + SLICE_ROWS, int(np.searchsorted(part, part[at], "right")))
        yield batch.slice(at, end - at)
        at = end


_codecs: dict[str, Codec] = {}


def _codec(shared: Broadcast) -> Codec:
    """This Python worker's codec; the cache outlives a task where workers are used again."""
    vocab = shared.value
    if vocab.name not in _codecs:
        _codecs.clear()
        _codecs[vocab.name] = Codec(vocab)
    return _codecs[vocab.name]


def _schema(df: DataFrame, added: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]], added])


def encode(docs: DataFrame, vocab: Vocabulary, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns and ids (array<int>) of each whole text."""
    shown = docs.select(*carry, F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # the vocabulary's size, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for b in _slices(batch):
                ids = list(codec.encode(b.column(b.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(ids)], [*b.schema.names[:-1], "ids"])

    return shown.mapInArrow(run, _schema(shown, "ids array<int>"))


def decode(encoded: DataFrame, vocab: Vocabulary, carry: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """carry columns and decoded (binary), the bytes of ids; null ids have none."""
    shown = encoded.select(*carry, F.col("ids").alias("__ids"))
    shared = encoded.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                lists = b.column(b.num_columns - 1)
                flat = np.asarray(lists.flatten(), np.int32)
                ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64)).tolist()
                out = list(codec.decode([flat[s:e] for s, e in zip([0, *ends], ends)]))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], [*b.schema.names[:-1], "decoded"])

    return shown.mapInArrow(run, _schema(shown, "decoded binary"))


def round_trip(docs: DataFrame, vocab: Vocabulary, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns, ids (array<int>) of each whole text and decoded (binary), the bytes of those ids: both in one worker, with one copy of the vocabulary."""
    shown = docs.select(*carry, F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for b in _slices(batch):
                ids = list(codec.encode(b.column(b.num_columns - 1).to_pylist()))
                out = pa.array(list(codec.decode(ids)), pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(ids), out], [*b.schema.names[:-1], "ids", "decoded"])

    return shown.mapInArrow(run, _schema(shown, "ids array<int>, decoded binary"))


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> Vocabulary:
    """A vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return load_vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN)


def digests(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Each text encoded and decoded again: doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    return round_trip(docs, vocab).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
