"""Periodic run detection: maximal repetitions of words, from Lyndon words.

A run is a stretch of words with smallest period q and a length of at least max(LEAST, 2q) that no
neighbouring word extends with that period. Every run has a Lyndon word as its root under the order of
words or the reverse one, and that root is the longest Lyndon word that starts at its place. So for both
orders a stack, scanned from right to left, gives the longest Lyndon word of each place (its end is
the next smaller suffix), and each of them is a candidate period, extended to both sides as far as
words one period apart are equal. Suffixes are compared and candidates extended by their longest common
extension (LCE): the first words directly, then a binary search over rolling hashes. Every run is verified word by word
before it is reported; if one fails, two stretches had the same hashes, and the stretch is done again
with direct comparisons.

The scan is made where it can find something. A run of LEAST = 12 words or more is covered by
windows of LEAST / 2 words that occur again in the text, so texts without such windows have no run, and
others are cut to the stretches that such windows cover. That loses no run, whatever the text.

Each text is a row of its own; nothing is shuffled. Null and empty texts have no words and no runs.
Repeated rows give the same result each; rows without doc_id are treated like others. Runs have no ties:
two runs with the same start and period would be one. Only the columns named in `carry` are kept, so others may
have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritree.llm.common import slices, words

#: Words that a run has at least.
LEAST = 12

_WINDOW = LEAST // 2
_PRIMES = ((np.int64(2147483647), 1_103_515_245), (np.int64(2147483629), 1_664_525_017))
#: Words that an LCE compares directly before it searches by hashes.
_DIRECT = 8


class _Stretch:
    """Word numbers, with prefix sums of their rolling hashes for both primes."""

    def __init__(self, ids: np.ndarray, direct: bool = False):
        self.ids, self.n, self.direct = ids, len(ids), direct
        self.plain = ids.tolist()
        self.sums, self.powers = [], []
        for prime, base in _PRIMES:
            power = np.ones(1, np.int64)
            while len(power) <= self.n:
                power = np.concatenate([power, power * np.int64(pow(base, len(power), int(prime))) % prime])
            terms = (ids + 1) * power[: self.n] % prime
            self.sums.append(np.concatenate([np.zeros(1, np.int64), np.cumsum(terms) % prime]))
            self.powers.append(power)
        self.lists = [(int(p), s.tolist(), w.tolist()) for (p, _), s, w in zip(_PRIMES, self.sums, self.powers)]

    def equal(self, i: int, j: int, m: int) -> bool:
        """Whether m words from i on are those from j on; i < j."""
        if self.direct:
            return self.plain[i : i + m] == self.plain[j : j + m]
        return all((s[i + m] - s[i]) * w[j - i] % p == (s[j + m] - s[j]) % p for p, s, w in self.lists)

    def lce(self, i: int, j: int) -> int:
        """How many words from i on are those from j on; i < j."""
        x, most = self.plain, self.n - j
        k = 0
        for k in range(min(most, _DIRECT)):
            if x[i + k] != x[j + k]:
                return k
        low, high = min(most, _DIRECT), 2 * _DIRECT
        while high <= most and self.equal(i, j, high):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while low + 1 < high:
            mid = (low + high) // 2
            if self.equal(i, j, mid):
                low = mid
            else:
                high = mid
        return low

    def lyndon_ends(self, reverse: bool) -> np.ndarray:
        """Where the longest Lyndon word from each place on ends: at the next smaller suffix."""
        x, n, lce = self.plain, self.n, self.lce
        ends = [n] * n
        for i in range(n - 2, -1, -1):
            a, j = x[i], i + 1
            while j < n:
                b = x[j]
                if a == b:
                    k = lce(i, j)
                    if j + k == n:  # the later suffix is a prefix of this one, so it is smaller
                        break
                    less = x[i + k] < x[j + k]
                else:
                    less = a < b
                if less == reverse:
                    break
                j = ends[j]
            ends[i] = j
        return np.array(ends, np.int64)

    def _same(self, i: np.ndarray, j: np.ndarray, m: np.ndarray, back: bool) -> np.ndarray:
        if self.direct:
            return np.array([np.array_equal(self.ids[a - c : a], self.ids[b - c : b]) if back else np.array_equal(self.ids[a : a + c], self.ids[b : b + c]) for a, b, c in zip(i, j, m)], bool)
        at, out = (-m, -1) if back else (m, 1), np.ones(len(i), bool)
        step, sign = at
        for (prime, _), s, w in zip(_PRIMES, self.sums, self.powers):
            out &= sign * (s[i + step] - s[i]) % prime * w[j - i] % prime == sign * (s[j + step] - s[j]) % prime
        return out

    def extents(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """For each pair of places, how many words from them on (or, with back, before them) are equal."""
        low, high = np.zeros(len(i), np.int64), i.copy() if back else self.n - j
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self._same(i, j, mid, back)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run, in order."""
        n, at = self.n, np.arange(self.n, dtype=np.int64)
        ends = [self.lyndon_ends(r) for r in (False, True)]
        i, j = np.concatenate([at, at]), np.concatenate(ends)
        # words one period apart must be equal on one side at least
        ahead = (j < n) & (self.ids[np.minimum(j, n - 1)] == self.ids[i])
        behind = (i > 0) & (self.ids[i - 1] == self.ids[j - 1])
        i, j = i[ahead | behind], j[ahead | behind]
        start, stop = i - self.extents(i, j, True), j + self.extents(i, j, False)
        period = j - i
        found = stop - start >= np.maximum(LEAST, 2 * period)
        return sorted(set(zip(start[found].tolist(), (stop - start)[found].tolist(), period[found].tolist())))

    def holds(self, start: int, length: int, period: int) -> bool:
        """Verifies a run word by word: the period, and that neither neighbour keeps it."""
        x, stop = self.ids, start + length
        return (
            np.array_equal(x[start : stop - period], x[start + period : stop])
            and (start == 0 or x[start - 1] != x[start - 1 + period])
            and (stop == self.n or x[stop] != x[stop - period])
        )


def repeated(ids: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of words that windows with a second occurrence cover; equal hashes only ever add stretches."""
    m = len(ids) - _WINDOW + 1
    if len(ids) < LEAST:
        return []
    key, one = np.zeros(m, np.uint64), ids.astype(np.uint64) + np.uint64(1)
    for k in range(_WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + one[k : k + m]
        key ^= key >> np.uint64(29)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(key, twice))
    cuts = np.flatnonzero(np.diff(at) > _WINDOW)
    starts, stops = at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])] + _WINDOW
    return [(a, b) for a, b in zip(starts.tolist(), stops.tolist()) if b - a >= LEAST]


def find(tokens: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words, by start, then period."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
    out = []
    for a, b in repeated(ids):
        stretch = _Stretch(ids[a:b])
        found = stretch.runs()
        if not all(stretch.holds(*r) for r in found):
            found = _Stretch(ids[a:b], direct=True).runs()
        out += [(a + start, length, period) for start, length, period in found]
    return out


def collapsed(tokens: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what any run repeats after its first period."""
    if not runs:
        return tokens
    gone = np.zeros(len(tokens) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
    return [tokens[k] for k in kept.tolist()]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns, n_words, runs (array of start, length, period by start, then period) and collapsed (the words left, joined by one space) of each whole text."""
    shown = docs.select(*carry, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                sizes, found, left = [], [], []
                for value in b.column(b.num_columns - 1):
                    tokens = (value.as_py() or "").encode().split()  # bytes split at space and tab to carriage return
                    runs = find(tokens)
                    sizes.append(len(tokens))
                    found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                    left.append(b" ".join(collapsed(tokens, runs)).decode())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64()), pa.array(found, _RUNS), pa.array(left, pa.string())], [*b.schema.names[:-1], "n_words", "runs", "collapsed"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema.fields[:-1]]
    return shown.mapInArrow(run, ", ".join([*kept, "n_words long", "runs array<struct<start: long, length: long, period: long>>", "collapsed string"]))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs, with periodic tails in a tenth of the texts, chosen by the CRC of doc_id; a null doc_id chooses nothing."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    div = lambda x, y: F.floor((x - x % y) / y).cast("long")
    g = div(crc, F.lit(10))

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = div(n - a, F.lit(3) + g % 8) + 1
        at = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(at, lambda i: F.element_at(w, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))), " ")

    # the words are a bound variable, or they would be split again for each of them
    made = F.element_at(F.transform(F.array(words(F.col("text"))), lambda w: F.when(F.size(w) == 0, "").otherwise(tail(w))), 1)
    return docs.withColumn("text", F.when(F.coalesce(crc % 10 == 0, F.lit(False)), made).otherwise(F.col("text")))


def summary(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest run, and digests of all runs and of the words left."""
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    rows = found.withColumn("best", F.when(F.size("runs") > 0, longest))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("-1000 * best.l div best.p").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
