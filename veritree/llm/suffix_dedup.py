"""Suffix-array dedup: removes every byte covered by a LENGTH-byte string that also starts anywhere else.

Blockwise construction, one suffix bucket at a time. A window (a LENGTH-byte string) belongs to the
bucket named by the least hash of the GRAM-byte strings inside it, so equal windows share a bucket
wherever they stand. Neighbouring windows mostly share their bucket too: each text falls into runs
of windows, about 80 windows long. Buckets with one run only cannot hold a repeat and end there. For the others the run's
bytes (a piece) are recognised by digest, and every window of a piece that occurs twice is a repeat. Bytes travel to a bucket
only where that leaves something open: one copy of each distinct piece, if the bucket has several or one that may repeat within itself.
Texts move once, into a table in buckets by text, from which pieces are digested, then cut, and in which spans are applied. Within a task, buckets are taken in blocks of
BLOCK bytes; a block's windows are put in suffix order with a difference cover, whose sample ranks
resolve long ties, and neighbours in that order that agree on LENGTH bytes are repeats.
A bucket of over HOT_BYTES of distinct pieces (around a passage that a large part of the corpus holds) would not fit a task; its
windows are grouped one by one by 128-bit digests, which aggregate map-side and spread over all tasks.

Texts are bytes of UTF-8. Null text is empty. Texts shorter than LENGTH are untouched. Whole copies are
one class (by MD5 and length) and are removed entirely, being repeats of each other. Repeated rows, also with one doc_id, are
documents of their own. Null doc_id is carried. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritree.llm.common import bucketed, dropped, scratch, written
from veritree.llm.suffix_array import repeated
from veritree.llm.wordhash import _powers, mix

LENGTH, GRAM = 200, 40
#: Bytes of pieces sorted at once; windows in a run at most; bytes of a text hashed at once; bytes of a bucket's pieces that a task may hold. Sorting takes about 80 bytes for each byte.
BLOCK, MOST_RUN, CHUNK, HOT_BYTES = 3 << 19, 1024, 1 << 20, 2 << 20


def runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, start, end, multi) of the runs of windows of a text; end is behind the last window's start. multi: the text has the bucket's string twice or more."""
    windows = len(raw) - LENGTH + 1
    if windows < 1:
        return (*[np.zeros(0, np.int64)] * 3, np.zeros(0, bool))
    width = LENGTH - GRAM + 1
    parts, grams = [], []
    for at in range(0, windows, CHUNK):
        n = min(CHUNK, windows - at)
        b = raw[at : at + n + LENGTH - 1]
        up, down = _powers(len(b) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
            g = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(b) - GRAM + 1]) >> np.uint64(1)
        least, have = g, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        cut = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        end = np.r_[cut[1:], n]
        if (end - cut).max() > MOST_RUN:
            more = [(a, min(a + MOST_RUN, e)) for s, e in zip(cut.tolist(), end.tolist()) for a in range(s, e, MOST_RUN)]
            cut, end = np.array([m[0] for m in more]), np.array([m[1] for m in more])
        parts.append((least[cut].astype(np.int64), cut + at, end + at))
        grams.append(g[: n if at + n < windows else len(g)].astype(np.int64))
    bucket, start, end = (np.concatenate(x) for x in zip(*parts))
    names = np.unique(bucket)
    times = np.zeros(len(names) + 1, np.int64)
    for g in grams:
        place = np.searchsorted(names, g)
        found = names[np.minimum(place, len(names) - 1)] == g
        times += np.bincount(place[found], minlength=len(names) + 1)
    return bucket, start, end, times[np.searchsorted(names, bucket)] > 1


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, k1 and k2 (the text's MD5 and length), own (with k2: the text of this doc_id) and the text as bytes."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    part = lambda at: F.conv(F.substring(F.md5(t), at, 15), 16, 10).cast("long")
    return docs.select(F.col(key).alias("doc_id"), part(1).alias("k1"), part(16).alias("k2"), part(1).bitwiseXOR(F.xxhash64(F.col(key))).alias("own"), t.cast("binary").alias("bytes"))


def signatures(keyed: DataFrame) -> DataFrame:
    """Each row's size, digest and runs, and its number (row)."""
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                sizes, shas, found = [], [], []
                for t in b.column(4):
                    data = t.as_py()
                    sizes.append(len(data))
                    shas.append(hashlib.sha256(data).hexdigest())
                    found.append(runs(np.frombuffer(data, np.uint8)))
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(f[0]) for f in found], out=offsets[1:])
                cols = [np.concatenate([f[i] for f in found]) for i in range(4)]
                rows = pa.StructArray.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32)), pa.array(cols[3])], ["bucket", "start", "end", "multi"])
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(sizes, pa.int64()), pa.array(shas), pa.ListArray.from_arrays(pa.array(offsets), rows)], ["doc_id", "k1", "k2", "own", "n_bytes", "sha256", "runs"])

    found = keyed.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, own long, n_bytes long, sha256 string, runs array<struct<bucket: long, start: int, end: int, multi: boolean>>")
    return found.withColumn("row", F.monotonically_increasing_id())


def _listed(column: pa.ListArray, *fields: str) -> Iterator[list[tuple]]:
    """The structs of each list as tuples."""
    ends = column.offsets.to_pylist()
    rows = list(zip(*(column.values.field(f).slice(ends[0], ends[-1] - ends[0]).to_pylist() for f in fields)))
    return (rows[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:]))


def _digested(active: DataFrame) -> DataFrame:
    """A row for each run that counts: its bucket, its place and the digest of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                out: list[tuple] = []
                for own, k2, data, found in zip(*(b.column(i).to_pylist() for i in range(3)), _listed(b.column(3), "bucket", "run")):
                    for bucket, packed in found:
                        start, end = packed >> 12, (packed >> 12) + (packed >> 1 & 2047) + LENGTH - 1
                        d = xxhash.xxh3_128_intdigest(data[start:end])
                        out.append((bucket, d >> 65, (d & ((1 << 64) - 1)) >> 1, own, k2, start, end, bool(packed & 1)))
                kinds = (pa.int64(),) * 5 + (pa.int32(),) * 2 + (pa.bool_(),)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["bucket", "p1", "p2", "own", "k2", "start", "end", "multi"])

    return active.select("own", "k2", "bytes", "runs").mapInArrow(run, "bucket long, p1 long, p2 long, own long, k2 long, start int, end int, multi boolean")


def _cut(active: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted pieces with their bytes; bytes: of the bucket's distinct pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                out: list[tuple] = []
                held = 0
                for own, k2, data, found in zip(*(b.column(i).to_pylist() for i in range(3)), _listed(b.column(3), "bucket", "start", "size", "bytes", "many")):
                    for bucket, start, size, of, many in found:
                        out.append((bucket, own, k2, start, data[start : start + size], many, of))
                        held += size
                        if held > 1 << 23:
                            yield pieces(out)
                            out, held = [], 0
                if out:
                    yield pieces(out)

    def pieces(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(),) * 3 + (pa.int32(), pa.binary(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "own", "k2", "start", "piece", "many", "bytes"])

    by_text = wanted.groupBy("own", "k2").agg(F.collect_list(F.struct("bucket", "start", "size", "bytes", "many")).alias("wanted"))
    return active.select("own", "k2", "bytes").join(by_text, ["own", "k2"]).mapInArrow(run, "bucket long, own long, k2 long, start int, piece binary, many boolean, bytes long")


SPANS = "own long, k2 long, start int, end int"


def _sorted_blocks(pieces: DataFrame) -> DataFrame:
    """Spans of the repeats among distinct pieces of a bucket, for pieces that occur once."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[4]) for r in rows])
        offs = np.cumsum(sizes) - sizes
        block = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        counts = sizes - LENGTH + 1
        which = np.repeat(np.arange(len(rows)), counts)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        hit = repeated(block, offs[which] + inner, LENGTH) & ~np.array([r[5] for r in rows])[which]
        # runs of hits within a piece
        at = np.flatnonzero(hit)
        first = np.r_[True, (np.diff(at) > 1) | (np.diff(which[at]) > 0)] if len(at) else np.zeros(0, bool)
        lo = at[first]
        hi = at[np.r_[first[1:], True]] if len(at) else at
        of = which[lo]
        start = np.array([r[3] for r in rows], np.int64)[of]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][1] for i in of], pa.int64()), pa.array([rows[i][2] for i in of], pa.int64()), pa.array((start + inner[lo]).astype(np.int32)), pa.array((start + inner[hi] + LENGTH).astype(np.int32))],
            ["own", "k2", "start", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(7))):
                if row[0] != last and size and size + row[6] > BLOCK:  # only between buckets
                    yield solve(held)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    return pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, SPANS)


def _by_digest(pieces: DataFrame) -> DataFrame:
    """The same spans window by window, for buckets of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, k2, start, piece, many in zip(*(b.column(i).to_pylist() for i in range(5))):
                n = len(piece) - LENGTH + 1
                d = [xxhash.xxh3_128_intdigest(piece[i : i + LENGTH]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x >> 65 for x in d], pa.int64()), pa.array([(x & ((1 << 64) - 1)) >> 1 for x in d], pa.int64()), pa.array([own] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array(range(start, start + n), pa.int32()), pa.array([many] * n)],
                    ["w1", "w2", "own", "k2", "start", "many"],
                )

    rows = pieces.select("own", "k2", "start", "piece", "many").mapInArrow(run, "w1 long, w2 long, own long, k2 long, start int, many boolean")
    rows = written(rows, "windows")
    twice = rows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2")
    return rows.filter("not many").join(twice, ["w1", "w2"], "left_semi").select("own", "k2", "start", (F.col("start") + LENGTH).cast("int").alias("end"))


def _apply(active: DataFrame) -> DataFrame:
    """Merged spans, counts and the digest of what is left, of texts with their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, k2, data, spans in zip(*(batch.column(i) for i in range(4))):
                data, merged = data.as_py(), []
                for s, e in sorted((x["start"], x["end"]) for x in spans.as_py()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                left, at = hashlib.sha256(), 0
                for s, e in merged:
                    left.update(data[at:s])
                    at = e
                left.update(data[at:])
                rows.append((own.as_py(), k2.as_py(), [{"start": s, "end": e} for s, e in merged], left.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["own", "k2", "spans", "kept_sha256"])

    return active.mapInArrow(run, "own long, k2 long, spans array<struct<start: int, end: int>>, kept_sha256 string")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed byte ranges, in order) and kept_sha256, one row per input row."""
    with scratch(docs.sparkSession) as keep:
        keyed = _keyed(docs, key, text)
        sig = written(signatures(keyed), "signatures", "zstd")
        rows = keep(written(sig.drop("runs"), "rows", "zstd"))
        cls, removed = _repeats(keyed, sig, rows, hot_bytes, keep)
    out = rows.join(cls.select("k1", "k2", "copies"), ["k1", "k2"], "left").join(removed, ["own", "k2"], "left")
    copied = F.col("copies") > 1
    all_ = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    none = F.array().cast("array<struct<start: int, end: int>>")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copied, all_).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copied, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def _repeats(keyed: DataFrame, sig: DataFrame, rows: DataFrame, hot_bytes: int, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Each text's copies, and the spans and rest of the texts that repeat something; both written and kept."""
    cls = rows.filter(F.col("n_bytes") >= LENGTH).groupBy("k1", "k2").agg(F.min("row").alias("row"), F.min_by("own", "row").alias("own"), F.count(F.lit(1)).alias("copies"))
    cls = keep(written(cls, "classes", "zstd"))

    posted = sig.select("row", F.explode("runs").alias("r")).select("row", "r.*")
    shared = posted.groupBy("bucket").agg((F.count(F.lit(1)) + F.sum(F.col("multi").cast("long"))).alias("n")).filter("n > 1").select("bucket")
    # all runs are exchanged here: start, length (up to MOST_RUN) and multi go as one number
    packed = F.shiftleft(F.col("start").cast("long"), 12) + (F.col("end") - F.col("start")) * 2 + F.col("multi").cast("int")
    hits = posted.select("row", "bucket", packed.alias("run")).join(shared, "bucket", "left_semi").groupBy("row").agg(F.collect_list(F.struct("bucket", "run")).alias("runs"))
    hits = hits.join(cls.select("row", "own", "k2"), "row").select("own", "k2", "runs")
    texts = keyed.select("own", "k2", "bytes").join(hits, ["own", "k2"]).dropDuplicates(["own", "k2"])
    with bucketed(texts, ["own", "k2"], "active") as active:
        dropped(sig.sparkSession, sig.veritree_path)
        return cls, keep(written(_apply(_with_spans(active, hot_bytes)), "removed"))


def _with_spans(active: DataFrame, hot_bytes: int) -> DataFrame:
    """The texts that repeat something, with the spans of the repeats."""
    pieces = written(_digested(active), "pieces", "zstd")
    place = F.struct("own", "k2", "start")
    distinct = pieces.groupBy("bucket", "p1", "p2").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.max(F.col("end") - F.col("start")).alias("size"), F.max("multi").alias("multi"))
    distinct = written(distinct.select("bucket", "p1", "p2", "lo.*", (F.col("lo") != F.col("hi")).alias("many"), "size", "multi"), "distinct", "zstd")
    whole = pieces.join(distinct.filter("many").select("bucket", "p1", "p2"), ["bucket", "p1", "p2"], "left_semi").select("own", "k2", "start", "end")

    size = F.col("size").cast("long")
    counted = distinct.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.max("multi").alias("multi"), F.min("many").alias("all"))
    # a piece that occurs twice is a repeat as a whole; a lone piece can repeat only within itself, and then has the bucket's string twice
    counted = counted.filter(~F.col("all") & ((F.col("n") > 1) | F.col("multi"))).select("bucket", "bytes")
    wanted = written(distinct.select("bucket", "own", "k2", "start", "size", "many").join(counted, "bucket"), "wanted", "zstd")
    some, hot = wanted.filter(F.col("bytes") <= hot_bytes), wanted.filter(F.col("bytes") > hot_bytes)
    spans = whole.unionByName(_sorted_blocks(_cut(active, some)))
    if not hot.isEmpty():
        spans = spans.unionByName(_by_digest(_cut(active, hot)))
    spans = written(spans, "spans", "zstd")

    by_text = spans.groupBy("own", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return active.select("own", "k2", "bytes").join(by_text, ["own", "k2"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    out = repeated_spans(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and kept (binary): the bytes left of each text. Rows that share a doc_id and a text are alike; doc_id must tell other rows apart."""
    spans = repeated_spans(docs, key, text).select(F.col("doc_id").alias("__id"), "spans").dropDuplicates(["__id"])
    data = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__b"))
    both = data.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")))
    # what stands between the spans' ends
    edges = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    stops = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.octet_length("__b")))
    parts = F.transform(F.arrays_zip(edges.alias("a"), stops.alias("b")), lambda p: F.hex(F.substring(F.col("__b"), p["a"] + 1, p["b"] - p["a"])))
    return both.select("doc_id", F.unhex(F.array_join(parts, "")).alias("kept"))
