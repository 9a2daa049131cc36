"""MinHash near-dedup with bottom-k sketches.

One hash function maps a document's distinct 5-word shingles to 63-bit values; the K least are its
sketch. Documents with equal shingle sets (by a 128-bit digest of the set) are one class, and only classes are compared.
Inverted lists over retained values give candidates, the union's bottom-k sketch estimates
their Jaccard similarity, and survivors are verified on their full sets.

Which pairs meet: of the K least values of the union of two sets with similarity 0.75, the number in
both is binomial(K, 0.75) or more; fewer than NEED of 48 has a chance below 1e-9. So two sketches share
NEED values, and a pair shares at least one of the K - NEED + 1 values that are rarest in each sketch
(rarity first, the same order for all), which alone are listed. Values of a passage that a third of
all documents hold are listed only for documents that consist of such passages to a large part.

Links to find components, not all pairs: in round one each list's least document is compared with all
others of the list, which is linear in the list. In round two, documents in a ball around a leader (half or more in
common with it, but several components) are compared in blocks by matrix products, where no pair is a row. What is left of
lists of up to SMALL_LIST documents is compared pair by pair, across components and balls; documents of longer lists - of a passage that very many
documents hold - must share one of the quarter of their full sets that is rarest among them, which is
exact. Pairs inside a component need no comparison, so groups of thousands of copies are never expanded into pairs.

Documents with null or empty text, or without words, have an empty set and are linked with nothing.
Rows with one doc_id count as one document: its different texts' groups are one component. Null doc_id is linked by nobody: its component_id is null and it
is not kept. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritree.llm.common import scratch, written
from veritree.llm.components import components
from veritree.llm.wordhash import shingle_set

K, NEED = 48, 14
#: 100 * intersection >= SIMILAR * union
SIMILAR = 75
#: Members of a block of a ball, members of a ball that is compared in blocks, and the longest list whose pairs are rows.
BALL, MOST_BALL, SMALL_LIST = 1024, 1 << 16, 16
#: Partners of a document that are compared with one copy of its text.
PARTNERS = 256


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (size of the set), digest (16 bytes of the set) and sketch (its K least values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                sets = [shingle_set(t.as_py()) for t in b.column(1)]
                heads = [s[:K] for s in sets]
                offsets = np.zeros(len(heads) + 1, np.int32)
                np.cumsum([len(h) for h in heads], out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64))),
                    ],
                    ["doc_id", "n", "digest", "sketch"],
                )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, digest binary, sketch array<long>")


def classes(sig: DataFrame) -> DataFrame:
    """One row for each non-empty shingle set: node (its least doc_id), n, sketch, digest."""
    return sig.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))


def index(cls: DataFrame) -> DataFrame:
    """value, node, n: the listed values, of classes that share a value with another class."""
    postings = cls.select("node", "n", F.explode("sketch").alias("value"))
    # written, so that the join has exchanges of its own, which Spark splits where one value has very many documents
    shared = written(postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared")
    hits = postings.join(shared, "value").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("vs"))
    k = F.least(F.col("n"), F.lit(K))
    need = F.greatest(F.lit(1), F.floor(k * NEED / K))
    # values that no other class has are the rarest and fill the first places
    room = (k - need + 1) - (k - F.size("vs"))
    return hits.filter(room > 0).select(F.explode(F.slice("vs", F.lit(1), room.cast("int"))).alias("v"), "node", "n").select("v.value", "node", "n")


def _near_size(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= SIMILAR * F.greatest(a, b)


def estimated(pairs: DataFrame, cls: DataFrame) -> DataFrame:
    """The pairs whose union sketch holds enough common values."""
    one = cls.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    two = cls.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    common = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    return both.filter(common * K >= NEED * F.size(union)).select("a", "b").distinct()


def measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b and the sizes of intersection (common) and union (total) of their full sets; texts: node, text.

    The partners of a document are dealt in buckets of about PARTNERS, and its own text goes to each bucket once, not to each
    pair: a document with very many partners is no hot key, and a task holds one set beside the partner's.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("buckets"))
    partners = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("buckets")).cast("int").alias("bucket"), "b")
    partners = partners.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "bucket", "b", "text")
    leaders = counts.join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.lit(None).cast("long").alias("b"), "text")
    both = partners.unionByName(leaders).repartition("a", "bucket").sortWithinPartitions("a", "bucket", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        held: list[np.ndarray] = []
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for a, bucket, b, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                own = shingle_set(text.as_py())
                if b is None:  # the text of a, or one of them
                    held = [*held, own] if (a, bucket) == last else [own]
                    last = (a, bucket)
                    continue
                for h in held:
                    common = len(np.intersect1d(h, own, assume_unique=True))
                    rows.append((a, b, common, len(h) + len(own) - common))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["a", "b", "common", "total"])

    return both.mapInArrow(run, "a long, b long, common long, total long")


def _linked(pairs: DataFrame, percent: int = SIMILAR) -> DataFrame:
    return pairs.filter(100 * F.col("common") >= percent * F.col("total")).select("a", "b").distinct()


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of a block of sets, as products of their incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = count > 1
    column = np.cumsum(some) - 1
    inside = some[where]
    owner, where = owner[inside], column[where[inside]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    for at in range(0, int(some.sum()), 2048):
        lo, hi = np.searchsorted(where, [at, at + 2048])
        part = np.zeros((len(sets), 2048), np.float32)
        part[owner[lo:hi], where[lo:hi] - at] = 1
        out += part @ part.T
    return out


def ball_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that join different components among the members of a ball; members: home, node, c.

    A ball is cut into blocks of BALL members, and each pair of blocks is compared in one task by
    matrix products over full sets, so that no pair is a row. Only links that connect components there are returned.
    """
    sizes = members.groupBy("home").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
    rows = members.join(sizes.select("home", F.ceil(F.col("m") / BALL).cast("int").alias("blocks")), "home")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("home", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "c").join(texts, "node")
    rows = rows.repartition("home", "i", "j").sortWithinPartitions("home", "i", "j", "node").select("home", "i", "j", "own", "node", "c", "text")

    def solve(held: list[tuple]) -> pa.RecordBatch:
        sets = [h[3] for h in held]
        size = np.array([len(s) for s in sets], np.float32)
        common = intersections(sets)
        near = 100 * common >= SIMILAR * (size[:, None] + size[None] - common)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for x, y in zip(*np.nonzero(np.triu(near, 1))):
            p, q = find(held[x][2]), find(held[y][2])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((held[x][1], held[y][1]))
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(6))))
            for (home, i, j, own, node, c), text in zip(keys, b.column(6)):
                if (home, i, j) != last:
                    if held:
                        yield solve(held)
                    held, last = [], (home, i, j)
                held.append((own, node, c, shingle_set(text.as_py())))
        if held:
            yield solve(held)

    return rows.mapInArrow(run, "a long, b long").distinct()


def rare_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs across components and balls that can be similar, by full sets: both hold one of the other's n - 0.75 n + 1 rarest shingles. nodes: node, n, c, home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                sets = [shingle_set(t.as_py()) for t in b.column(1)]
                offsets = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(x) for x in sets], out=offsets[1:])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["node", "shingles"])

    sets = texts.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(run, "node long, shingles array<long>")
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("value"))
    shared = each.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    held = each.join(shared, "value").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("vs"))
    # values nobody else has are the rarest
    room = F.col("n") - F.ceil(F.col("n") * SIMILAR / 100) + 1 - (F.col("n") - F.size("vs"))
    listed = held.filter(room > 0).select("node", F.explode(F.slice("vs", F.lit(1), room.cast("int"))).alias("v")).select("node", "v.value")
    return _across(written(listed.join(nodes, "node"), "rare"))


def _across(listed: DataFrame) -> DataFrame:
    """Pairs of a list in different components, without a common ball, and of similar size; listed: value, node, n, c, home.

    Members outside a list's largest component meet all others, so a list that is one group of copies but for a few is linear.
    """
    sizes = listed.groupBy("value", "c").agg(F.count(F.lit(1)).alias("k"))
    largest = written(sizes.groupBy("value").agg(F.max(F.struct("k", "c"))["c"].alias("big")), "largest")
    tagged = listed.join(largest, "value")
    left, right = tagged.filter("c <> big").alias("l"), tagged.alias("r")
    once = (F.col("r.c") == F.col("r.big")) | (F.col("l.node") < F.col("r.node"))
    both = left.join(right, (F.col("l.value") == F.col("r.value")) & once & (F.col("l.c") != F.col("r.c")) & (F.col("l.home") != F.col("r.home")) & _near_size(F.col("l.n"), F.col("r.n")))
    return both.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def id_links(sig: DataFrame, cls: DataFrame) -> DataFrame:
    """a, b: links between the classes of the different texts that rows of one doc_id have."""
    again = sig.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").select("doc_id")
    rows = sig.filter("n > 0").join(again, "doc_id", "left_semi").select("doc_id", "digest").join(cls.select("digest", "node"), "digest").select("doc_id", "node").distinct()
    least = rows.groupBy("doc_id").agg(F.min("node").alias("a"))
    return rows.join(least, "doc_id").select("a", F.col("node").alias("b")).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per input row."""
    with scratch(docs.sparkSession) as keep:
        sig = keep(written(sketches(docs, key, text), "sketches"))
        ids = keep(written(_class_components(docs, sig, key, text), "components"))
    out = sig.drop("sketch").join(ids, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _class_components(docs: DataFrame, sig: DataFrame, key: str, text: str) -> DataFrame:
    """digest and component of each class."""
    cls = written(classes(sig), "classes")
    listed = written(index(cls), "index")
    active = listed.select("node").distinct()
    own = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text"))
    texts = written(own.join(active, "node", "left_semi"), "texts")

    # round one: the least document of each list against the others
    leaders = written(listed.groupBy("value").agg(F.min("node").alias("a"), F.min_by("n", "node").alias("na"), F.count(F.lit(1)).alias("m")).filter("m > 1"), "leaders")
    with_leader = listed.join(leaders, "value")
    first = with_leader.filter((F.col("node") != F.col("a")) & _near_size(F.col("n"), F.col("na"))).select("a", F.col("node").alias("b")).distinct()
    first = written(measured(estimated(first, cls), texts), "measured")
    links = _linked(first)
    comp = written(components(links), "components")

    # round two: across components; balls of documents that share half their shingles with a leader are compared as blocks
    ball = _linked(first, 50).groupBy("b").agg(F.min("a").alias("home")).withColumnRenamed("b", "node")
    ball = ball.unionByName(ball.select(F.col("home").alias("node"), "home").distinct()).groupBy("node").agg(F.min("home").alias("home"))
    # blocks of a ball are squared in number: very large balls go the way of the lists instead
    large = written(ball.groupBy("home").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > MOST_BALL).select("home"), "large")
    ball = ball.join(large, "home", "left_anti")
    nodes = written(active.join(comp, "node", "left").join(ball, "node", "left").select("node", F.coalesce("component", "node").alias("c"), "home"), "nodes")
    within = ball_links(nodes.filter("home is not null"), texts)

    # and the rest of each list: small lists pair by pair, large ones by their documents' rarest shingles
    placed = with_leader.filter("node <> a and m > 2").select("value", "node", "n").join(nodes, "node").withColumn("home", F.coalesce("home", -F.col("node") - 1))
    mixed = placed.groupBy("value").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("home").alias("h0"), F.max("home").alias("h1"), F.count(F.lit(1)).alias("m")).filter("lo < hi and h0 < h1")
    mixed = written(mixed.select("value", "m"), "mixed")
    placed = written(placed.join(mixed, "value"), "placed")
    few = estimated(_across(placed.filter(F.col("m") <= SMALL_LIST)), cls)
    many = rare_pairs(placed.filter(F.col("m") > SMALL_LIST).select("node", "n", "c", "home").distinct(), texts)
    more = _linked(measured(few.unionByName(many).distinct(), texts))
    # rows of one doc_id are one document: their classes are one component as well
    links = written(links.unionByName(within).unionByName(more).unionByName(id_links(sig, cls)), "all-links")
    final = components(links)
    return cls.select("digest", "node").join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of least doc_id. Rows without shingles or doc_id are in no group and stay.

    Where doc_id tells all rows apart it is their key. Else rows are numbered first (one more copy of the
    table): rows of one doc_id are then judged by their own texts, and of a group the row of least (doc_id, digest, number) stays.
    """
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    if ids.isEmpty():
        with scratch(docs.sparkSession) as keep:
            gone = keep(written(near_duplicates(docs).filter("doc_id is not null and not kept").select(F.col("doc_id").alias("__id")), "gone"))
        return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")
    with scratch(docs.sparkSession) as keep:
        rows = keep(written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows"))
        found = near_duplicates(rows.filter("doc_id is not null"), "__row").filter("n_shingles > 0").select(F.col("doc_id").alias("__row"), "component_id")
        place = F.struct("doc_id", F.xxhash64("text").alias("digest"), "__row")
        first = found.join(rows.select("__row", "doc_id", "text"), "__row").groupBy("component_id").agg(F.min(place).alias("p")).select("p.__row")
        gone = keep(written(found.select("__row").join(first, "__row", "left_anti"), "gone"))
    return rows.join(gone, "__row", "left_anti").drop("__row")
