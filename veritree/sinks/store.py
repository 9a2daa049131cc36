"""The evidence store: bucketed Parquet deltas under versioned manifests.

    PATH/store.json                     the number of buckets
    PATH/manifests/00000000000000000007 version 7: for each bucket its files' folders, oldest first
    PATH/data/ID/bucket=3/*.parquet     what one publication, or one compaction, wrote for a bucket

A publication writes the records of the buckets that it touches, and commits by creating the next manifest, which only one writer can: the other
reads the new head and tries the number after it, with the same files. Files that no manifest names do not count, so a writer that dies
leaves nothing behind that others see or wait for. Readers take one manifest, and the latest record of each key by the order of its folders. A compaction writes
the merged records of buckets with many deltas and commits in the same way.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritree.operators import evidence

SCHEMA = "file_sha256 string, evidence_type string, algorithm string, runtime string, payload_json string, version long"
BUCKETS = 64
#: A compaction takes buckets of more folders than this.
DELTAS = 8


@dataclass(frozen=True)
class Kind:
    """What a store holds: the columns of its key and its other columns, as DDL, and which records are valid."""

    key: str
    values: str
    valid: Callable[[DataFrame], DataFrame]

    @property
    def keys(self) -> list[str]:
        return [c.split()[0] for c in self.key.split(", ")]

    @property
    def columns(self) -> list[str]:
        return self.keys + [c.split()[0] for c in self.values.split(", ")]

    @property
    def schema(self) -> str:
        return f"{self.key}, {self.values}, version long"


EVIDENCE = Kind("file_sha256 string, evidence_type string, algorithm string, runtime string", "payload_json string", evidence.valid)
OBSERVATIONS = Kind("scope string, relative_path string", "device long, inode long, size long, modified_ns long, changed_ns long, byte_sha256 string", evidence.valid_observations)


class _Files:
    """The store's small files, by the file system that Spark uses."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path.rstrip("/"), spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def ages(self, folder: str) -> dict[str, float]:
        at = self._path(folder)
        return {s.getPath().getName(): time.time() - s.getModificationTime() / 1000 for s in self.fs.listStatus(at)} if self.fs.exists(at) else {}

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a whole file that must not exist yet: aside, then renamed; false if another was there first."""
        aside = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}".lstrip("/")
        stream = self.fs.create(self._path(aside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        qualified = self.fs.makeQualified(self._path(name))
        try:
            if qualified.toUri().getScheme() == "file":  # a local rename would overwrite; a link does not
                os.link(urlparse(self.fs.makeQualified(self._path(aside)).toUri().toString()).path, urlparse(qualified.toUri().toString()).path)
                return True
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self.conf)
            rename = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = self.jvm.java.lang.reflect.Array.newInstance(rename.getClass(), 1)
            options[0] = rename
            context.rename(self._path(aside), self._path(name), options)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.fs.delete(self._path(aside), False)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _versions(files: _Files) -> list[int]:
    return sorted(int(n) for n in files.names("manifests") if n.isdigit())


def _manifest(files: _Files, version: int | None) -> dict:
    """One version's manifest, the newest by default: its number and, for each bucket, [[folder, version], ...]."""
    if version is None:
        version = max(_versions(files), default=0)
    return json.loads(files.text(f"manifests/{version:020d}")) if version else {"version": 0, "buckets": {}}


def _commit(files: _Files, change: Callable[[dict, int], dict | None]) -> int:
    """Makes the next version from the head by `change`, again from the new head for as long as other writers are faster; none if there is nothing left to change."""
    while True:
        head = _manifest(files, None)
        number = head["version"] + 1
        buckets = change({k: list(v) for k, v in head["buckets"].items()}, number)
        if buckets is None:
            return head["version"]
        if files.create(f"manifests/{number:020d}", json.dumps({"version": number, "buckets": buckets})):
            return number


def _bucket_count(files: _Files, buckets: int) -> int:
    """The number of buckets that the store was made with; the first writer sets it."""
    if "store.json" not in files.names(""):
        files.fs.mkdirs(files._path("manifests"))
        files.create("store.json", json.dumps({"buckets": buckets}))
    return json.loads(files.text("store.json"))["buckets"]


def _bucketed(rows: DataFrame, kind: Kind, n: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*kind.keys), F.lit(n)).cast("int"))


def _write(files: _Files, rows: DataFrame, kind: Kind, buckets: int) -> tuple[str, list[str]]:
    """The folder written, and the buckets in it. A bucket's rows are sorted by key, so filters on it skip row groups."""
    folder = f"data/{uuid.uuid4().hex}"
    dealt = _bucketed(rows, kind, buckets).repartition("bucket").sortWithinPartitions("bucket", *kind.keys[1:], kind.keys[0])
    dealt.write.partitionBy("bucket").parquet(f"{files.path}/{folder}")
    return folder, [n.removeprefix("bucket=") for n in files.names(folder) if n.startswith("bucket=")]


def _merged(spark: SparkSession, files: _Files, entries: list[tuple[str, str, int]], kind: Kind) -> DataFrame:
    """The latest record of each key in folders (bucket, folder, version): an aggregate that combines map-side. Compacted folders hold each record's own version."""
    parts: dict[int, list[str]] = {}
    for bucket, folder, version in entries:
        parts.setdefault(version, []).append(f"{files.path}/{folder}/bucket={bucket}")
    out = None
    for version, paths in sorted(parts.items()):
        rows = spark.read.schema(kind.schema).parquet(*paths).withColumn("version", F.coalesce("version", F.lit(version).cast("long")))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], kind.schema)
    values = [c for c in kind.columns if c not in kind.keys]
    latest = out.groupBy(*kind.keys).agg(F.max(F.struct("version", *values)).alias("r"))
    return latest.select(*kind.keys, *[F.col(f"r.{c}").alias(c) for c in values], F.col("r.version").alias("version"))


def read(spark: SparkSession, path: str, version: int | None = None, kind: Kind = EVIDENCE) -> DataFrame:
    """The store's newest, or a given, version: the latest record of each key and the version that published it; empty without any."""
    files = _Files(spark, path)
    manifest = _manifest(files, version)
    return _merged(spark, files, [(b, *e) for b, found in manifest["buckets"].items() for e in found], kind)


def publish(spark: SparkSession, path: str, records: DataFrame, kind: Kind = EVIDENCE, buckets: int = BUCKETS) -> int:
    """Upserts valid records as a new version, and returns its number; invalid records refuse the whole publication. Only buckets that records fall in are written."""
    files = _Files(spark, path)
    folder, touched = _write(files, records.select(*kind.columns), kind, _bucket_count(files, buckets))
    if touched:  # records are computed once: what was written is judged, and left to no manifest if it is refused
        made = spark.read.schema(kind.schema).parquet(*[f"{files.path}/{folder}/bucket={b}" for b in touched]).select(*kind.columns)
        if refused := made.count() - kind.valid(made).count():
            files.delete(folder)
            raise ValueError(f"{refused} records break the store's constraints")

    def added(head: dict, number: int) -> dict:
        for b in touched:
            head[b] = [*head.get(b, []), [folder, number]]
        return head

    return _commit(files, added)


def compact(spark: SparkSession, path: str, kind: Kind = EVIDENCE, deltas: int = DELTAS) -> int:
    """Merges the folders of each bucket that has more than `deltas`, and returns the version; folders that are published meanwhile stay behind the merged one."""
    files = _Files(spark, path)
    old = {b: found for b, found in _manifest(files, None)["buckets"].items() if len(found) > deltas}
    if not old:
        return _manifest(files, None)["version"]
    rows = _merged(spark, files, [(b, *e) for b, found in old.items() for e in found], kind)
    folder, _ = _write(files, rows, kind, _bucket_count(files, BUCKETS))

    def replaced(head: dict, number: int) -> dict | None:
        free = {b: found for b, found in old.items() if head.get(b, [])[: len(found)] == found}  # another compaction may have been faster
        for b, found in free.items():
            head[b] = [[folder, found[-1][1]], *head[b][len(found) :]]
        return head if free else None

    return _commit(files, replaced)


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than: float = 86_400.0) -> int:
    """Deletes all but the newest manifests, and folders that none of those names and that are older than some seconds, which a publication in progress is not; returns the number of folders deleted."""
    files = _Files(spark, path)
    versions = _versions(files)
    for v in versions[: -keep or None]:
        files.delete(f"manifests/{v:020d}")
    named = {e[0] for v in versions[-keep:] for found in _manifest(files, v)["buckets"].values() for e in found}
    gone = [n for n, age in files.ages("data").items() if f"data/{n}" not in named and age > older_than]
    for n in gone:
        files.delete(f"data/{n}")
    return len(gone)


def at_path(spark: SparkSession, path: str, scope: str, relative_path: str) -> DataFrame:
    """The observation of one path in a scope; only its bucket is read, and the filter reaches the scan."""
    files = _Files(spark, path)
    n = _bucket_count(files, BUCKETS)
    bucket = str(spark.range(1).select(F.pmod(F.xxhash64(F.lit(scope), F.lit(relative_path)), F.lit(n))).first()[0])
    entries = [(bucket, *e) for e in _manifest(files, None)["buckets"].get(bucket, [])]
    return _merged(spark, files, entries, OBSERVATIONS).filter((F.col("scope") == scope) & (F.col("relative_path") == relative_path))


def publish_batches(spark: SparkSession, path: str, records: DataFrame, key: str = "file_sha256", batches: int = 1) -> list[int]:
    """Publishes records in so many versions, dealt by a hash of the key; what was published stays if a later batch fails."""
    return [publish(spark, path, records.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == k)) for k in range(batches)]


def legacy_records(rows: DataFrame, evidence_type: str, algorithm: str, runtime: str, payload: tuple[str, ...]) -> DataFrame:
    """Rows of an older schema (file_sha256 and payload columns) as records of this store, without writing anything."""
    body = F.to_json(F.struct(*sorted(payload)), {"ignoreNullFields": "false"})
    return rows.select("file_sha256", F.lit(evidence_type).alias("evidence_type"), F.lit(algorithm).alias("algorithm"), F.lit(runtime).alias("runtime"), body.alias("payload_json"))


def payloads(spark: SparkSession, path: str, evidence_type: str, algorithm: str, runtime: str) -> DataFrame:
    """One namespace's payloads; the filter reaches the Parquet scan, which is sorted by it."""
    return read(spark, path).filter((F.col("evidence_type") == evidence_type) & (F.col("algorithm") == algorithm) & (F.col("runtime") == runtime)).select("file_sha256", "payload_json")
