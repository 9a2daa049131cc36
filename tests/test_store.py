import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from veritree.sinks import store

SCHEMA = "file_sha256 string, evidence_type string, algorithm string, runtime string, payload_json string"


def batch(spark, ids, n):
    return spark.createDataFrame([(f"{k:064x}", "t", "v", "r", json.dumps({"n": n})) for k in ids], SCHEMA)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def content(df):
    return {int(r.file_sha256, 16): (json.loads(r.payload_json)["n"], r.version) for r in df.collect()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "s")
    assert store.publish(spark, path, batch(spark, range(500), 1), buckets=16) == 1
    first = files(path)
    assert len({os.path.dirname(f) for f in first}) == 16
    assert store.publish(spark, path, batch(spark, [3], 2)) == 2
    assert len(files(path) - first) == 1 and first <= files(path)
    assert content(store.read(spark, path)) == {k: (2, 2) if k == 3 else (1, 1) for k in range(500)}
    assert content(store.read(spark, path, 1)) == {k: (1, 1) for k in range(500)}


def test_compaction_changes_nothing_that_is_read(spark, tmp_path):
    path, want = str(tmp_path / "s"), {}
    for n in range(1, 5):
        ids = range(n * 3, 40 + n * 5)
        assert store.publish(spark, path, batch(spark, ids, n), buckets=4) == n
        want |= {k: (n, n) for k in ids}
    assert content(store.read(spark, path)) == want
    assert store.compact(spark, path, deltas=2) == 5 and content(store.read(spark, path)) == want
    assert store.compact(spark, path, deltas=2) == 5  # nothing left to do
    manifest = store._manifest(store._Files(spark, path), None)
    assert all(len(found) == 1 for found in manifest["buckets"].values())
    assert store.publish(spark, path, batch(spark, [7], 9)) == 6
    assert content(store.read(spark, path)) == want | {7: (9, 6)}
    assert store.vacuum(spark, path, keep=1, older_than=-60) == 4  # the folders before the compaction
    assert content(store.read(spark, path)) == want | {7: (9, 6)}


def test_two_writers_and_a_compaction_at_once(spark, tmp_path):
    path = str(tmp_path / "s")
    store.publish(spark, path, batch(spark, range(20), 0), buckets=4)
    store.publish(spark, path, batch(spark, range(20), 0))
    got, jobs = [], [lambda n=n: got.append(store.publish(spark, path, batch(spark, [n, 100 + n], n))) for n in (1, 2, 3)]
    jobs.append(lambda: store.compact(spark, path, deltas=1))
    threads = [threading.Thread(target=j) for j in jobs]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(set(got)) == 3
    found = content(store.read(spark, path))
    assert len(found) == 23 and all(found[n][0] == n and found[100 + n][0] == n for n in (1, 2, 3))
    assert max(store._versions(store._Files(spark, path))) in (5, 6)  # the compaction may have had the last word, or none


def test_a_lost_writer_blocks_nobody(spark, tmp_path):
    path = str(tmp_path / "s")
    store.publish(spark, path, batch(spark, range(5), 1))
    at = store._Files(spark, path)
    store._write(at, batch(spark, range(5), 8), store.EVIDENCE, 64)  # it dies before its manifest
    stream = at.fs.create(at._path("manifests/.aside"), False)
    stream.close()
    assert store.publish(spark, path, batch(spark, [1], 2)) == 2
    assert {v[0] for v in content(store.read(spark, path)).values()} == {1, 2}
    assert not at.create("manifests/00000000000000000002", "{}") and store._manifest(at, None)["version"] == 2


def test_observations_by_scope_and_path(spark, tmp_path):
    path, schema = str(tmp_path / "o"), "scope string, relative_path string, device long, inode long, size long, modified_ns long, changed_ns long, byte_sha256 string"
    rows = [("c:1", f"d/{k}.jpg", 1, k, k, k, k, f"{k:064x}" if k % 3 else None) for k in range(50)]
    store.publish(spark, path, spark.createDataFrame(rows, schema), store.OBSERVATIONS, buckets=8)
    store.publish(spark, path, spark.createDataFrame([("c:1", "d/4.jpg", 1, 4, 99, 4, 4, None), ("c:2", "d/4.jpg", 1, 4, 5, 4, 4, None)], schema), store.OBSERVATIONS)
    assert [r.size for r in store.at_path(spark, path, "c:1", "d/4.jpg").collect()] == [99]
    assert store.at_path(spark, path, "c:1", "d/none.jpg").count() == 0
    assert store.read(spark, path, kind=store.OBSERVATIONS).count() == 51
    for bad in [("", "a", 1, 1, 1, 1, 1, None), ("c", "/a", 1, 1, 1, 1, 1, None), ("c", "a", None, 1, 1, 1, 1, None), ("c", "a", 1, 1, 1, 1, 1, "x")]:
        with pytest.raises(ValueError):
            store.publish(spark, path, spark.createDataFrame([bad], schema), store.OBSERVATIONS)


def test_a_namespace_is_filtered_in_the_scan(spark, tmp_path):
    path = str(tmp_path / "s")
    store.publish(spark, path, batch(spark, range(9), 1).union(batch(spark, range(9), 1).withColumn("evidence_type", F.lit("u"))))
    plan = store.payloads(spark, path, "t", "v", "r")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(evidence_type,t)" in plan and store.payloads(spark, path, "t", "v", "r").count() == 9
