"""A versioned store of derived evidence: keyed by content hash, type, algorithm and runtime."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("file_sha256", "evidence_type", "algorithm", "runtime")
STATE = ("device", "inode", "size", "modified_ns", "changed_ns")


def memo_join(files: DataFrame, evidence: DataFrame, evidence_type: str, algorithm: str, runtime: str) -> DataFrame:
    """Files with their payload; null where it must be computed. Other versions never count."""
    usable = evidence.filter((F.col("evidence_type") == evidence_type) & (F.col("algorithm") == algorithm) & (F.col("runtime") == runtime)).select(F.col("file_sha256").alias("sha256"), "payload_json")
    return files.join(usable.groupBy("sha256").agg(F.max("payload_json").alias("payload_json")), "sha256", "left")


def upsert(store: DataFrame, added: DataFrame, order: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """The union with the latest row of each key, by `order` and then the payload: an aggregate, so a hot key is combined before it is exchanged."""
    rest = [order, "payload_json", *[c for c in store.columns if c not in (*key, order, "payload_json")]]
    top = store.unionByName(added).groupBy(*key).agg(F.max(F.struct(*rest)).alias("r"))
    return top.select(*[c if c in key else F.col(f"r.{c}").alias(c) for c in store.columns])


def scope(device, inode):
    """The name of a collection's root, in which observations are kept."""
    return F.concat_ws(":", F.lit("collection-v1"), device.cast("string"), inode.cast("string"))


def observation_states(observations: DataFrame, current: DataFrame) -> DataFrame:
    """Each observation's path and state against the tree as it is: current (all of its state equal), stale, unreadable or gone. current: path, category and the state."""
    now = current.select("path", "category", *[F.col(c).alias(f"now_{c}") for c in STATE])
    rows = observations.join(now, F.col("relative_path") == F.col("path"), "left")
    same = F.lit(True)
    for c in STATE:
        same = same & F.col(c).eqNullSafe(F.col(f"now_{c}"))
    state = F.when(F.col("path").isNull(), "gone").when(F.col("category") == "unreadable", "unreadable").when(same, "current").otherwise("stale")
    return rows.select("relative_path", "byte_sha256", state.alias("state"))


def matching(observations: DataFrame, current: DataFrame, scope_name: str) -> DataFrame:
    """path and digest of the observations of one scope that still hold, so that these files need no hashing."""
    rows = observations.filter((F.col("scope") == scope_name) & F.col("byte_sha256").isNotNull())
    return observation_states(rows, current).filter("state = 'current'").select(F.col("relative_path").alias("path"), "byte_sha256")


def compatibility(evidence: DataFrame, versions: DataFrame) -> DataFrame:
    """Records of each type by how they fit the versions in use: compatible, stale (the type is known, another version) or unknown. versions: evidence_type, algorithm, runtime, few."""
    known = versions.select("evidence_type").distinct().withColumn("type_known", F.lit(True))
    exact = versions.select("evidence_type", "algorithm", "runtime").distinct().withColumn("exact", F.lit(True))
    rows = evidence.join(exact, ["evidence_type", "algorithm", "runtime"], "left").join(known, "evidence_type", "left")
    return rows.groupBy("evidence_type").agg(
        F.count(F.when(F.col("exact"), 1)).alias("compatible"),
        F.count(F.when(F.col("exact").isNull() & F.col("type_known"), 1)).alias("stale"),
        F.count(F.when(F.col("type_known").isNull(), 1)).alias("unknown"),
    )


def status(evidence: DataFrame, observations: DataFrame, current: DataFrame) -> DataFrame:
    """Evidence per type, and how much of it any observation, or one whose file state is current, still points to. Semi joins: repeated hashes do not multiply."""
    seen = observations.filter("byte_sha256 is not null")
    same = [observations[c].eqNullSafe(current[c]) for c in STATE]
    fresh = seen.join(current, (observations["relative_path"] == current["path"]) & same[0] & same[1] & same[2] & same[3] & same[4], "left_semi")
    keys = lambda df, name: df.select(F.col("byte_sha256").alias("file_sha256")).distinct().withColumn(name, F.lit(True))
    marked = evidence.join(keys(seen, "linked"), "file_sha256", "left").join(keys(fresh, "current"), "file_sha256", "left")
    count = lambda c: F.count(F.when(c, 1))
    return marked.groupBy("evidence_type").agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct(F.struct("algorithm", "runtime")).alias("namespaces"),
        count(F.col("linked")).alias("linked"),
        count(F.col("linked").isNull()).alias("unlinked"),
        count(F.col("current")).alias("current"),
    )


def report(evidence: DataFrame, observations: DataFrame, current: DataFrame, versions: DataFrame) -> DataFrame:
    """One row on a whole store: records, their types and namespaces; how many fit the algorithms in use, are stale or of an unknown type; observations by state; and how many records any observation, or one that still holds, points to.

    versions: evidence_type, algorithm, few. An observation whose file is gone is stale. Hashes are made one row each before they are joined, so copies do not multiply records.
    """
    states = observation_states(observations, current).withColumn("state", F.when(F.col("state") == "gone", "stale").otherwise(F.col("state")))
    hashes = states.filter("byte_sha256 is not null").groupBy(F.col("byte_sha256").alias("file_sha256")).agg(F.max(F.col("state") == "current").alias("fresh"))
    known = versions.groupBy("evidence_type").agg(F.collect_set("algorithm").alias("algorithms"))
    rows = evidence.join(known, "evidence_type", "left").join(hashes, "file_sha256", "left")
    n = lambda c: F.count(F.when(c, 1))
    fits = F.coalesce(F.array_contains("algorithms", F.col("algorithm")), F.lit(False))
    one = rows.agg(
        F.count(F.lit(1)).alias("evidence_records"), F.countDistinct("evidence_type").alias("evidence_types"), F.countDistinct("evidence_type", "algorithm", "runtime").alias("evidence_namespaces"),
        n(fits).alias("algorithm_compatible"), n(F.col("algorithms").isNotNull() & ~fits).alias("stale_algorithm"), n(F.col("algorithms").isNull()).alias("unknown_type"),
        n(F.col("fresh").isNotNull()).alias("linked"), n(F.col("fresh")).alias("linked_current"), n(F.col("fresh").isNull()).alias("unlinked"),
    )
    seen = states.agg(F.count(F.lit(1)).alias("observations"), *[n(F.col("state") == s).alias(f"observations_{s}") for s in ("current", "stale", "unreadable")])
    return one.withColumn("__one", F.lit(1)).join(seen.withColumn("__one", F.lit(1)), "__one").drop("__one")


def valid(evidence: DataFrame) -> DataFrame:
    """Rows that meet the store's constraints: a digest, non-empty names, a payload that is a JSON object without repeated keys."""
    keys = F.json_object_keys("payload_json")
    return evidence.filter(F.col("file_sha256").rlike("^[0-9a-f]{64}$") & (F.length("evidence_type") > 0) & (F.length("algorithm") > 0) & F.col("runtime").isNotNull() & keys.isNotNull() & (F.size(keys) == F.size(F.array_distinct(keys))))


def valid_observations(observations: DataFrame) -> DataFrame:
    """Observations with a scope and a relative path, a whole state, and a digest or none."""
    state = F.lit(True)
    for c in STATE:
        state = state & F.col(c).isNotNull() & (F.col(c) >= 0)
    digest = F.col("byte_sha256").isNull() | F.col("byte_sha256").rlike("^[0-9a-f]{64}$")
    return observations.filter((F.length("scope") > 0) & (F.length("relative_path") > 0) & ~F.startswith("relative_path", F.lit("/")) & state & digest)
