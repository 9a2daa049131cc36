from veritree.operators import coverage
from veritree.sinks import inventories

FILE = "path string, size long, sha256 string"


def test_stored_inventories_are_compared_without_exchange(spark, tmp_path):
    s = [(f"a/{k}", k % 50, f"h{k % 50}") for k in range(400)] + [("hot/%d" % k, 7, "same") for k in range(300)]
    d = [(f"b/{k}", k, f"h{k}") for k in range(20, 70)]
    sides = [spark.createDataFrame(x, FILE) for x in (s, d)]
    want = coverage.byte_coverage(*sides).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        paths = [str(tmp_path / n) for n in ("s", "d")]
        for x, p in zip(sides, paths):
            inventories.write(x, p, buckets=8)
        for again in (False, True):
            if again:  # another session knows only the folders
                [inventories.forget(spark, p) for p in paths]
            both = [inventories.identities(spark, p) for p in paths]
            one = coverage.coverage_of(coverage.joined_counts(*both))
            plan = one._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan and plan.count("Exchange") == 1  # to the one row
            assert one.collect() == want
            assert both[0].filter("sha256 = 'same'").first().n == 300 and both[0].count() == 51
        assert inventories.files(spark, paths[0]).count() == 700
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        [inventories.forget(spark, p) for p in paths]
