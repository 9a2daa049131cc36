import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritree import catalogue_plans
from veritree.operators import journal
from veritree.streaming import journal as stream


def timed(events):
    """A second for each thousand numbers, from which events may be some seconds off in arrival."""
    return events.withColumn("ts", (F.col("seq") / 1000).cast("timestamp"))


@pytest.mark.parametrize("cut", ["one", "many", "shuffled"])
def test_strict_stream_equals_the_batch_reader(spark, sf, tmp_path, cut):
    events = timed(catalogue_plans.journal_events(spark, sf)).select(*stream._FIELDS).filter("seq < 120000")
    want = {tuple(r) for r in journal.event_problems(events, catalogue_plans.TOOLS).collect()}
    last = events.agg(F.max("seq")).first()[0]
    r = random.Random(5)
    rows = sorted(events.collect(), key=lambda x: x.seq)
    if cut == "shuffled":  # within the time that is waited for
        rows = [x for _, x in sorted(((x.seq + r.randrange(20_000), i), x) for i, x in enumerate(rows))]
    n = 1 if cut == "one" else 4
    source = tmp_path / "in"
    for k in range(n):
        spark.createDataFrame(rows[k * len(rows) // n : (k + 1) * len(rows) // n], events.schema).coalesce(1).write.mode("append").parquet(str(source))
    close = spark.createDataFrame([(last + 10**8, "end", "RUN_STARTED", "1-URGENT", "APPLY")], "seq long, run_id string, event string, tool string, mode string")
    close = timed(close).select(*[F.col(c) if c in ("ts", *close.columns) else F.lit(None).cast(dict(events.dtypes)[c]).alias(c) for c in stream._FIELDS])
    close.coalesce(1).write.mode("append").parquet(str(source))
    out = stream.strict_problems(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source)), catalogue_plans.TOOLS, "60 seconds")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(x) for x in spark.read.schema(stream.PROBLEMS).parquet(str(tmp_path / "out")).collect()} == want and len(want) > 20


def test_windows_of_progress_are_alike_in_a_stream(spark, tmp_path):
    r = random.Random(3)
    rows = [(job, float(r.randrange(3000)), r.choice([None, -5, 100, 2000])) for job in "abc" for _ in range(60)]
    df = spark.createDataFrame(rows, "job string, s double, bytes long").select("job", F.col("s").cast("timestamp").alias("ts"), "bytes")
    last = spark.createDataFrame([("end", 10.0**7, None)], "job string, s double, bytes long").select("job", F.col("s").cast("timestamp").alias("ts"), "bytes")
    source = str(tmp_path / "in")
    df.repartition(4).write.parquet(source)
    last.coalesce(1).write.mode("append").parquet(source)
    windows = journal.progress_windows(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source), "job", "5 minutes", "2 hours")
    windows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    streamed, batch = spark.read.parquet(str(tmp_path / "out")), journal.progress_windows(df, "job", "5 minutes")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    totals = df.groupBy("job").agg(F.count(F.lit(1)).alias("total_items"), F.sum(F.greatest("bytes", F.lit(0))).alias("total_bytes"))
    one, two = (sorted(map(tuple, journal.progress_eta(w, totals, "job").collect()), key=str) for w in (streamed, batch))
    assert one == two
    for job, ends, done, done_bytes, elapsed, rate, eta in one:
        mine = sorted(((s, b) for j, s, b in rows if j == job and s < ends.timestamp()), key=lambda x: x[0])
        assert done == len(mine) and done_bytes == sum(max(b or 0, 0) for _, b in mine) and elapsed == ends.timestamp() - mine[0][0]
        whole, size = 60, sum(max(b or 0, 0) for j, _, b in rows if j == job)
        want = None if done < 3 or done == whole else elapsed * (size - done_bytes) / done_bytes if done_bytes else elapsed * (whole - done) / done
        assert eta == (None if want is None else round(want, 3))


class Handle:
    """State in memory, in place of Spark's, that counts calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def state(self, *_):
        outer = self

        class State(dict):
            def __getattribute__(own, name):
                if name in ("getValue", "updateValue", "containsKey", "appendList", "put", "get"):
                    outer.calls += 1
                return dict.__getattribute__(own, name)

        State.getValue = lambda own, k: dict.get(own, k)
        State.updateValue = dict.__setitem__
        State.containsKey = dict.__contains__
        State.appendList = lambda own, rows: own.update({len(own) + i: r for i, r in enumerate(rows)})
        State.put = lambda own, rows: (own.clear(), own.update(enumerate(rows)))
        State.get = lambda own: iter(list(own.values()))
        return State()

    getMapState = getListState = getValueState = state

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Times:
    now = 0

    def getCurrentWatermarkInMs(self):
        return self.now


def judged(rows, cuts):
    """Problems and calls of a reader that gets rows (with ts) up to each cut, and then a watermark a little before it."""
    reader, handle, times, out = stream.StrictReader(catalogue_plans.TOOLS), Handle(), Times(), []
    reader.init(handle)
    for low, high in zip([0, *cuts], cuts):
        part = pd.DataFrame([r for r in rows if low <= r["ts_ms"] < high], columns=["ts", "bucket", *stream._WAITING.names])
        reader.handleInputRows((0,), iter([part]), times)
        times.now = max(times.now, high - 50)
        while due := sorted(t for t in handle.timers if t <= times.now):
            handle.timers.discard(due[0])
            out += [tuple(x) for d in reader.handleExpiredTimer((0,), times, None) for x in d.itertuples(index=False)]
    return sorted(out), handle.calls


def test_calls_to_the_state_follow_runs_not_events(spark):
    r, rows = random.Random(8), []
    for k in range(4000):
        event = r.choices(["RUN_STARTED", "ACTION_PLANNED", "ACTION_COMPLETED", "RUN_COMMITTED", "RUN_INCOMPLETE", "ODD"], [3, 20, 20, 0.3, 0.2, 0.2])[0]
        at = 1 + k // 4  # of a run in one order with seq
        rows.append({"ts_ms": at, "seq": k, "run_id": f"r{r.randrange(20)}", "event": event, "tool": r.choice([*catalogue_plans.TOOLS, "x", None]), "mode": r.choice(["APPLY", "UNDO"]), "target_run_id": r.choice([None, "r1"]), "action_id": r.choice([None, "", *map(str, range(30))]), "action_count": r.choice([None, 1, 2]), "reason": r.choice([None, "s"])})
    end = 10**6
    once, calls = judged(rows, [end])
    events = spark.createDataFrame([{**x, "ts": None} for x in rows], "seq long, run_id string, event string, tool string, mode string, target_run_id string, action_id string, action_count long, reason string")
    assert once == sorted(map(tuple, journal.event_problems(events, catalogue_plans.TOOLS).collect())) and len(once) > 500
    assert calls < 20 * (2 + 30) + 20
    for cuts in ([500, end], [100, 200, 300, 301, 700, end], list(range(40, 1100, 40)) + [end]):
        assert judged(rows, cuts)[0] == once


@pytest.mark.parametrize("page", [1_000, 20])
def test_calls_to_the_state_follow_pages_not_runs_or_actions(spark, monkeypatch, page):
    monkeypatch.setattr(stream, "_PAGE", page, raising=False)
    r, rows, ids = random.Random(9), [], ["", "n", "r", "\u00e91", *(f"r{k}" for k in range(2000))]
    names = [*stream.EVENT_NAMES, "ODD", None]
    for k in range(12_000):
        event = r.choices(names, [12, 20, 20, 4, 2, 1, 0.3])[0]
        tool, mode = r.choice([*catalogue_plans.TOOLS] * 3 + ["x", None]), r.choice(["APPLY", "UNDO", "APPLY", "UNDO", "odd", None])
        rows.append({"ts_ms": 1 + k // 10, "seq": k, "run_id": r.choice(ids), "event": event, "tool": tool, "mode": mode, "target_run_id": r.choice([None, None, "", "r1", "r2"]), "action_id": r.choice([None, "", "a", "b", "c", "1:a"]), "action_count": r.choice([None, 0, 1, -1]), "reason": r.choice([None, "", "s"])})
    events = spark.createDataFrame([{**x, "ts": None} for x in rows], "seq long, run_id string, event string, tool string, mode string, target_run_id string, action_id string, action_count long, reason string")
    want = sorted(map(tuple, journal.event_problems(events, catalogue_plans.TOOLS).collect()))
    assert len({x[2] for x in want}) == 15
    for cuts in ([10**6], [400, 800, 10**6], [*range(100, 1300, 100), 10**6]):
        got, calls = judged(rows, cuts)
        assert got == want and (page < 1_000 or calls < 40 * len(cuts))
    # a run without an id is one run
    some = [{**x, "run_id": None} for x in rows[:50]]
    events = spark.createDataFrame(some, events.schema)
    want = [x for x in map(tuple, journal.event_problems(events, catalogue_plans.TOOLS).orderBy("seq").collect())]
    assert judged(some, [3, 10**6])[0] == want and {x[1] for x in want} == {None}
