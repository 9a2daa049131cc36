"""The journal as a stream: run states folded as events arrive."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from veritree.operators.journal import EVENTS as EVENT_NAMES
from veritree.operators.journal import MODES

EVENTS = "seq long, run_id string, event string"
STATES = "run_id string, last_seq long, planned long, completed long, state string, malformed boolean"


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines journal files as a stream, malformed lines failing the query."""
    return spark.readStream.schema(EVENTS).option("mode", "FAILFAST").json(path)


def run_states(events: DataFrame) -> DataFrame:
    """Each run's state after every batch that touches it; state is five numbers a run, whatever its length."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, planned, completed, name, bad = state.get if state.exists else (-1, 0, 0, "open", False)
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, event in zip(rows["seq"], rows["event"]):
            bad = bad or name != "open" or seq <= last
            last = max(last, int(seq))
            planned += event == "planned"
            completed += event == "completed"
            name = event if event in ("committed", "incomplete") else name
        state.update((last, planned, completed, name, bad))
        yield pd.DataFrame([(key[0], last, planned, completed, name, bad)], columns=["run_id", "last_seq", "planned", "completed", "state", "malformed"])

    return events.groupBy("run_id").applyInPandasWithState(fold, STATES, "last long, planned long, completed long, state string, malformed boolean", "update", GroupStateTimeout.NoTimeout)


# ---- the strict reader

STRICT = "ts timestamp, seq long, run_id string, event string, tool string, mode string, target_run_id string, action_id string, action_count long, reason string"
_FIELDS = [c.split()[0] for c in STRICT.split(", ")]
PROBLEMS = "seq long, run_id string, problem string"
#: Runs are dealt into so many groups, which share their calls and timers. A checkpoint holds for one number only.
BUCKETS = 1024
#: Events as they come.
_WAITING = pa.schema([("ts_ms", pa.int64()), *[(n, pa.int64() if kind == "long" else pa.string()) for n, kind in (c.split() for c in STRICT.split(", ")[1:])]])
#: Events as they wait: what they are by place in EVENT_NAMES (-1: none of them), the rule that they break whatever came before, by place in _RULES, and what the other rules compare.
_CODED = pa.schema([("ts_ms", pa.int64()), ("seq", pa.int64()), ("run_id", pa.string()), ("kind", pa.int8()), ("fault", pa.int8()), ("target", pa.string()), ("action_id", pa.string()), ("count", pa.int64())])
_RULES = (
    "", "unknown-event", "duplicate-run", "tool", "mode", "unexpected-target", "no-target", "unknown-run", "after-end", "no-action", "duplicate-action", "not-planned", "completed-twice", "count", "commit-target",
    "no-reason",
)
_RULE = {name: i for i, name in enumerate(_RULES)}
_START, _PLANNED, _COMPLETED, _COMMITTED, _INCOMPLETE = range(len(EVENT_NAMES))
#: Waiting events are packed again by so many; a task deals out so many events at once; a page of the state holds about so many records.
_AT_ONCE, _DEALT, _PAGE = 10_000, 500_000, 1_000
_SMALL = pa.ipc.IpcWriteOptions(compression="lz4")


def _packed(events: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, events.schema, options=_SMALL) as out:
        out.write_table(events)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: Iterable[bytes], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(bytes(x)).read_all() for x in packed)]).combine_chunks()


def _coded(events: pa.Table, tools: tuple[str, ...]) -> pa.Table:
    """Events with the columns of _WAITING as they wait."""
    held = lambda x: np.asarray(pc.fill_null(x, False))
    event, to = events["event"], events["target_run_id"]
    kind = np.asarray(pc.fill_null(pc.index_in(event, value_set=pa.array(EVENT_NAMES)), -1))
    start, no_target, empty = kind == _START, ~held(pc.not_equal(to, "")), ~held(pc.not_equal(events["action_id"], ""))
    of_action = (kind == _PLANNED) | (kind == _COMPLETED)
    fault = np.select(
        [
            kind < 0, start & ~held(pc.is_in(events["tool"], value_set=pa.array(tools, pa.string()))), start & ~held(pc.is_in(events["mode"], value_set=pa.array(MODES))), start & held(pc.equal(events["mode"], "APPLY")) & held(pc.is_valid(to)),
            start & held(pc.equal(events["mode"], "UNDO")) & no_target, of_action & empty, (kind == _INCOMPLETE) & held(pc.is_null(events["reason"])),
        ],
        [_RULE[x] for x in ("unknown-event", "tool", "mode", "unexpected-target", "no-target", "no-action", "no-reason")],
        0,
    )
    text = lambda x, where: pc.if_else(pa.array(where), x, pa.scalar(None, pa.string()))
    columns = [events["ts_ms"], events["seq"], events["run_id"], pa.array(kind.astype("int8")), pa.array(fault.astype("int8")), text(to, start | (kind == _COMMITTED)), text(events["action_id"], of_action & ~empty), events["action_count"]]
    return pa.table(columns, schema=_CODED)


def _codes(*parts: pa.ChunkedArray | pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """The texts of each part by their places in one list of distinct texts (-1: null), and that list."""
    chunks = [c for x in parts for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])]
    coded = pa.chunked_array(chunks, pa.string()).combine_chunks().dictionary_encode()
    coded = coded if isinstance(coded, pa.DictionaryArray) else pa.chunked_array(coded).combine_chunks()
    return np.split(np.asarray(pc.fill_null(coded.indices, -1)).astype("int64"), np.cumsum([len(x) for x in parts])[:-1]), coded.dictionary


def _keys(runs: pa.Array, actions: pa.Array | None = None) -> pa.Array:
    """One text for each run, null included, or for each run and action."""
    marked = pc.fill_null(pc.binary_join_element_wise("r", runs, ""), "n")
    return marked if actions is None else pc.binary_join_element_wise(pc.cast(pc.utf8_length(marked), pa.string()), marked, actions, ":")


class _Pages:
    """Records of the state by their keys, in pages by a hash of the key, which double in number as records come: what is read, written and called follows the keys at hand, not each of them and not the whole state."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, values: list[tuple[str, pa.DataType]]):
        self.schema = pa.schema([("key", pa.string()), ("hash", pa.int64()), *values])
        self.pages = handle.getMapState(name, "page long", "records binary")

    def _size(self) -> tuple[int, int]:
        """Pages as a power of 2, and records."""
        found = self.pages.getValue((-1,))
        return tuple(map(int, bytes(found[0]).split())) if found else (0, 0)

    def _read(self, pages: Iterable[int]) -> pa.Table:
        return _unpacked([found[0] for p in pages if (found := self.pages.getValue((int(p),)))], self.schema)

    def read(self, keys: pa.Array) -> tuple[np.ndarray, pa.Table, np.ndarray]:
        """For distinct keys: their hashes, all records of their pages, and the place of each key in these (-1: none)."""
        hashes = pd.util.hash_array(keys.to_numpy(zero_copy_only=False), categorize=False).view("int64")
        kept = self._read(np.unique(hashes & ((1 << self._size()[0]) - 1)))
        return hashes, kept, np.asarray(pc.fill_null(pc.index_in(keys, value_set=kept["key"].combine_chunks()), -1))

    def write(self, keys: pa.Array, hashes: np.ndarray, kept: pa.Table, at: np.ndarray, values: list) -> None:
        """Values of keys of a read, or of some of them, and the other results of it."""
        depth, n = self._size()
        others = np.ones(len(kept), bool)
        others[at[at >= 0]] = False
        records = pa.concat_tables([kept.filter(pa.array(others)), pa.table([keys, pa.array(hashes), *values], schema=self.schema)])
        n += int((at < 0).sum())
        emptied = set()
        if n > _PAGE << depth:
            seen, old = set(np.unique(np.asarray(kept["hash"]) & ((1 << depth) - 1)).tolist()), set(range(1 << depth))
            records, emptied = pa.concat_tables([records, self._read(old - seen)]), old
            while n > _PAGE << depth:
                depth += 1
        self.pages.updateValue((-1,), (f"{depth} {n}".encode(),))
        page = np.asarray(records["hash"]) & ((1 << depth) - 1)
        records = records.take(pa.array(np.argsort(page, kind="stable")))
        pages, first = np.unique(np.sort(page), return_index=True)
        for p, low, high in zip(pages.tolist(), first.tolist(), [*first[1:].tolist(), len(records)]):
            self.pages.updateValue((p,), (_packed(records.slice(low, high - low)),))
        for p in emptied - set(pages.tolist()):  # all that was there has moved
            self.pages.updateValue((p,), (_packed(self.schema.empty_table()),))


def _before(x: np.ndarray, first: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """How many of x came before each row: initial ones of its group, and those from the group's first row on."""
    sums = np.cumsum(x) - x
    return sums - sums[first] + initial


def _firsts(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the runs of equal numbers begins, and this by row."""
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return begins, np.repeat(begins, np.diff(np.r_[begins, len(group)]))


class StrictReader(StatefulProcessor):
    """The rules of `operators.journal.event_problems` for the runs of one bucket at a time.

    Events wait until the watermark has passed their time and are then judged in order of seq, so their order of arrival and the cut into batches do not matter. State
    is four counters and a target a run, two counters for each action of a run that has not ended (read for the actions at hand only: after its end no rule asks for them), both in pages,
    and the events that wait, packed by the batches in which they came. A bucket has one timer, for the first of them. Events that are due are judged together, by running sums in
    arrays, so no call and no step of Python is made for each event, action or run.
    """

    def __init__(self, tools: tuple[str, ...]):
        self.tools = tools

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = _Pages(handle, "runs", [(n, pa.int64()) for n in ("starts", "planned", "completed", "ended")] + [("target", pa.string()), ("has_actions", pa.bool_())])
        self.actions = _Pages(handle, "actions", [(n, pa.int64()) for n in ("planned", "completed")])
        self.waiting = handle.getListState("waiting", "least_ms long, events binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        parts = [_coded(pa.Table.from_pandas(part[_WAITING.names], _WAITING, preserve_index=False), self.tools) for part in rows if len(part)]
        return self._wait([(pc.min(x["ts_ms"]).as_py(), _packed(x)) for x in parts], timerValues)

    def _wait(self, added: list[tuple[int, bytes]], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if added:
            self.waiting.appendList(added)
            self.handle.registerTimer(max(min(least for least, _ in added), timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        opened, later = [], []
        for least, packed in self.waiting.get():
            (opened if least <= now else later).append((least, bytes(packed)))
        if not opened:  # another timer of this watermark was first
            return
        events = _unpacked([packed for _, packed in opened], _CODED)
        is_due = pc.less_equal(events["ts_ms"], now)
        rest = events.filter(pc.invert(is_due))
        later += [(pc.min(x["ts_ms"]).as_py(), _packed(x)) for x in (rest.slice(at, _AT_ONCE) for at in range(0, len(rest), _AT_ONCE))]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(least for least, _ in later))
        else:
            self.waiting.clear()
        found = self._judged(events.filter(is_due))
        for at in range(0, len(found), _AT_ONCE):
            yield found.iloc[at : at + _AT_ONCE]

    def _judged(self, events: pa.Table) -> pd.DataFrame:
        """The problems of events that are due, of any runs of the bucket, after those judged before; the state is brought up to date."""
        coded = pc.dictionary_encode(events["run_id"].combine_chunks(), null_encoding="encode")
        runs, run, seq = coded.dictionary, np.asarray(coded.indices), np.asarray(events["seq"])
        order = np.lexsort((seq, run))
        events, run, seq = events.take(pa.array(order)), run[order], seq[order]
        run_keys = _keys(runs)
        hashes, kept, at = self.runs.read(run_keys)
        left = kept.take(pa.array(at, mask=at < 0))  # the runs as they were left
        count = lambda name: np.asarray(pc.fill_null(left[name], 0))
        kind, fault = np.asarray(events["kind"]), np.asarray(events["fault"])
        start, planned, completed = kind == _START, kind == _PLANNED, kind == _COMPLETED
        ends, commit = (kind == _COMMITTED) | (kind == _INCOMPLETE), kind == _COMMITTED
        begins, first = _firsts(run)  # every run has events, so group g is run g
        marks = {"starts": start, "planned": planned, "completed": completed, "ended": ends}
        starts, n_planned, n_completed, ended = (_before(x.astype("int64"), first, count(name)[run]) for name, x in marks.items())

        (to, target), texts = _codes(events["target"], left["target"])
        named = np.flatnonzero(start & (to >= 0))[::-1]
        where = np.full(len(runs), len(run))
        where[run[named]] = named  # the first one is written last
        new_target = np.where((target < 0) & (where < len(run)), to[np.minimum(where, len(run) - 1)], target)
        known = np.where((target[run] >= 0) | (where[run] < np.arange(len(run))), new_target[run], -1)

        has_actions, ended_now = np.asarray(pc.fill_null(left["has_actions"], False)), count("ended") + np.add.reduceat(ends.astype("int64"), begins) > 0
        own_planned, own_completed, touched = self._actions(events, run, runs, planned, completed, has_actions, ended_now)

        n = np.asarray(pc.fill_null(events["count"], -1))
        no_count = np.asarray(pc.is_null(events["count"]))
        rule = np.select(
            [
                kind < 0, start & (starts > 0), start, starts == 0, ended > 0, fault == _RULE["no-action"], planned & (own_planned > 0), completed & (own_planned == 0), completed & (own_completed > 0),
                commit & (no_count | (n != n_planned) | (n != n_completed)), commit & (to != known),
            ],
            [
                fault, _RULE["duplicate-run"], fault, _RULE["unknown-run"], _RULE["after-end"], fault, _RULE["duplicate-action"], _RULE["not-planned"], _RULE["completed-twice"], _RULE["count"], _RULE["commit-target"],
            ],
            fault,
        )
        new = [pa.array(count(name) + np.add.reduceat(x.astype("int64"), begins)) for name, x in marks.items()]
        targets = texts.take(pa.array(new_target, mask=new_target < 0))
        self.runs.write(run_keys, hashes, kept, at, [*new, targets, pa.array(has_actions | touched)])
        bad = np.flatnonzero(rule)
        return pd.DataFrame({"seq": seq[bad], "run_id": runs.take(pa.array(run[bad])).to_pandas(), "problem": np.array(_RULES, dtype=object)[rule[bad]]})

    def _actions(self, events: pa.Table, run: np.ndarray, runs: pa.Array, planned: np.ndarray, completed: np.ndarray, has_actions: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often the action of each row was planned and completed before, and which runs have actions that are kept from now on."""
        own_planned, own_completed, touched = np.zeros(len(run), "int64"), np.zeros(len(run), "int64"), np.zeros(len(runs), bool)
        (action,), texts = _codes(events["action_id"])
        rows = np.flatnonzero(action >= 0)
        if not len(rows):
            return own_planned, own_completed, touched
        pair = run[rows] * np.int64(len(texts)) + action[rows]
        order = np.argsort(pair, kind="stable")  # rows are in order of seq within a run
        rows, pair = rows[order], pair[order]
        begins, first = _firsts(pair)
        of, p, c = run[rows[begins]], planned[rows].astype("int64"), completed[rows].astype("int64")
        was = np.zeros((2, len(begins)), "int64")
        asked = np.flatnonzero(~ended[of] | has_actions[of])
        if len(asked):  # pairs that were kept, or will be
            keys = _keys(runs.take(pa.array(of[asked])), texts.take(pa.array(action[rows[begins[asked]]])))
            hashes, kept, at = self.actions.read(keys)
            found = kept.take(pa.array(at, mask=at < 0))
            for i, name in enumerate(("planned", "completed")):
                was[i, asked] = np.asarray(pc.fill_null(found[name], 0))
        group = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(pair)]))
        own_planned[rows], own_completed[rows] = _before(p, first, was[0][group]), _before(c, first, was[1][group])
        if len(asked) and (going := ~ended[of[asked]]).any():
            now = [pa.array((x[asked] + np.add.reduceat(y, begins)[asked])[going]) for x, y in zip(was, (p, c))]
            self.actions.write(keys.filter(pa.array(going)), hashes[going], kept, at[going], now)
            touched[of[asked[going]]] = True
        return own_planned, own_completed, touched

    def close(self) -> None:
        pass


class PackedReader(StrictReader):
    """A strict reader of events that came packed by bucket, from `_dealt`."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        return self._wait([(int(least), bytes(packed)) for part in rows for least, packed in zip(part["least_ms"], part["events"])], timerValues)


def _dealt(tools: tuple[str, ...]):
    """Events of a task, coded and packed by bucket: a row of the exchange holds many of them, as rows are given to a processor one by one."""

    def packs(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        bucket = np.asarray(table["bucket"])
        order = np.argsort(bucket, kind="stable")
        coded = _coded(table.select(_WAITING.names).cast(_WAITING), tools).take(pa.array(order))
        begins, _ = _firsts(bucket[order])
        least = np.minimum.reduceat(np.asarray(coded["ts_ms"]), begins)
        out = [_packed(coded.slice(low, high - low)) for low, high in zip(begins.tolist(), [*begins[1:].tolist(), len(table)])]
        yield pa.record_batch([pa.array(bucket[order][begins], pa.int32()), pa.array(least), pa.array(out, pa.binary())], ["bucket", "least_ms", "events"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= _DEALT:
                yield from packs(held)
                held, n = [], 0
        if held:
            yield from packs(held)

    return deal


def strict_problems(events: DataFrame, tools: tuple[str, ...], late: str = "10 minutes") -> DataFrame:
    """A stream of the events that a strict reader refuses: seq, run_id, problem. events: a stream with the columns of STRICT, at most `late` out of order by ts; seq follows ts.

    Needs the RocksDB state store, which is set for the session unless it has another one. An event that is later than `late` is judged when it comes.
    """
    conf, name = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (conf.get(name, "") or ""):
        conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select(*_FIELDS).withWatermark("ts", late)
    rows = rows.select(F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("int").alias("bucket"), F.unix_millis("ts").alias("ts_ms"), *_FIELDS[1:])
    packs = rows.mapInArrow(_dealt(tools), "bucket int, least_ms long, events binary")
    return packs.groupBy("bucket").transformWithStateInPandas(PackedReader(tools), PROBLEMS, "Append", "EventTime")
