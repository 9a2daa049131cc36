"""Conversation structure repair: the cheapest edits that give a conversation turns in a legal order.

Role initials must match `(s?(ua)+)?`. A turn is kept, given another role, or deleted, and empty turns are inserted, each at a
cost. Edits and the pattern together are a weighted automaton over the kinds of turns (role and fault).
It is determinised lazily: reading turns from the last to the first, a state is the vector of the least costs that are left from
each pattern state, less its minimum. Only vectors that occur are made, and a transition table
keeps what each kind of turn does to them, so a conversation costs one table look-up a turn (`Machine.scan`). The audit
goes back over the states of the scan, that is from the first turn on, along tight arcs: edits whose cost is exactly the difference of the
least costs. Where several are tight, the first initial in ASCII order goes (`D`, `I`, `K`, `R`); from one pattern state each initial
leads to one pattern state only, so this gives the least of all cheapest audits.

A task holds one byte a turn and the audit of one conversation; texts are streamed: once, beside their kinds, to find faults, and a
second time behind the audit, to repair or digest them. A digest over a conversation's text is one stream by definition, so one conversation is read by
one task, however long it is. Which turns are repeats is found before, by an aggregate over (conversation, role, text) and a join with those that occur twice, so equal turns of a hot
conversation are combined before they are exchanged.

Cases: a null role or text counts as one space, so it is no known role or blank. Turns go by number, nulls first, then by role and text, so ties have one order and
repeated rows are neighbours: the first counts, the others are duplicates. A null conv_id is a conversation as well. A role that is empty
has no initial and cannot be kept. Columns other than conv_id, turn, role and text are left out, whatever their names. A conversation without turns has costs of
zero and an empty audit; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritree.llm.common import written

#: White space that ends no sentence and makes no text.
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: The pattern: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; it may end in 0 and 3.
ARCS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
#: The one role that may be inserted in each pattern state.
INSERTED = {0: "u", 1: "u", 2: "a", 3: "u"}
LEGAL = ("su", "ua", "au")

#: Faults of a turn, as the higher bits of its kind; the lower two are the role.
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
_INITIALS = "sua"
_FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


class Machine:
    """The edit automaton, determinised as far as it has been used."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        self.vectors: list[tuple[int, ...]] = []
        self._numbers: dict[tuple[int, ...], int] = {}
        #: By state, the state and the cost that each kind of turn leads to.
        self.table: list[list[tuple[int, int] | None]] = []
        self._moves: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.last, self.end_cost = self._state(self._closed([0 if q in FINAL else _FAR for q in range(4)]))

    def _closed(self, v: list[int]) -> list[int]:
        """With turns inserted wherever that is cheaper."""
        for _ in v:
            v = [min(c, self.costs.insert + v[ARCS[q, INSERTED[q]]]) for q, c in enumerate(v)]
        return v

    def _state(self, v: list[int]) -> tuple[int, int]:
        least = min(v)
        key = tuple(c - least for c in v)
        if key not in self._numbers:
            self._numbers[key] = len(self.vectors)
            self.vectors.append(key)
            self.table.append([None] * 16)
        return self._numbers[key], least

    def _edits(self, kind: int, q: int) -> Iterator[tuple[str, int, int]]:
        """Edits of a turn in ASCII order, but for inserted ones: initial, cost, next pattern state."""
        fault = kind >> 2
        yield "D", self.costs.delete, q
        if fault in (OK, TRUNCATED):
            more = self.costs.truncated if fault == TRUNCATED else 0
            if kind & 3 < 3 and (q, _INITIALS[kind & 3]) in ARCS:
                yield "K", more, ARCS[q, _INITIALS[kind & 3]]
            yield "R", more + self.costs.rerole, ARCS[q, INSERTED[q]]

    def _step(self, state: int, kind: int) -> tuple[int, int]:
        after = self.vectors[state]
        found = self._state(self._closed([min(c + after[t] for _, c, t in self._edits(kind, q)) for q in range(4)]))
        self.table[state][kind] = found
        return found

    def scan(self, kinds: bytes | bytearray) -> tuple[int, array]:
        """The least cost, and the states from the end of the conversation to its start."""
        state, total, table = self.last, self.end_cost, self.table
        trail = array("L", [state])
        for kind in reversed(kinds):
            state, cost = table[state][kind] or self._step(state, kind)
            total += cost
            trail.append(state)
        return total + self.vectors[state][0], trail

    def _tight(self, after: int, kind: int, q: int) -> tuple[str, int]:
        """The edits from pattern state q on up to that of one turn, and the pattern state behind it."""
        if (after, kind, q) not in self._moves:
            state, cost = self.table[after][kind]
            here, there, letters, at = self.vectors[state], self.vectors[after], "", q
            while True:
                tight = {e: t for e, c, t in self._edits(kind, at) if c + there[t] == here[at] + cost}
                following = ARCS[at, INSERTED[at]]
                if "D" not in tight and self.costs.insert + here[following] == here[at]:
                    letters, at = letters + "I", following
                    continue
                letter = min(tight)
                self._moves[after, kind, q] = letters + letter, tight[letter]
                break
        return self._moves[after, kind, q]

    def trace(self, kinds: bytes | bytearray, trail: array) -> str:
        """The least of the cheapest audits."""
        out, q, n = [], 0, len(kinds)
        for i, kind in enumerate(kinds):
            letters, q = self._tight(trail[n - i - 1], kind, q)
            out.append(letters)
        while q not in FINAL:
            out.append("I")
            q = ARCS[q, INSERTED[q]]
        return "".join(out)


def repaired_turns(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn that an audit leaves; reads turns (role, text) as it goes."""
    q = 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(turns)
        if letter == "D":
            continue
        initial = role[0] if letter == "K" else INSERTED[q]
        q = ARCS[q, initial]
        yield letter, role if letter == "K" else ROLES[initial], text


# ---- on Spark


def damaged(conversations: DataFrame) -> DataFrame:
    """Each row damaged by the CRC of its conversation and turn: conv_id, turn, role, text, gone (dropped rows stay, marked, so that no conversation is lost)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat_ws(":", said("conv_id"), said("turn"))) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    rows = conversations.select("conv_id", "turn", F.when(how == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (how == 0).alias("gone"), F.when(how == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "time")


def _marked(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, kind (without duplicates within a turn) and twin, for turns that may have an equal one of the same number; stored, as it is read twice."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), gone.alias("gone"))
    number = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    same = ("conv_id", "role", "digest")
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("number", number)
    again = rows.filter("not gone").groupBy(*same).agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    again = written(again.select(*[F.col(c).alias(f"again_{c}") for c in same], "first"), "again")
    on = [F.col(c).eqNullSafe(F.col(f"again_{c}")) for c in same]
    rows = rows.join(again, on[0] & on[1] & on[2], "left")
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    later = F.coalesce(F.col("number") != F.col("first"), F.lit(False))
    fault = F.when(trimmed == "", BLANK).when(later, DUPLICATE).when(F.substring(trimmed, -1, 1).isin(*ENDS), OK).otherwise(TRUNCATED)
    role = F.substring("role", 1, 1)
    which = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3)
    twin = F.col("first").isNotNull() & ~later
    return written(rows.select("conv_id", "turn", "role", "text", "gone", (fault * 4 + which).alias("kind"), twin.alias("twin")), "turns")


def _flat(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """(conv_id, its rows) of sorted rows; each must be used up before the next."""
    ahead = next(rows, None)
    while ahead is not None:
        conv = ahead[0]

        def own():
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                yield ahead
                ahead = next(rows, None)

        turns = own()
        yield conv, turns
        for _ in turns:
            pass


PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PLAN_KINDS = (*[pa.int64()] * 7, pa.string())


def _batch(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in schema.split(", ")])


def _plan(marked: DataFrame, costs: Costs) -> DataFrame:
    """A row for each conversation: what is wrong, the least cost, and the audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, out = Machine(costs), []
        for conv, turns in _conversations(_flat(batches, ("conv_id", "turn", "role", "text", "gone", "kind", "twin"))):
            kinds, before = bytearray(), None
            low = high = None
            distinct = illegal = 0
            for _, turn, role, text, gone, kind, twin in turns:
                if gone:
                    continue
                if twin and kind >> 2 != BLANK:
                    if before == (turn, role, text):
                        kind = kind & 3 | DUPLICATE << 2
                    before = (turn, role, text)
                if turn is not None:
                    distinct += turn != high
                    low, high = turn if low is None else low, turn
                if kinds:
                    pair = kinds[-1] & 3, kind & 3
                    illegal += 3 in pair or _INITIALS[pair[0]] + _INITIALS[pair[1]] not in LEGAL
                kinds.append(kind)
            cost, trail = machine.scan(kinds)
            faults = [sum(kinds.count(f << 2 | r) for r in range(4)) for f in (BLANK, DUPLICATE, TRUNCATED)]
            out.append((conv, 0 if low is None else high - low + 1 - distinct, *faults, illegal, cost, machine.trace(kinds, trail)))
            if len(out) >= 1024:
                yield _batch(out, _PLAN_KINDS, PLAN)
                out = []
        if out:
            yield _batch(out, _PLAN_KINDS, PLAN)

    dealt = marked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, PLAN)


def _followed(plan: DataFrame, marked: DataFrame) -> DataFrame:
    """Each conversation's plan, followed by its turns in order."""
    names = [c.split()[0] for c in PLAN.split(", ")]
    none = lambda kind: F.lit(None).cast(kind)
    heads = plan.select(*names, F.lit(0).alias("at"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"))
    rows = marked.filter("not gone").select("conv_id", *[none(c.split()[1]).alias(c.split()[0]) for c in PLAN.split(", ")[1:]], F.lit(1).alias("at"), "turn", "role", "text")
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "at", "turn", "role", "text")


_FOLLOWED = (*[c.split()[0] for c in PLAN.split(", ")], "role", "text")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str, str]]]]:
    """(plan, its repaired turns) for each conversation."""
    for _, rows in _conversations(_flat(batches, _FOLLOWED)):
        plan = next(rows)[:8]
        yield plan, repaired_turns(plan[7], (r[8:] for r in rows))


def repaired(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The repaired conversations, a row for each turn: conv_id, place (from 0), edit (K, R or I), role, text."""
    marked = _marked(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, kinds = "conv_id, place, edit, role, text", (pa.int64(), pa.int64(), *[pa.string()] * 3)
        for plan, edited in _edited(batches):
            out = []
            for k, (edit, role, text) in enumerate(edited):
                out.append((plan[0], k, edit, role, text))
                if len(out) >= 256:
                    yield _batch(out, kinds, schema)
                    out = []
            if out:
                yield _batch(out, kinds, schema)

    return _followed(_plan(marked, costs), marked).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def report(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """What is wrong with each conversation, the cheapest edits, and the SHA-256 of the repaired turns (`role:text`, joined by line feeds)."""
    marked = _marked(turns)
    schema, kinds = PLAN + ", repaired_sha256 string", (*_PLAN_KINDS, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for plan, edited in _edited(batches):
            digest, between = hashlib.sha256(), ""
            for _, role, text in edited:
                digest.update(f"{between}{role}:{text}".encode())
                between = "\n"
            out.append((*plan, digest.hexdigest()))
            if len(out) >= 1024:
                yield _batch(out, kinds, schema)
                out = []
        if out:
            yield _batch(out, kinds, schema)

    return _followed(_plan(marked, costs), marked).mapInArrow(run, schema)
