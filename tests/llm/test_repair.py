import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from veritree.llm import queries, repair

SEEN = re.compile(r"[^\x20\x09-\x0D]")
GOAL = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, kind int, `gone` boolean"


def cheapest(rows):
    """(cost, audit, repaired) by a search over all edits, cheapest first, then ASCII-least; rows: (role, text, fault)."""
    best = [(0, "", 0, "", ())]
    seen = set()
    while True:
        cost, audit, k, goal, out = heapq.heappop(best)
        state = (k, goal[:1] == "s", goal[-1:])
        if k == len(rows) and GOAL.fullmatch(goal):
            return cost, audit, out
        if state in seen:
            continue
        seen.add(state)
        for x, name in (("u", "user"), ("a", "assistant")):
            if GOAL.fullmatch(goal + x) or GOAL.fullmatch(goal + x + "a"):
                heapq.heappush(best, (cost + 3, audit + "I", k, goal + x, (*out, (name, ""))))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(best, (cost + 4, audit + "D", k + 1, goal, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for name, letter, c in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                    after = goal + name[:1]
                    if name and (re.fullmatch(r"s?(ua)*u?", after)):
                        heapq.heappush(best, (cost + c + more, audit + letter, k + 1, after, (*out, (name, text))))


def judged(rows):
    """The report of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, earlier = [], set()
    for _, role, text in rows:
        marks = SEEN.findall(text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in earlier else "truncated" if marks[-1] not in ".!?" else "")
        earlier.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, out = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def damaged(rows):
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        how = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if how == 0:
            yield conv, None
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        for _ in range(2 if how == 3 else 1):
            yield conv, (turn, "user" if how == 4 else role, text)


def reports(rows, damage=True):
    found = {}
    for conv, row in damaged(rows) if damage else ((c, (t, *(" " if x is None else x for x in said))) for c, t, *said in rows):
        found.setdefault(conv, []).extend([row] if row else [])
    return sorted(((c, *judged(r)) for c, r in found.items()), key=str)


def invented(seed, conversations=150):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(r.randrange(1, 8)):
            number = r.choice([turn, turn, turn, None, turn * 3, 2])
            rows.append((conv, number, r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher", "User"]), r.choice(["Yes.", "No!", "cut", " \n", "", None, "Why? \t", "é…", "Yes.", " "])))
    return rows


def test_the_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op11_repair(spark, sf)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == reports(rows)


@pytest.mark.parametrize("damage", [True, False])
def test_odd_conversations_equal_brute_force(spark, damage):
    rows = invented(11)
    df = spark.createDataFrame([(*r, 1, False) for r in rows], SCHEMA)
    df = repair.damaged(df) if damage else df
    got = sorted((tuple(r) for r in repair.report(df).collect()), key=str)
    assert got == reports(rows, damage)
    turns = {}
    for r in sorted(repair.repaired(df).collect(), key=lambda r: (str(r.conv_id), r.place)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in got:
        assert hashlib.sha256("\n".join(turns.get(r[0], [])).encode()).hexdigest() == r[-1]


def test_machine_equals_search_over_all_short_conversations():
    m = repair.Machine()
    faults = {repair.OK: "", repair.BLANK: "blank", repair.DUPLICATE: "duplicate", repair.TRUNCATED: "truncated"}
    kinds = [(r, f) for r in range(4) for f in (repair.OK, repair.BLANK, repair.TRUNCATED)]
    for n in range(4):
        for x in itertools.product(kinds, repeat=n):
            coded = bytes(f << 2 | r for r, f in x)
            cost, trail = m.scan(coded)
            want = cheapest([("suax"[r], "t", faults[f]) for r, f in x])
            assert (cost, m.trace(coded, trail)) == want[:2]
    assert len(m.vectors) < 100


def test_a_conversation_of_many_turns(spark):
    rows = [(7, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(20_000)] + [(7, 20_000, "assistant", "turn 3.")] * 500
    got = repair.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 1 and got[0].duplicate == 500 and got[0].cost == 2000 and got[0].audit == "K" * 20_000 + "D" * 500


def test_dropped_and_empty(spark):
    gone = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = repair.report(repair.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string"))).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.report(repair.damaged(empty)).count() == repair.repaired(empty).count() == 0
