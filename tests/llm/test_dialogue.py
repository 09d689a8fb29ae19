"""Repairs against a search over all edits, and rows that are odd."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from graphloom.llm import dialogue

TURNS = "conv_id long, turn long, role string, text string, audit int"
EMPTY = hashlib.sha256().hexdigest()


def plain(rows):
    """Uniform-cost search over (place, roles so far); the first goal by (cost, letters) is the answer."""
    after = []
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after += [(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    turns, seen, faults = [t for t, _, _ in after if t is not None], set(), []
    for _, role, text in after:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
    queue, done = [(0, "", 0, "", "")], set()
    while True:
        cost, letters, at, roles, out = heapq.heappop(queue)
        if at == len(after) and re.fullmatch("(s?(ua)+)?", roles):
            break
        if (at, roles) in done or not re.fullmatch("s?(ua)*u?", roles) or len(roles) > 2 * len(after) + 2:
            continue
        done.add((at, roles))
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 3, letters + "I", at, roles + role[0], f"{out}{role}:\n"))
        if at < len(after):
            _, own, text = after[at]
            heapq.heappush(queue, (cost + 4, letters + "D", at + 1, roles, out))
            if faults[at] not in ("blank", "duplicate"):
                more = 3 * (faults[at] == "truncated")
                heapq.heappush(queue, (cost + more, letters + "K", at + 1, roles + own[:1] if own[:1] else "x", f"{out}{own}:{text}\n"))
                for role in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 3 + more, letters + "R", at + 1, roles + role[0], f"{out}{role}:{text}\n"))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256(out[:-1].encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversations(seed, n, longest=7):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        turn = rnd.randint(0, 3)
        for _ in range(rnd.randint(1, longest)):
            rows.append((c, turn, rnd.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), rnd.choice(["Yes.", "No!", "why", " \t", "", None, "a. b?\n", "1", "2?", "3.", "4"]), 0))
            turn += rnd.choice([1, 1, 1, 2])
    return rows


def test_repair_equals_a_search(spark):
    rows = conversations(5, 150)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in dialogue.repaired_damage(spark.createDataFrame(rows, TURNS)).collect()}
    want = {c: plain([r[:4] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want
    assert sum("R" in x[6] for x in want.values()) > 5 and sum("I" in x[6] for x in want.values()) > 5


def test_odd_turns(spark):
    long = "word " * 40_000 + "."
    rows = [(None, None, "user", "a.", 1), (None, 3, "assistant", "b.", 1), (7, None, None, None, 1), (7, 1, "user", long, 1), (7, 1, "user", long, 1), (8, 2, "Ärzte", "é", 1)]
    rows += [(9, 0, "user", "x.", 1)] * 3
    df = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in dialogue.repaired_damage(df).collect()}
    assert got == {c: plain([r[:4] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert dialogue.repaired_damage(df.limit(0)).count() == 0 and dialogue.repair(df.limit(0)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    only = dialogue.repaired_damage(spark.createDataFrame([(gone, 0, "user", "x.", 1)], TURNS)).collect()
    assert [tuple(r[c] for c in ("conv_id", *COLUMNS)) for r in only] == [(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)]


def test_turns_after_repair(spark):
    rows = [(1, 0, "system", "Be brief.", 0), (1, 1, "user", "Hi.", 0), (1, 2, "user", "Hi.", 0), (1, 5, "assistant", "Yes.", 0), (1, 6, "user", "Why?", 0)]
    got = dialogue.repair(spark.createDataFrame(rows, TURNS)).orderBy("at").collect()
    assert [(r.edit, r.role, r.text) for r in got] == [("K", "system", "Be brief."), ("K", "user", "Hi."), ("K", "assistant", "Yes."), ("K", "user", "Why?"), ("I", "assistant", "")]
    said = dialogue.audits(spark.createDataFrame(rows, TURNS)).first()
    assert (said.gaps, said.duplicate, said.illegal, said.cost, said.audit) == (2, 1, 1, 7, "KKDKKI")


def test_a_long_conversation(spark):
    """Costs against dynamic programming over all grammar states, and few states of the automaton."""
    rnd = random.Random(2)
    kinds = bytes(rnd.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(50_000))
    table = dialogue.Determinised()
    cost, audit = table.audit(kinds)
    assert audit.count("K") + audit.count("R") + audit.count("D") == len(kinds) and len(table.vectors) < 100
    costs = [0, 10**9, 10**9, 10**9]

    def inserts(v):
        for _ in range(4):
            for q, to in ((0, 2), (1, 2), (2, 3), (3, 2)):
                v[to] = min(v[to], v[q] + 3)
        return v

    for k in kinds:
        costs = inserts(costs)
        new = [c + 4 for c in costs]
        if k != 8:
            more, own = 3 * (k >= 4), "?sua"[k % 4]
            for q, (role, to) in ((q, x) for q in range(4) for x in ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})[q].items()):
                if role == own:
                    new[to] = min(new[to], costs[q] + more)
                if role != "s":
                    new[to] = min(new[to], costs[q] + 3 + more)
        costs = new
    costs = inserts(costs)
    assert cost == min(costs[0], costs[3])


@pytest.mark.parametrize("kinds", [b"", b"\x08\x08"])
def test_nothing_to_keep(kinds):
    assert dialogue.Determinised().audit(kinds) == (4 * len(kinds), "D" * len(kinds))
