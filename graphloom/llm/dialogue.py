"""Repair of the turns of conversations by the cheapest edits, with an automaton that is determinised as it is met.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. What the rest of a
conversation costs from each state of that grammar is a vector; less its least entry it is a state
of a deterministic automaton whose arcs are kinds of turns, and which keeps the least entry as the
arc's weight. States and arcs are made when first met and kept in a table, so that a turn costs one
look-up. The table is run from the last turn to the first; a trace back from the first turn then
follows tight arcs, of these the least letter, which gives the least of the cheapest audits.

Spark deals turns by conversation and sorts them; a task streams them and keeps a few bytes a turn.
A first pass, without texts, gives the audits. In a second each audit meets its turns. Repeats are
found by a window over (conversation, role, digest of the text), so no task holds a conversation's texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, ship
from .textops import slices

#: Prices of the edits, and of keeping a turn that is cut short.
RENAME, DELETE, INSERT, CUT = 3, 4, 3, 3
#: States of the grammar: nothing yet, a system turn, a user turn, an assistant turn; where each may end; what comes after it by s, u, a.
STATES, ENDS = 4, (0, 3)
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
SPACE = " \t\n\v\f\r"
#: Beyond any cost that the normalised vectors hold.
FAR = 1 << 40
#: Kinds of turns: the place of the initial in LETTERS, SHORT more where it is cut short; GONE where it must go.
LETTERS, SHORT, GONE = "?sua", 4, 8


class Determinised:
    """States are normalised cost vectors; ``arcs`` has (state, kind) -> (state before the turn, weight), ``moves`` the tight arcs."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.arcs: dict[tuple[int, int], tuple[int, int]] = {}
        self.moves: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end, self.rest = self._state(self._inserted([0 if q in ENDS else FAR for q in range(STATES)]))

    def _inserted(self, costs: list[int]) -> list[int]:
        for _ in range(STATES):
            costs = [min([c, *(INSERT + costs[to] for x, to in NEXT[q].items() if x != "s")]) for q, c in enumerate(costs)]
        return costs

    def _state(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least

    @staticmethod
    def _edits(kind: int, q: int) -> Iterator[tuple[str, int, int]]:
        """(letter, cost, state) of the edits that take a turn."""
        yield "D", DELETE, q
        if kind != GONE:
            extra = CUT if kind >= SHORT else 0
            own = LETTERS[kind % SHORT]
            if own in NEXT[q]:
                yield "K", extra, NEXT[q][own]
            for x, to in NEXT[q].items():
                if x != "s":
                    yield "R", RENAME + extra, to

    def before(self, state: int, kind: int) -> tuple[int, int]:
        """The state ahead of a turn, from the one behind it, and the weight of the arc."""
        if (state, kind) not in self.arcs:
            after = self.vectors[state]
            costs = [min(c + after[to] for _, c, to in self._edits(kind, q)) for q in range(STATES)]
            self.arcs[state, kind] = self._state(self._inserted(costs))
        return self.arcs[state, kind]

    def move(self, state: int, kind: int, q: int) -> tuple[str, int]:
        """The letters up to the edit of a turn, from grammar state ``q`` ahead of it, and the grammar state behind it."""
        key = (state, kind, q)
        if key not in self.moves:
            ahead, weight = self.before(state, kind)
            costs, after, letters = self.vectors[ahead], self.vectors[state], ""
            while not letters or letters[-1] == "I":
                tight = [(x, to) for x, c, to in self._edits(kind, q) if c + after[to] == costs[q] + weight]
                tight += [("I", to) for x, to in NEXT[q].items() if x != "s" and INSERT + costs[to] == costs[q]]
                letter, q = min(tight)
                letters += letter
            self.moves[key] = letters, q
        return self.moves[key]

    def audit(self, kinds: bytes) -> tuple[int, str]:
        """The least cost of a conversation and the least of its cheapest audits."""
        state, cost, behind = self.end, self.rest, array("H", bytes(2 * len(kinds)))
        for k in range(len(kinds) - 1, -1, -1):
            behind[k] = state
            state, weight = self.before(state, kinds[k])
            cost += weight
        cost, q, letters = cost + self.vectors[state][0], 0, []
        for k, kind in enumerate(kinds):
            found, q = self.move(behind[k], kind, q)
            letters.append(found)
        last, state = [], q
        while state not in ENDS:
            state = next(to for x, to in NEXT[state].items() if x != "s")
            last.append("I")
        return cost, "".join([*letters, *last])


def _named(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults by the CRC-32 of ``conv_id:turn``, modulo 20; null roles and texts become a space."""
    kind = F.crc32(F.concat(_named("conv_id"), F.lit(":"), _named("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_named("text"), "[.!?]", "")).otherwise(_named("text"))
    rows = turns.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(_named("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def _rows(turns: DataFrame) -> DataFrame:
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), _named("role").alias("role"), _named("text").alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, nth, fault) of ``turns``; nth: how often the conversation has had role and text, this turn included.

    fault is 'blank', 'duplicate' or 'truncated', the first that holds, else null.
    """
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    rows = _rows(turns).withColumn("last", last).drop("text").withColumn("nth", F.row_number().over(seen))
    fault = F.when(F.col("last") == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", "role", "digest", "nth", fault.alias("fault"))


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its turns (conv_id, turn, initial, fault) in order."""
    table, names = Determinised(), ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def closed() -> list:
        cost, audit = table.audit(bytes(kinds))
        gaps = turn - first + 1 - distinct if distinct else 0
        return [key, gaps, *(tally.get(x, 0) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit]

    key, begun, kind = None, False, None
    for b in slices(batches):
        out, kind = [], b.column("conv_id").type
        for k, t, x, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault")), strict=True):
            if not begun or k != key:
                if begun:
                    out.append(closed())
                key, begun, kinds, tally, illegal, first, turn, distinct, last = k, True, bytearray(), {}, 0, None, None, 0, None
            if t is not None and t != turn:
                first, turn, distinct = t if first is None else first, t, distinct + 1
            illegal += last is not None and last + x not in ("su", "ua", "au")
            last = x
            tally[fault] = tally.get(fault, 0) + 1
            kinds.append(GONE if fault in ("blank", "duplicate") else max(0, "?sua".find(x or "?")) + SHORT * (fault == "truncated"))
        yield _batch(out, names, kind)
    if begun:
        yield _batch([closed()], names, kind)


def _batch(rows: list[list], names: list[str], key: pa.DataType) -> pa.RecordBatch:
    texts = {"audit", "edit", "role", "text", "repaired_sha256"}
    kinds = [key if c == "conv_id" else pa.string() if c in texts else pa.int64() for c in names]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


SUMMARY = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string"}


def audits(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of ``turns``."""
    ship(turns.sparkSession)
    rows = faults(turns).select("conv_id", "turn", "role", "digest", "nth", F.substring("role", 1, 1).alias("initial"), "fault")
    rows = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "nth").select("conv_id", "turn", "initial", "fault")
    key = turns.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(_audited, ", ".join([f"conv_id {key}", *(f"{c} {t}" for c, t in SUMMARY.items())]))


def _repaired(digests: bool):
    """Turns after repair, or one digest a conversation, from each audit followed by its turns in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *SUMMARY, "repaired_sha256"] if digests else ["conv_id", "at", "edit", "role", "text"]
        out, audit, at, q, place, sha, key, kind = [], "", 0, 0, 0, None, None, None

        def give(letter: str, role: str, text: str) -> None:
            nonlocal place, q
            q = NEXT[q][role[0]]
            if digests:
                sha.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())
            else:
                out.append([key, place, letter, role, text])
            place += 1

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                give("I", "user" if "u" in NEXT[q] else "assistant", "")

        def closed() -> None:
            inserted()
            if digests:
                out.append([key, *summary, sha.hexdigest()])

        for b in slices(batches):
            kind = b.column("conv_id").type
            for k, own, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "summary", "role", "text")), strict=True):
                if own is not None:
                    if sha is not None:
                        closed()
                    key, summary, audit, at, q, place, sha = k, [own[c] for c in SUMMARY], own["audit"], 0, 0, 0, hashlib.sha256()
                    continue
                inserted()
                letter = audit[at]
                at += 1
                if letter != "D":
                    give(letter, role if letter == "K" else "user" if "u" in NEXT[q] else "assistant", text)
            yield _batch(out, names, kind)
            out = []
        if sha is not None:
            closed()
            yield _batch(out, names, kind)

    return run


def repair(turns: DataFrame, digests: bool = False) -> DataFrame:
    """Repair the conversations of ``turns`` (conv_id, turn, role, text; others are not read) by the cheapest edits.

    Gives the turns after repair: conv_id, at (from 0), edit (K kept, R role changed, I inserted), role, text;
    or with ``digests`` one row a conversation: its faults, the cost and letters of its edits, and the SHA-256
    of its repaired ``role:text`` lines. Turns are taken by number, nulls first; those of one number by role and
    digest of the text. Null roles and texts count as one space, a null conv_id is a conversation of its own, and
    repeated rows are duplicates to delete. An empty table gives an empty result. A digest, like an audit, is one
    value of a whole conversation, so each is made in one task, which streams the turns.
    """
    spark = turns.sparkSession
    ship(spark)
    found = cut(audits(turns), "audits")[0]
    key = turns.schema["conv_id"].dataType.simpleString()
    summary = F.struct(*SUMMARY)
    lead = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"), summary.alias("summary"))
    rows = _rows(turns).select("conv_id", "turn", "role", "text", "digest", F.lit(None).cast(lead.schema["summary"].dataType).alias("summary"))
    every = lead.union(rows).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.col("summary").isNull(), F.asc_nulls_first("turn"), "role", "digest")
    kinds = ", ".join([*(f"{c} {t}" for c, t in SUMMARY.items()), "repaired_sha256 string"]) if digests else "at long, edit string, role string, text string"
    return every.select("conv_id", "summary", "role", "text").mapInArrow(_repaired(digests), f"conv_id {key}, {kinds}")


def repaired_damage(turns: DataFrame) -> DataFrame:
    """``repair`` with digests after ``damaged``, with a row for every conv_id of ``turns``: zeros, and digests of nothing, where no turn is left."""
    found = repair(damaged(turns), digests=True).withColumnRenamed("conv_id", "of")
    every = turns.select("conv_id").distinct()
    rows = every.join(found, every["conv_id"].eqNullSafe(found["of"]), "left").drop("of")
    return rows.na.fill(0, [c for c, t in SUMMARY.items() if t == "long"]).na.fill({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
