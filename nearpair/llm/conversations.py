"""Conversations repaired at the least cost, streamed in the order of their turns.

The rows are dealt by conversation and sorted by turn; a task reads them batch by batch and keeps,
whatever a conversation's length: the cost of each state of the repaired text so far, which state's
edits come first in ASCII order, and a running SHA-256 per state. What each row decided is a
backpointer of two bytes; more than SPILL of them go to a file of the task, and the audit is read
back from its end.

States: nothing kept yet, only a system row, last row a user's, last row an assistant's. Costs are
kept relative to the cheapest, so few combinations of costs and order exist; each is met once, then
looked up.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearpair.llm.tables import column

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3  # costs of the edits
TRUNCATED = 3  # and of a truncated row that is not deleted
SPILL = 1 << 20  # backpointers of a conversation held in memory
READ = 1 << 16  # backpointers read back at once

NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = {NONE: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}  # rows to insert until the roles are legal
FINE, BLANK, DUPLICATE, CUT = range(4)  # a row's fault; blank and duplicate rows are deleted
WHITE = " \t\n\x0b\x0c\r"


# -- the edits of one row ------------------------------------------------------------------


def _roles_to(state: int, target: int) -> int | None:
    """How many empty rows inserted after `state` lead to `target` (user, assistant, user, ...)."""
    if state == target:
        return 0
    if target not in (USER, ASSISTANT):
        return None
    return 1 if (target == USER or state == USER) else 2


def _after(state: int, role: str) -> int | None:
    """The state when a row of this role's initial follows, if it may."""
    if role == "s":
        return SYSTEM if state == NONE else None
    if role == "u":
        return None if state == USER else USER
    return ASSISTANT if role == "a" and state == USER else None


class Edit(NamedTuple):
    inserts: int  # empty rows before
    kind: str  # K, R or D
    cost: int
    before: int  # state, inserts not yet done
    after: int

    @property
    def audit(self) -> str:
        return "I" * self.inserts + self.kind


def row_edits(role: str, fault: int) -> list[Edit]:
    """All edits of a row by which a cheapest repair may pass."""
    found = []
    for before in range(4):
        for mid in range(4):
            inserts = _roles_to(before, mid)
            if inserts is None:
                continue
            cost = inserts * INSERT
            found.append(Edit(inserts, "D", cost + DELETE, before, mid))
            if fault in (BLANK, DUPLICATE):
                continue
            cost += TRUNCATED if fault == CUT else 0
            kept = _after(mid, role)
            if kept is not None:
                found.append(Edit(inserts, "K", cost + KEEP, before, kept))
            found.append(Edit(inserts, "R", cost + REROLE, before, ASSISTANT if mid == USER else USER))
    return found


class Step(NamedTuple):
    to: int  # number of the next combination
    cost: int  # by which the cheapest state's cost grew
    edits: tuple[Edit | None, ...]  # per state, how it was reached


class Machine:
    """Combinations of states' relative costs and ASCII order, numbered as they are met.

    A state's edits so far end with a row's edit, and no such text is the beginning of another of
    the same rows. So two states' edits differ at some place, and their order never changes by what
    follows: an order of the states is all that must be known of the audits.
    """

    def __init__(self) -> None:
        start = ((0, 0), None, None, None)  # (cost, place in ASCII order) per state
        self.combinations = [start]
        self.numbers = {start: 0}
        self.steps: list[dict[str, int]] = [{}]  # combination -> role and fault -> step
        self.table: list[Step] = []

    def step(self, number: int, what: str) -> int:
        """The step's number; `what` is the fault's digit and the role's initial."""
        found = self.steps[number].get(what)
        if found is None:
            found = self.steps[number][what] = len(self.table)
            self.table.append(self._step(self.combinations[number], what[1:], int(what[0])))
        return found

    def _step(self, now: tuple, role: str, fault: int) -> Step:
        best: list[tuple | None] = [None] * 4
        for edit in row_edits(role, fault):
            if now[edit.before] is None:
                continue
            cost, place = now[edit.before]
            key = (cost + edit.cost, place, edit.audit)
            if best[edit.after] is None or key < best[edit.after][:3]:
                best[edit.after] = (*key, edit)
        low = min(b[0] for b in best if b)
        # with four edits more, whatever follows another state can follow the assistant's
        end = best[ASSISTANT]
        best = [None if b is None or (end and b[0] > end[0] + 2 * DELETE) else b for b in best]
        order = sorted((b[1], b[2], s) for s, b in enumerate(best) if b)
        places = {s: i for i, (_, _, s) in enumerate(order)}
        then = tuple(None if b is None else (b[0] - low, places[s]) for s, b in enumerate(best))
        if then not in self.numbers:
            self.numbers[then] = len(self.combinations)
            self.combinations.append(then)
            self.steps.append({})
        return Step(self.numbers[then], low, tuple(None if b is None else b[3] for b in best))

    def end(self, number: int) -> tuple[int, int]:
        """The cost from here and the state of the cheapest end, ties by the audit."""
        now = self.combinations[number]
        ends = [(c[0] + ENDS[s] * INSERT, c[1], s) for s, c in enumerate(now) if c]
        cost, _, state = min(ends)
        return cost, state


# -- a conversation ------------------------------------------------------------------------


class Pointers:
    """The steps taken, two bytes each, written to a file of the task where they are many."""

    def __init__(self, spill: int = SPILL) -> None:
        self.held, self.spill, self.file = array("H"), spill, None

    def append(self, step: int) -> None:
        self.held.append(step)
        if len(self.held) >= self.spill:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.held.tofile(self.file)
            del self.held[:]

    def backward(self) -> Iterator[int]:
        yield from reversed(self.held)
        if self.file is not None:
            end = self.file.seek(0, 2)
            while end:
                low = max(0, end - 2 * READ)
                self.file.seek(low)
                part = array("H")
                part.frombytes(self.file.read(end - low))
                yield from reversed(part)
                end = low
            self.file.close()


def _piece(started: bool, role: str, text: str) -> bytes:
    return (("\n" if started else "") + role + ":" + text).encode("utf-8", "surrogatepass")


class Conversation:
    """Takes the rows in order; `result` closes it."""

    def __init__(self, machine: Machine, spill: int = SPILL) -> None:
        self.machine, self.pointers = machine, Pointers(spill)
        self.number = self.cost = 0
        self.hashes: list = [hashlib.sha256(), None, None, None]
        self.faults = [0] * 4
        self.illegal = self.turns = 0
        self.role = self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        self.faults[fault] += 1
        if self.role is not None and self.role + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = role[:1]
        at = self.machine.step(self.number, f"{fault}{role[:1]}" if role[:1] in ("s", "u", "a") else f"{fault}")
        step = self.machine.table[at]
        self.pointers.append(at)
        self.number, self.cost = step.to, self.cost + step.cost
        then: list = [None] * 4
        for state, edit in enumerate(step.edits):
            if edit is not None:
                then[state] = self._written(edit, role, text)
        self.hashes = then

    def _written(self, edit: Edit, role: str, text: str):
        digest = self.hashes[edit.before]
        if edit.kind == "D" and not edit.inserts:
            return digest  # never changed in place
        state, parts = edit.before, []
        for _ in range(edit.inserts):
            name, after = ("assistant", ASSISTANT) if state == USER else ("user", USER)
            parts.append(_piece(state != NONE, name, ""))
            state = after
        if edit.kind != "D":
            name = role if edit.kind == "K" else "assistant" if state == USER else "user"
            parts.append(_piece(state != NONE, name, text))
        digest = digest.copy()
        digest.update(b"".join(parts))
        return digest

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"""
        more, state = self.machine.end(self.number)
        digest = self._written(Edit(ENDS[state], "D", 0, state, ASSISTANT if ENDS[state] else state), "", "")
        audit = ["I" * ENDS[state]]
        for at in self.pointers.backward():
            edit = self.machine.table[at].edits[state]
            audit.append(edit.audit)
            state = edit.before
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        faults = self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT]
        return gaps, *faults, self.illegal, self.cost + more, "".join(reversed(audit)), digest.hexdigest()


# -- tables --------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """`conv_id, turn, role, text, gone` with the rows' planned damage; null roles and texts are a
    space. By crc32 of `conv_id:turn` (null: a space) modulo 20: 0 drops the row (it stays, marked
    `gone`, so that its conversation is known), 1 empties its text, 2 takes out `.!?`, 3 repeats it,
    4 makes its role user."""
    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = rows.select(column("conv_id").cast("bigint").alias("conv_id"), column("turn").cast("bigint").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    rows = rows.withColumn("kind", kind)
    rows = rows.select("*", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    text = F.when(F.col("kind") <= 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"))


_RESULT = (
    "known boolean, conv bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)


def _repairs(spill: int, held: int = 4 << 20):
    names = [x.split()[0] for x in _RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, key, now = Machine(), None, None
        out: list[tuple] = []
        size = 0
        for batch in batches:
            columns = (batch[c].tolist() for c in ("known", "conv", "timed", "at", "role", "text", "fault", "gone"))
            for known, conv, timed, at, role, text, fault, gone in zip(*columns):
                if (known, conv) != key:
                    if now is not None:
                        out.append((*key, *now.result()))
                        size += 200 + len(out[-1][8])
                        if size >= held:
                            yield pd.DataFrame(out, columns=names)
                            out, size = [], 0
                    key, now = (known, conv), Conversation(machine, spill)
                if not gone:
                    now.add(at if timed else None, role, text, fault)
        if now is not None:
            out.append((*key, *now.result()))
        if out:
            yield pd.DataFrame(out, columns=names)

    return run


def repaired(rows: DataFrame, spill: int = SPILL) -> DataFrame:
    """`conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256` for each
    conversation of `conv_id, turn, role, text, gone` rows; rows marked gone only name it.

    A conversation's rows are taken by turn, nulls first, rows of one turn by role and text. A row's
    fault is the first of: blank, duplicate (role and text as in an earlier row), truncated (its
    last character other than white space is none of `.!?`). Roles count by their first character;
    one without (or with another than s, u, a) has no place and is reroled or deleted. Kept rows
    keep their whole role. A null conv_id is a conversation of its own. No rows, no conversation; all
    gone: zeros, an empty audit and the hash of nothing.

    One shuffle, by conversation; duplicates are found and rows are put in order by two sorts inside
    its partitions, which spill. A conversation is one task's work, as long as it may be.
    """
    white = F.lit(WHITE)
    rows = rows.select(
        F.col("conv_id").isNotNull().alias("known"), F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("turn").isNotNull().alias("timed"),
        F.coalesce("turn", F.lit(0)).alias("at"), "role", "text", "gone", F.length(F.rtrim("text", white)).alias("ends"),
    )
    rows = rows.repartition("known", "conv")
    same = Window.partitionBy("known", "conv", "gone", "role", "text").orderBy("timed", "at")
    rows = rows.withColumn("seen", F.row_number().over(same) > 1)
    cut = ~F.contains(F.lit(".!?"), F.substring(F.col("text"), F.col("ends"), F.lit(1)))
    fault = F.when(F.col("ends") == 0, BLANK).when(F.col("seen"), DUPLICATE).when(cut, CUT).otherwise(FINE)
    rows = rows.withColumn("fault", fault).sortWithinPartitions("known", "conv", "timed", "at", "role", "text")
    found = rows.select("known", "conv", "timed", "at", "role", "text", "fault", "gone").mapInPandas(_repairs(spill), _RESULT)
    return found.select(F.when(F.col("known"), F.col("conv")).alias("conv_id"), *found.columns[2:])
