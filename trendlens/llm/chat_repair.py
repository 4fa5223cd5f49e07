"""Operator 11: conversation structure repair.

A conversation is to have the roles ``(s?(ua)+)?`` (initials of system, user,
assistant).  A dynamic programme over that pattern's states finds the cheapest
edits: keep a row, give it another role, delete it, insert an empty one.

Rows are dealt by conversation and sorted by turn within partitions, last turn
first; ``mapInPandas`` carries the cost-to-go of every state from row to row
across Arrow batches.  A conversation whose texts fit ``buffer_chars`` is
finished on the spot.  A longer one is written out as it streams by, each row
with its backpointers (four bits a state); these rows go to a stored table and a
second stream, first turn first, follows them.  Memory is one buffer, one
Arrow batch and the edits of one conversation (a letter an edit).  One
conversation is one stream, because the digest of its text is sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendlens.llm.common import cut, prepare

SPACE = " \t\n\x0b\x0c\r"
BUFFER_CHARS = 8 << 20
OUT_ROWS = 2000
START, SYSTEM, USER, ASSISTANT = range(4)          # states: what was emitted last
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)               # what an inserted or re-roled row makes of a state
ROLE = {USER: "user", ASSISTANT: "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
END = ("", "II", "I", "")                          # what completes a state
AT_END = (0, 2 * INSERT, INSERT, 0)
UNITS = ("D", "K", "R", "ID", "IK", "IR", "IID", "IIK", "IIR")
SOUND, CUT_OFF, BLANK, DUPLICATE = range(4)        # a row's fault


@cache
def step(ahead: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int, int]:
    """Cost-to-go before a row given that after it: the costs less their least,
    the least, and the unit chosen in each state (ties: least in ASCII)."""
    gone = fault in (BLANK, DUPLICATE)
    cost, pointer = [], 0
    for state in range(4):
        options, at = [], state
        for n in range(3):
            paid = n * INSERT
            options.append((paid + DELETE + ahead[at], "I" * n + "D"))
            if not gone:
                paid += TRUNCATED * (fault == CUT_OFF)
                if (at, initial) in KEEP:
                    options.append((paid + ahead[KEEP[at, initial]], "I" * n + "K"))
                options.append((paid + REROLE + ahead[NEXT[at]], "I" * n + "R"))
            at = NEXT[at]
        least, unit = min(options)
        cost.append(least)
        pointer |= UNITS.index(unit) << (4 * state)
    low = min(cost)
    return tuple(c - low for c in cost), low, pointer


class _Trace:
    """Follows backpointers from the first row on."""

    def __init__(self):
        self.state, self.edits, self.sha, self.empty = START, bytearray(), hashlib.sha256(), True
        self.place = 0

    def _emit(self, role: str, text: str):
        self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False
        self.place += 1
        return self.place - 1, role, text

    def _insert(self, n: int) -> Iterator[tuple[int, str, str, str]]:
        for _ in range(n):
            self.state = NEXT[self.state]
            yield (*self._emit(ROLE[self.state], ""), "I")

    def row(self, pointer: int, role: str, text: str) -> Iterator[tuple[int, str, str, str]]:
        unit = UNITS[pointer >> (4 * self.state) & 15]
        self.edits += unit.encode()
        yield from self._insert(len(unit) - 1)
        if unit[-1] == "K":
            self.state = KEEP[self.state, role[:1]]
            yield (*self._emit(role, text), "K")
        elif unit[-1] == "R":
            self.state = NEXT[self.state]
            yield (*self._emit(ROLE[self.state], text), "R")

    def finish(self) -> Iterator[tuple[int, str, str, str]]:
        self.edits += END[self.state].encode()
        yield from self._insert(len(END[self.state]))


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_COLUMNS = ["conv", "no_conv", "kind", "place", "role", "text", "edit", "pointer", *FACTS, "audit", "sha256"]
_SCHEMA = ("conv string, no_conv boolean, kind int, place long, role string, text string, edit string, pointer int, "
           + ", ".join(f"{c} long" for c in FACTS) + ", audit string, sha256 string")
SUMMARY, MESSAGE, SPILLED = range(3)


def _wrap(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


class _Conversation:
    """One conversation, seen from its last row to its first."""

    def __init__(self, key: tuple[str, bool]):
        self.key = key
        self.ahead, self.cost = AT_END, 0
        self.faults = [0, 0, 0, 0]
        self.illegal, self.after = 0, None
        self.top, self.turn, self.distinct = None, None, 0
        self.rows: list[tuple[int, str, str, str]] = []
        self.chars, self.seen, self.spilled = 0, 0, False

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and (self.distinct == 0 or turn != self.turn):
            self.top = turn if self.distinct == 0 else self.top
            self.turn, self.distinct = turn, self.distinct + 1
        initial = role[:1]
        if self.after is not None and initial + self.after not in ("su", "ua", "au"):
            self.illegal += 1
        self.after = initial
        self.faults[fault] += 1
        self.ahead, low, pointer = step(self.ahead, initial, fault)
        self.cost += low
        self.seen += 1
        self.rows.append((-self.seen, role, text, pointer))
        self.chars += len(text) + len(role) + 64

    def spill(self) -> Iterator[tuple]:
        self.spilled = True
        for place, role, text, pointer in self.rows:
            yield (*self.key, SPILLED, place, role, text, None, pointer, *[None] * 8)
        self.rows, self.chars = [], 0

    def facts(self) -> tuple[int, ...]:
        gaps = _wrap(self.top - self.turn + 1 - self.distinct) if self.distinct else 0
        return (gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT_OFF], self.illegal,
                self.cost + self.ahead[START])

    def finish(self, messages: bool) -> Iterator[tuple]:
        if self.spilled:
            yield from self.spill()
            yield (*self.key, SPILLED, None, None, None, None, None, *self.facts(), None, None)
            return
        trace = _Trace()
        for _, role, text, pointer in reversed(self.rows):
            for place, r, t, e in trace.row(pointer, role, text):
                if messages:
                    yield (*self.key, MESSAGE, place, r, t, e, None, *[None] * 8)
        for place, r, t, e in trace.finish():
            if messages:
                yield (*self.key, MESSAGE, place, r, t, e, None, *[None] * 8)
        yield (*self.key, SUMMARY, None, None, None, None, None, *self.facts(), trace.edits.decode(), trace.sha.hexdigest())


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Frames of at most ``OUT_ROWS`` rows, or about a buffer of text."""
    def frame():
        out = pd.DataFrame(held, columns=_COLUMNS, dtype=object)
        return out.astype({c: "Int64" for c in ("place", *FACTS)} | {"kind": "Int32", "pointer": "Int32", "no_conv": bool})

    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += len(r[5] or "")
        if len(held) >= OUT_ROWS or chars >= BUFFER_CHARS:
            yield frame()
            held, chars = [], 0
    if held:
        yield frame()


def _backward(buffer_chars: int, messages: bool):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        now = None
        for f in frames:
            for conv, no_conv, turn, no_turn, role, text, fault, gone in zip(
                    f["conv"], f["no_conv"], f["turn"].tolist(), f["no_turn"], f["role"], f["text"], f["fault"], f["gone"]):
                if now is None or now.key != (conv, no_conv):
                    if now is not None:
                        yield from now.finish(messages)
                    now = _Conversation((conv, no_conv))
                if not gone:
                    now.add(None if no_turn else turn, role, text, fault)
                    if now.chars > buffer_chars:
                        yield from now.spill()
        if now is not None:
            yield from now.finish(messages)

    return lambda frames: _frames(rows(frames))


def _forward(messages: bool):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        now = trace = facts = None

        def close():
            for place, r, t, e in trace.finish():
                if messages:
                    yield (*now, MESSAGE, place, r, t, e, None, *[None] * 8)
            yield (*now, SUMMARY, None, None, None, None, None, *facts, trace.edits.decode(), trace.sha.hexdigest())

        for f in frames:
            sums = f["cost"].notna()
            for i, (conv, no_conv, is_sum, role, text, pointer) in enumerate(zip(
                    f["conv"], f["no_conv"], sums, f["role"], f["text"], f["pointer"])):
                if is_sum:                      # comes first of its conversation
                    if now is not None:
                        yield from close()
                    now, trace = (conv, no_conv), _Trace()
                    facts = tuple(int(f[c].iloc[i]) for c in FACTS)
                    continue
                for place, r, t, e in trace.row(int(pointer), role, text):
                    if messages:
                        yield (*now, MESSAGE, place, r, t, e, None, *[None] * 8)
        if now is not None:
            yield from close()

    return lambda frames: _frames(rows(frames))


def _faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``; a duplicate is a row whose role and text a row
    before it has.  Rows of a conversation are already in one partition."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    same = Window.partitionBy("no_conv", "conv", "gone", "role", "text").orderBy(F.desc("no_turn"), "turn")
    rows = rows.withColumn("_last", last).withColumn("again", F.row_number().over(same))
    return rows.withColumn("fault", F.when(F.col("_last") == "", BLANK).when(F.col("again") > 1, DUPLICATE)
                           .when(~F.col("_last").isin(".", "!", "?"), CUT_OFF).otherwise(SOUND)).drop("_last")


def _solved(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, gone_col: str | None,
            messages: bool, buffer_chars: int) -> DataFrame:
    spark = df.sparkSession
    prepare(spark)
    conv, turn = F.col(conv_col), F.col(turn_col).cast("long")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    src = df.select(F.coalesce(conv.cast("string"), F.lit("")).alias("conv"), conv.isNull().alias("no_conv"),
                    F.coalesce(turn, F.lit(0)).alias("turn"), turn.isNull().alias("no_turn"),
                    text(role_col).alias("role"), text(text_col).alias("text"),
                    (F.coalesce(F.col(gone_col), F.lit(False)) if gone_col else F.lit(False)).alias("gone"))
    dealt = _faults(src.repartition("no_conv", "conv"))
    ordered = dealt.sortWithinPartitions("no_conv", "conv", "no_turn", F.desc("turn"), F.desc("role"), F.desc("text"),
                                         F.desc("again"))
    first = cut(ordered.select("conv", "no_conv", "turn", "no_turn", "role", "text", "fault", "gone")
                .mapInPandas(_backward(buffer_chars, messages), _SCHEMA), "chat-repair")
    giant = first.where(F.col("kind") == SPILLED).repartition("no_conv", "conv").sortWithinPartitions(
        "no_conv", "conv", F.col("place").asc_nulls_first())
    return first.where(F.col("kind") != SPILLED).unionByName(giant.mapInPandas(_forward(messages), _SCHEMA))


def _with_id(df: DataFrame, solved: DataFrame, conv_col: str, *columns) -> DataFrame:
    kind = df.schema[conv_col].dataType
    return solved.select(F.when(~F.col("no_conv"), F.col("conv")).cast(kind).alias("conv_id"), *columns)


def repaired_messages(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str,
                      gone_col: str | None = None, buffer_chars: int = BUFFER_CHARS) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``place`` (from 0), ``role``,
    ``text`` and ``edit`` (K kept, R re-roled, I inserted).  Cases as in
    ``repair_report``."""
    got = _solved(df, conv_col, turn_col, role_col, text_col, gone_col, True, buffer_chars)
    return _with_id(df, got.where(F.col("kind") == MESSAGE), conv_col, "place", "role", "text", "edit")


def repair_report(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str,
                  gone_col: str | None = None, buffer_chars: int = BUFFER_CHARS) -> DataFrame:
    """Faults, cost, edits and the hash of the repaired text by conversation.

    Rows go by turn, nulls first; rows of one turn by role, then text, so copies
    are adjacent.  Null roles and texts are one space; rows without a
    conversation id are one conversation.  A role that begins with neither s, u
    nor a (or is empty) can not be kept.  A row with ``gone_col`` true takes no
    part, but its conversation is reported; one with no other rows has zeros,
    no edits and the hash of the empty text.  Gaps wrap as longs do.  An empty
    table gives an empty result.  Other columns do not pass through.
    """
    got = _solved(df, conv_col, turn_col, role_col, text_col, gone_col, False, buffer_chars)
    return _with_id(df, got.where(F.col("kind") == SUMMARY), conv_col, *FACTS, "audit",
                    F.col("sha256").alias("repaired_sha256"))


def damaged(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows damaged by crc32 of ``conv:turn`` mod 20 (0 gone, 1 empty, 2 without
    ``.!?``, 3 twice, 4 role user); ``gone`` marks the rows that are dropped."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col))
    name = F.concat(conv, F.lit(":"), turn)
    rows = df.withColumn("_how", F.crc32(name.cast("binary")) % 20)
    how = F.col("_how")
    rows = rows.withColumn(text_col, F.when(how == 1, "").when(how == 2, F.translate(text_col, ".!?", ""))
                           .otherwise(F.col(text_col)))
    rows = rows.withColumn(role_col, F.when(how == 4, "user").otherwise(F.col(role_col)))
    rows = rows.withColumn("gone", how == 0)
    return rows.withColumn("_copy", F.explode(F.when(how == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
                           ).drop("_how", "_copy")
