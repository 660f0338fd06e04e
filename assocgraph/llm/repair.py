"""Conversation structure repair by a forward Viterbi pass over four grammar states.

The roles of a repaired conversation have the initials `(s?(ua)+)?`. The states are: nothing yet, after a system turn, after
a user turn, after an assistant turn; a conversation ends in the first or the last. Each turn is kept (0), given the role
user or assistant (1) or deleted (2, always for blank and repeated turns); a truncated one that is not deleted costs 5 more.
Empty turns may be inserted anywhere (5). A state carries its least (cost, audit), the audit being the initials of the edits
in order, and the digest of what is repaired so far; of equal costs the least audit wins. After each turn its layer is closed
by inserts: at most one to a user turn and one to an assistant turn, as a third would come back to where it began. Two audits
of one layer, state and cost are never one the beginning of the other, so the least of each step stays the least at the end.

The turns of a conversation are dealt by conv_id, sorted in their partition by turn (nulls first), then role and text, and go
through Python as a stream: a task holds the four states and 16 bytes for each different turn of the conversation at hand, never its texts.
A conversation's digest is one sequential hash, so its turns cannot be dealt to several tasks; their number does not matter
otherwise. `repaired` gives the turns themselves, one row each.

Faults: a turn is blank without any character but white space, else a repetition if role and text occurred before in its
conversation, else truncated if its last character that is no white space is none of `.!?`.

Defined results: null roles, texts and ids count as one space where they are read, a conversation without id is one
conversation; a conversation without turns (all lost) has zeros and an empty audit; turns with equal numbers come in the order of role and text; a role without a
known initial can only be replaced or deleted; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, in_arrow

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: (initial of the next turn's role, state after it) and the states that it may follow.
MOVES = (("s", SYSTEM, (NOTHING,)), ("u", USER, (NOTHING, SYSTEM, ASSISTANT)), ("a", ASSISTANT, (USER,)))
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Turns after which the beginning that all states share is put aside, so that audits stay short.
SETTLE = 256


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lost: rows as a crc32 of their number damages them. Lost ones stay as rows without text."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hit = own.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("lost"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return hit.select("conv_id", "turn", "role", "text", "lost", F.explode(F.array_repeat("lost", F.col("times"))).alias("_")).drop("_")


class Grammar:
    """The forward pass over one conversation. A state is (cost, audit, sha256 of the lines so far or None)."""

    def __init__(self):
        self.states: list[tuple | None] = [(0, "", None), None, None, None]
        self.settled: list[str] = []
        self.n = 0
        self._close()

    @staticmethod
    def _line(digest, line: str):
        new = hashlib.sha256() if digest is None else digest.copy()
        new.update((line if digest is None else "\n" + line).encode())
        return new

    def _close(self) -> None:
        """Inserts after the turns so far: a user turn, then an assistant turn."""
        for _, to, sources in MOVES[1:]:
            best = min(((s[0] + INSERT, s[1] + "I", q) for q in sources if (s := self.states[q])), default=None)
            if best and (self.states[to] is None or best[:2] < self.states[to][:2]):
                self.states[to] = (best[0], best[1], self._line(self.states[best[2]][2], NAMES[to] + ":"))

    def turn(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        extra = TRUNCATED if truncated else 0
        best = [(s[0] + DELETE, s[1] + "D", q, None) if s else None for q, s in enumerate(self.states)]
        if not must_go:
            for initial, to, sources in MOVES:
                for cost, letter, name in ((KEEP, "K", role if role[:1] == initial else None), (REROLE, "R", NAMES.get(to))):
                    if name is not None:
                        for q in sources:
                            if (s := self.states[q]) and (best[to] is None or (s[0] + cost + extra, s[1] + letter) < best[to][:2]):
                                best[to] = (s[0] + cost + extra, s[1] + letter, q, name)
        self.states = [b and (b[0], b[1], self.states[b[2]][2] if b[3] is None else self._line(self.states[b[2]][2], f"{b[3]}:{text}")) for b in best]
        self._close()
        self.n += 1
        if self.n % SETTLE == 0:
            common = os.path.commonprefix([s[1] for s in self.states if s])
            self.settled.append(common)
            self.states = [s and (s[0], s[1][len(common) :], s[2]) for s in self.states]

    def result(self) -> tuple[int, str, str]:
        """cost, audit, sha256."""
        cost, audit, digest = min((s for s in (self.states[NOTHING], self.states[ASSISTANT]) if s), key=lambda s: s[:2])
        return cost, "".join(self.settled) + audit, (digest or hashlib.sha256()).hexdigest()


class Conversation:
    """Faults and repair of one conversation, turn by turn in order."""

    def __init__(self, conv_id):
        self.conv_id, self.grammar, self.seen = conv_id, Grammar(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in LEGAL
        self.before = role[:1]
        bare = text.rstrip(SPACES)
        known = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        blank, duplicate = not bare, known in self.seen
        self.seen.add(known)
        truncated = bare[-1:] not in (".", "!", "?")
        self.blank += blank
        self.duplicate += duplicate and not blank
        truncated = truncated and not blank and not duplicate
        self.truncated += truncated
        self.grammar.turn(role, text, blank or duplicate, truncated)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.grammar.result())


def in_order(turns: DataFrame) -> DataFrame:
    """Each conversation's turns together and in order."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return turns.repartition("conv_id").sortWithinPartitions(*order)


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256, one row per conversation.

    turns: conv_id, turn, role, text and, if some are lost, lost; sha256 is that of the repaired `role:text` lines.
    """
    lost = F.coalesce("lost", F.lit(False)) if "lost" in turns.columns else F.lit(False)
    name = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    own = in_order(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), name("role"), name("text"), lost.alias("lost")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    names = ["conv_id", *counts, "audit", "sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, None

        def out(done: list[Conversation]) -> pa.RecordBatch:
            values = list(zip(*(c.row() for c in done)))
            types = [kind, *[pa.int64()] * len(counts), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names)

        for batch in batches:
            kind, done = batch.column(0).type, []
            for conv_id, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now)
                    now = Conversation(conv_id)
                if not gone:
                    now.add(turn, role, text)
            if done:
                yield out(done)
        if now is not None:
            yield out([now])

    return in_arrow(own, run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in counts)}, audit string, sha256 string")


def repaired(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, position, edit, role, text: the turns as they are after the edits of `plans` (conv_id, audit).

    A role that is replaced, or inserted, is user after nothing, a system or an assistant turn, and else assistant.
    """
    present = turns.filter(~F.coalesce("lost", F.lit(False))) if "lost" in turns.columns else turns
    name = lambda c: F.coalesce(F.col(f"t.{c}"), F.lit(" ")).alias(c)
    # one plan per conversation; conversations without turns only get inserts, of which there are none
    both = plans.alias("p").join(present.alias("t"), F.col("p.conv_id").eqNullSafe(F.col("t.conv_id")))
    own = in_order(both.select("t.conv_id", F.col("t.turn").cast("long").alias("turn"), name("role"), name("text"), "audit"))
    names = ["conv_id", "position", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = (object(),), None
        audit, at, position, before, turns_end = "", 0, 0, "", 0
        for batch in batches:
            kind, rows = batch.column(0).type, []

            def put(conv_id, edit: str, role: str, text: str) -> None:
                nonlocal position, before
                if edit in "RI":
                    role = "assistant" if before == "u" else "user"
                rows.append((conv_id, position, edit, role, text))
                position, before = position + 1, role[:1]

            for conv_id, _, role, text, plan in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv_id,) != now:
                    now, audit, at, position, before = (conv_id,), plan, 0, 0, ""
                    turns_end = len(plan.rstrip("I"))
                while audit[at] == "I":
                    put(conv_id, "I", "", "")
                    at += 1
                if audit[at] != "D":
                    put(conv_id, audit[at], role, text)
                at += 1
                if at >= turns_end:  # what is inserted after the last turn
                    for _ in audit[at:]:
                        put(conv_id, "I", "", "")
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * 5, (kind, pa.int64(), pa.string(), pa.string(), pa.string()))], names)

    return in_arrow(own, run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, position long, edit string, role string, text string")

