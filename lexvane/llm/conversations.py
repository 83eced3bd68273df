r"""Repair of conversations: the cheapest edits that give a turn structure, by a forward Viterbi pass.

A repaired conversation's role initials are ``(s?(ua)+)?``. The grammar has four states: nothing yet, after a system message, after
a user's and after an assistant's. A message is kept (K), given the role user or assistant (R, cost 1) or deleted (D, cost 2; blank
and duplicate ones must be); a truncated message that stays costs 5 more; empty messages are inserted anywhere (I, cost 5). For each
state the pass carries the least (cost, audit), the audit being the edits' letters in order. After each message the layer is closed
by at most two inserts: a third would come back to a state that was cheaper before.

Costs count relative to each other, and of audits only how they compare counts: which differ where and which is the start of
another. So a step works on short stand-ins for the audits, has few different inputs and is looked up after it was met once. The
audits themselves are ropes, and each state hashes its repaired text as it goes: a task reads its conversations in order and holds
one message and, for each of four states, an audit of a byte a message. A conversation's hash is over its whole text in order, so
one task reads one conversation, but never holds it.

Messages are ordered by turn (nulls first), then role and text, so that rows of one turn have a defined order. Faults: blank (no
character but ``[\x20\x09-\x0D]``), duplicate (role and text were there before), truncated (the last such character is none of
``.!?``); the first that holds counts. Null roles and texts are one space. ``gaps`` is what the turns lack between least and
greatest; ``illegal`` counts neighbours whose role initials are not su, ua or au.

Defined cases: rows of a null conversation id are one conversation; a role of another initial, or an empty one, can only be
given a role or be deleted; texts of any length are hashed in pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexvane.llm.common import lean

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
CUT = 5  # a truncated message that stays
FINE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
#: States and the letter that leads to each. The last state and the first end a conversation.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}

State = tuple[int, str] | None


def stand_ins(audits: list[str]) -> list[str]:
    """Shorter strings that compare like ``audits`` however these go on, and start each other where these do."""
    skip = len(commonprefix(audits)) if len(audits) > 1 else len(audits[0]) if audits else 0
    rest, out = [a[skip:] for a in audits], [""] * len(audits)
    for letter in {r[0] for r in rest if r}:
        own = [k for k, r in enumerate(rest) if r[:1] == letter]
        for k, tail in zip(own, stand_ins([rest[k][1:] for k in own]), strict=True):
            out[k] = letter + tail
    return out


def _closed(layer: list) -> list:
    """The layer with up to two inserted messages after each state."""
    for _ in range(2):
        for state, held in enumerate(list(layer)):
            for letter, to in _NEXT[state].items():
                if held and letter != "s":
                    cost, audit, parent, said = held
                    new = (cost + COST[INSERT], audit + INSERT, parent, (*said, (_ROLE[to], False)))
                    if layer[to] is None or new[:2] < layer[to][:2]:
                        layer[to] = new
    return layer


def _settled(layer: list) -> tuple[int, tuple[State, ...], tuple]:
    """Least cost, states relative to it, and for each state (parent, edits, messages said)."""
    a = layer[_ASSISTANT][0]
    # What these two can still do an assistant's state can do too, without a system message at 2 for its deletion.
    if layer[_START] and layer[_START][0] > a + COST[DELETE]:
        layer[_START] = None
    if layer[_SYSTEM] and layer[_SYSTEM][0] > a:
        layer[_SYSTEM] = None
    there = [k for k in range(4) if layer[k]]
    least = min(layer[k][0] for k in there)
    names = dict(zip(there, stand_ins([layer[k][1] for k in there]), strict=True))
    return least, tuple((layer[k][0] - least, names[k]) if k in names else None for k in range(4)), tuple(layer[k] and layer[k][2:] for k in range(4))


@lru_cache(maxsize=1 << 16)
def first_layer() -> tuple[int, tuple[State, ...], tuple]:
    return _settled(_closed([(0, "", 0, ()), None, None, None]))


@lru_cache(maxsize=1 << 16)
def next_layer(states: tuple[State, ...], initial: str, fault: int) -> tuple[int, tuple[State, ...], tuple, tuple[str, ...]]:
    """A message read: what the least cost grows by, the states after it, each one's (parent, messages said), each one's edits."""
    layer: list = [None] * 4
    for state, held in enumerate(states):
        if held is None:
            continue
        cost, audit = held
        moves = [(state, DELETE, COST[DELETE], ())]
        if fault not in (BLANK, DUPLICATE):
            extra = CUT if fault == TRUNCATED else 0
            for letter, to in _NEXT[state].items():
                if letter == initial:
                    moves.append((to, KEEP, COST[KEEP] + extra, ((None, True),)))
                if letter != "s":
                    moves.append((to, REROLE, COST[REROLE] + extra, ((_ROLE[to], True),)))
        for to, edit, more, said in moves:
            new = (cost + more, audit + edit, state, said)
            if layer[to] is None or new[:2] < layer[to][:2]:
                layer[to] = new
    layer = _closed(layer)
    base = [held[1] if held else "" for held in states]
    edits = [held[1][len(base[held[2]]) :] if held else "" for held in layer]
    least, after, ways = _settled(layer)
    return least, after, ways, tuple(edits)


class _Pass:
    """One conversation, message by message."""

    def __init__(self) -> None:
        self.cost, self.states, ways = first_layer()
        # For each state: a chain of audit pieces, the piece being written, the hash of the repaired text, whether it has messages.
        self.held = [None if w is None else (None, INSERT * len(w[1]), *self._said(hashlib.sha256(), False, w[1], "", "")) for w in ways]
        self.counts, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.low = self.high = self.turn = None
        self.turns = 0

    @staticmethod
    def _said(digest, begun: bool, said: tuple, role: str, text: str):
        for own, whole in said:
            digest.update(f"{chr(10) if begun else ''}{own or role}:{text if whole else ''}".encode("utf-8", "surrogatepass"))
            begun = True
        return digest, begun

    def read(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.counts[fault] += 1
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn = self.high = turn
            self.turns += 1
        more, self.states, ways, edits = next_layer(self.states, initial, fault)
        self.cost += more
        new = []
        for way, edit in zip(ways, edits, strict=True):
            if way is None:
                new.append(None)
                continue
            chain, piece, digest, begun = self.held[way[0]]
            piece += edit
            if len(piece) > 500:
                chain, piece = (chain, piece), ""
            new.append((chain, piece, *self._said(digest.copy(), begun, way[1], role, text)))
        self.held = new

    def row(self) -> tuple:
        ends = [k for k in (_START, _ASSISTANT) if self.states[k]]
        best = min(ends, key=lambda k: self.states[k])
        chain, piece, digest, _ = self.held[best]
        pieces = [piece]
        while chain:
            chain, piece = chain
            pieces.append(piece)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        _, blank, duplicate, truncated = self.counts
        return gaps, blank, duplicate, truncated, self.illegal, self.cost + self.states[best][0], "".join(reversed(pieces)), digest.hexdigest()


_RESULT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]


def _repaired(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Batches have conversation, turn, role, text and fault, each conversation's messages together and in order."""
    fields = pa.schema([("c", kind), *[(n, pa.int64() if t == "long" else pa.string()) for n, t in _RESULT]])
    done: list[tuple] = []
    now, at = None, None
    for b in batches:
        for conv, turn, role, text, fault in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
            if now is None or conv != at:
                if now:
                    done.append((at, *now.row()))
                now, at = _Pass(), conv
            now.read(turn, role, text, fault)
        if len(done) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), fields, strict=True)], schema=fields)
            done = []
    if now:
        done.append((at, *now.row()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), fields, strict=True)], schema=fields)


def _messages(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]


def repair_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    ``repaired_messages`` gives the repaired messages themselves.
    """
    rows = _messages(df, conv_col, turn_col, role_col, text_col).repartition("c")
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    # The window's keys hold the conversation, by which the rows are dealt already: they are sorted again, not shuffled.
    nth = F.row_number().over(Window.partitionBy("c", "role", F.md5(F.col("text").cast("binary"))).orderBy(*_order()))
    fault = F.when(bare == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    # Of equal rows of one turn the one that counts as first stands first.
    ordered = rows.withColumn("nth", nth).withColumn("fault", fault).sortWithinPartitions(F.col("c").asc_nulls_first(), *_order(), "nth").drop("nth")
    kind = ordered.schema["c"].dataType
    arrow = to_arrow_type(kind)
    schema = f"c {kind.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in _RESULT)
    return ordered.mapInArrow(lambda it: lean(_repaired(it, arrow)), schema).withColumnRenamed("c", conv_col)


def repaired_messages(df: DataFrame, repairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The messages of the repaired conversations: conversation, position (from 1), role, text and edit (K, R or I).

    ``repairs`` is the result of ``repair_conversations``. Edits meet messages by their number, so a long conversation is no single task
    of the join.
    """
    each = repairs.select(F.col(conv_col).alias("c"), F.posexplode(F.split("audit", "")).alias("k", "edit")).where(F.col("edit") != "")
    upto = Window.partitionBy("c").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    edits = each.select("c", "edit", F.sum((F.col("edit") != INSERT).cast("int")).over(upto).alias("nth"), F.sum((F.col("edit") != DELETE).cast("int")).over(upto).alias("position"))
    rows = _messages(df, conv_col, turn_col, role_col, text_col).withColumn("nth", F.row_number().over(Window.partitionBy("c").orderBy(*_order())))
    same = F.col("e.c").eqNullSafe(F.col("m.c")) & (F.col("e.nth") == F.col("m.nth"))
    made = F.col("e.edit") == INSERT
    met = edits.where(F.col("edit") != DELETE).alias("e").join(rows.alias("m"), same & ~made, "left")
    out = met.select(F.col("e.c").alias("c"), "position", "edit", F.when(made, "").otherwise(F.col("m.text")).alias("text"), F.col("m.role").alias("own"))
    opens = F.max((F.col("position") == 1) & (F.col("edit") == KEEP) & F.col("own").startswith("s")).over(Window.partitionBy("c"))
    by_place = F.when((F.col("position") - F.coalesce(opens, F.lit(False)).cast("int")) % 2 == 1, "user").otherwise("assistant")
    return out.select(F.col("c").alias(conv_col), "position", F.when(F.col("edit") == KEEP, F.col("own")).otherwise(by_place).alias("role"), "text", "edit")
