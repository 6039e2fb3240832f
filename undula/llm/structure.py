"""Conversation structure repair by a dynamic programme over a prefix trie.

A conversation's rows become a signature: a character a row that tells its role's initial and its fault. Cost and edits depend
on the signature alone. Distinct signatures are dealt out by range and sorted, so that those of a common prefix meet; a task
walks them as a trie, keeping the layers of the programme for the path it is on. A layer is made once for each prefix, and an
answer is read off where a signature ends.

A layer has for each state of the wanted order of roles (start, after a system row, after a user row, after an assistant row) the
least cost, the state it comes from and the edits in between. Edits of a row are led by inserted rows, so that every text of edits
ends in a row's own letter: of two in a layer neither begins the other, and their order stays whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLANK = r" \t\n\u000b\f\r"
#: States: what the next row's role may be, and where it leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: Of a signature: a row that must go, and rows of each initial, in capitals if they are truncated.
GONE = "x"
#: Inserted rows before the end, by state; a signature of deleted rows alone may end at the start.
ENDINGS = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
ANSWER = "signature string, cost bigint, audit string"
SIGNED = "kind int, conv_id {id}, place bigint, role string, text string, signature string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
REPAIRED = "conv_id {id}, place bigint, role string, text string, edit string"


@dataclass(frozen=True)
class Entry:
    """The best edits that lead to a state: their cost, the state before the last row, the last edits, the order among states."""

    cost: int
    came: int
    move: str
    rank: int


Layer = tuple[Entry | None, Entry | None, Entry | None, Entry | None]
ROOT: Layer = (Entry(0, START, "", 0), None, None, None)


@lru_cache(None)
def moves(symbol: str, state: int) -> list[tuple[int, int, str]]:
    """(state, cost, edits) of each way to pass a row: inserted rows, then its own edit. More than two inserted rows lead back."""
    out = []
    role, extra = symbol.lower(), TRUNCATED * symbol.isupper()
    for inserted in range(3):
        lead, cost = "I" * inserted, INSERT * inserted
        out.append((state, cost + DELETE, lead + "D"))
        if symbol != GONE:
            for wanted, then in NEXT[state].items():
                if role == wanted:
                    out.append((then, cost + extra, lead + "K"))
                elif wanted != "s":
                    out.append((then, cost + extra + REROLE, lead + "R"))
        state = ASSISTANT if state == USER else USER
    return out


def advanced(layer: Layer, symbol: str) -> Layer:
    """The layer after one more row."""
    best: list[tuple | None] = [None] * 4
    for came, entry in enumerate(layer):
        if entry is not None:
            for state, cost, move in moves(symbol, came):
                key = (entry.cost + cost, entry.rank, move, came)
                if best[state] is None or key < best[state]:
                    best[state] = key
    order = sorted((b[1:3] for b in best if b is not None))
    return tuple(None if b is None else Entry(b[0], b[3], b[2], order.index(b[1:3])) for b in best)


def answer(layers: list[Layer]) -> tuple[int, str]:
    """The least cost and the ASCII-least cheapest edits of the rows that made the layers."""
    ends = [(e.cost + INSERT * ENDINGS[state], e.rank, state) for state, e in enumerate(layers[-1]) if e is not None]
    cost, _, state = min(ends)
    edits = ["I" * ENDINGS[state]]
    for layer in layers[:0:-1]:
        edits.append(layer[state].move)
        state = layer[state].came
    return cost, "".join(reversed(edits))


class Trie:
    """Answers for signatures given in order: the path to the last one is kept, and its layers up to where the next one parts."""

    def __init__(self):
        self.path, self.layers, self.made = "", [ROOT], 0

    def repair(self, signature: str) -> tuple[int, str]:
        shared = len(commonprefix((self.path, signature)))
        del self.layers[shared + 1 :]
        for symbol in signature[shared:]:
            self.layers.append(advanced(self.layers[-1], symbol))
            self.made += 1
        self.path = signature
        return answer(self.layers)


def answers(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature."""
    n = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for b in batches:
            own = b.column("signature").to_pylist()
            cost, audit = zip(*map(trie.repair, own)) if own else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("signature"), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["signature", "cost", "audit"])

    distinct = signatures.select("signature").distinct()
    return distinct.repartitionByRange(n, "signature").sortWithinPartitions("signature").mapInArrow(solved, ANSWER)


def faults(turns: DataFrame) -> DataFrame:
    """turns with fault: blank, duplicate, truncated or null, the first that a row has.

    blank: only ASCII white space; duplicate: role and text are an earlier row's; truncated: what comes last but white space is
    none of . ! ?
    """
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    end = F.expr(f"rtrim('{BLANK}', text)")
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.repartition(n, "conv_id").withColumn("fault", F.when(end == "", "blank").when(earlier, "duplicate").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated"))


def signed(turns: DataFrame) -> DataFrame:
    """The rows in order with their places (kind 0), and after each conversation's rows one of kind 1 that has its signature and counts.

    turns: (conv_id, turn, role, text), none null but conv_id and turn. Rows are streamed; of a conversation a character a row is held.
    """
    layout = _layout(turns, SIGNED)
    # of equal rows the one that is no duplicate comes first
    again = F.coalesce(F.col("fault") == "duplicate", F.lit(False))
    marked = faults(turns).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", again)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        for b in batches:
            out = []
            for conv, turn, role, text, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        out.append(now.total())
                    now = Conversation(conv)
                out.append((0, conv, now.rows, role, text, *[None] * 6))
                now.add(turn, role, fault)
            kind = b.schema.field("conv_id").type
            yield _batch(layout, kind, out)
        if now is not None:
            yield _batch(layout, kind, [now.total()])

    return marked.mapInArrow(streamed, layout)


class Conversation:
    """What is counted of a conversation while its rows pass."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.turns, self.low, self.high = conv_id, 0, 0, 0, 0
        self.last, self.illegal = None, 0
        self.signature: list[str] = []
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)

    def add(self, turn: int | None, role: str, fault: str | None) -> None:
        if turn is not None and (not self.turns or turn != self.high):
            self.low = turn if not self.turns else self.low
            self.turns, self.high = self.turns + 1, turn
        initial = role[:1]
        self.illegal += self.rows > 0 and self.last + initial not in ("su", "ua", "au")
        self.last, self.rows = initial, self.rows + 1
        symbol = GONE if fault in ("blank", "duplicate") else initial if initial in ("s", "u", "a") else "o"
        self.signature.append(symbol.upper() if fault == "truncated" else symbol)
        if fault:
            self.faults[fault] += 1

    def total(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (1, self.conv_id, self.rows, None, None, "".join(self.signature), gaps, *self.faults.values(), self.illegal)


def _layout(turns: DataFrame, layout: str) -> str:
    return layout.format(id=turns.schema["conv_id"].dataType.simpleString())


def _batch(layout: str, conv_id: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in layout.split(", ")))
    kind = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    kinds = [conv_id if n == "conv_id" else kind[k] for n, k in zip(names, kinds)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], list(names))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit) of what stays of rows (kind 1) after a header (kind 0, audit) of each conversation.

    Conversations stay whole and in order within partitions. Inserted rows have an empty text.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    layout = _layout(rows, REPAIRED)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, wanted = "", 0, 0, START
        for b in batches:
            out = []
            kind = b.schema.field("conv_id").type
            for header, conv, role, text, given in zip(*(b.column(c).to_pylist() for c in ("kind", "conv_id", "role", "text", "audit"))):
                if header == 0:
                    audit, at, place, wanted = given, 0, 0, START
                else:
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        wanted = NEXT[wanted][role[:1] if edit == "K" else _given(wanted)]
                        out.append((conv, place, role if edit == "K" else ROLES[wanted], text, edit))
                        place += 1
                while at < len(audit) and audit[at] == "I":
                    wanted, at = NEXT[wanted][_given(wanted)], at + 1
                    out.append((conv, place, ROLES[wanted], "", "I"))
                    place += 1
            yield _batch(layout, kind, out)

    ordered = rows.repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", "place")
    return ordered.mapInArrow(streamed, layout)


#: Roles that edits give.
ROLES = {USER: "user", ASSISTANT: "assistant"}


def _given(state: int) -> str:
    """The initial of the role that an inserted or reroled row has after a state."""
    return "a" if state == USER else "u"


def hashed(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired_rows: of role:text, joined by new lines."""
    layout = _layout(rows, "conv_id {id}, repaired_sha256 string")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, begun = None, None, False
        for b in batches:
            out = []
            kind = b.schema.field("conv_id").type
            for conv, place, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if not begun or place == 0:
                    if begun:
                        out.append((now, digest.hexdigest()))
                    now, digest, begun = conv, hashlib.sha256(), True
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield _batch(layout, kind, out)
        if begun:
            yield _batch(layout, kind, [(now, digest.hexdigest())])

    return rows.mapInArrow(streamed, layout)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows) of turns (conv_id, turn, role, text; other columns aren't read) with the cheapest structure repair.

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. rows: conv_id, place, role, text, edit.

    A conversation's rows are taken by turn (nulls first), those of one turn by role and text. gaps: turns missing between the
    least and the greatest. blank, duplicate and truncated count rows by their first fault (see faults); illegal counts
    neighbours whose roles' initials are not su, ua or au. Edits: Keep costs 0, Rerole to user or assistant 1, Delete 2 (blank
    and duplicate rows must go), Insert of an empty user or assistant row 5; a truncated row that stays costs 5 more. Roles of
    what stays have initials (s?(ua)+)?; audit has the edits' initials of the cheapest repair, of ties the ASCII-least.

    Null roles and texts are one space (and so blank or of no known role); rows of a null conv_id are one conversation; repeated
    rows are duplicates; an empty table gives none. Conversations without a row are not in the result. A conversation is
    streamed through one task, as its repaired rows have an order; a character a row of it is held.
    """
    own = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = written(signed(own), "turns")
    found = rows.where("kind = 1").select("conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal")
    told = written(found.join(answers(found), "signature").drop("signature"), "repairs")
    header = told.select(F.lit(0).alias("kind"), "conv_id", F.lit(None).cast("bigint").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    body = rows.where("kind = 0").select(F.lit(1).alias("kind"), "conv_id", "place", "role", "text", F.lit(None).cast("string").alias("audit"))
    return told, repaired_rows(header.unionByName(body))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32 of conv_id:turn, modulo 20 (nulls: one space).

    0 drops the row, 1 empties its text, 2 removes its . ! ?, 3 repeats it, 4 makes it a user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    code = (F.crc32(key.cast("binary")) % 20).alias("code")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), code).where("code != 0")
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    changed = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(copies).alias("copy")).drop("copy")
