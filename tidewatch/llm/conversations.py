"""Conversation structure repair by weighted finite-state composition.

A conversation's rows, in order, are an input acceptor; an edit transducer keeps, reroles or deletes a row, or
inserts one; a grammar acceptor takes the role initials ``(s?(ua)+)?``. The three are composed lazily: a state
is (row, grammar state), its arcs are made when they are met, for a row's symbol (its role's initial and its
fault), and remembered. Weights are (cost, string of edit initials) in lexicographic order. The shortest path
is found in topological order, in two streams over the sorted rows:

* backward, the least cost from each grammar state to the end, which is four numbers a row;
* forward from the start, the least letter among the arcs that lie on a path of least cost. As every letter
  leads from a state to one state, and strings are compared from their first letter on, this is the path with
  the least (cost, string).

Rows of a conversation are sorted by Spark, which spills, and streamed through one task in both directions;
nothing of it but these numbers is held, however long it is. (Its digest is a checksum of all its rows in
order, so one task has to read them anyhow.) Many conversations, equal ones too, spread over tasks.

Defined results: a null role or text is one space; a null turn comes first; rows of a turn are ordered by role,
then text; equal rows follow each other, all but the first are duplicates; a null conv_id is a conversation of
its own; a role that is empty or begins with another letter can be reroled or deleted; no rows give no rows;
extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import require
from tidewatch.session import ship

#: Costs of the edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The grammar ``(s?(ua)+)?``: from each state, the next one by initial. 0 is the start.
GRAMMAR: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLE = {"u": "user", "a": "assistant"}
FAULTS = ("", "blank", "duplicate", "truncated")
BLANKS = " \t\n\x0b\x0c\r"
ADJACENT = ("su", "ua", "au")
NEVER = 1 << 30


def insert_closure(v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end, with rows inserted here where that is cheaper. More than one insertion for each state never is."""
    for _ in GRAMMAR:
        v = tuple(min(v[g], *(INSERT + v[to] for c, to in GRAMMAR[g].items() if c in ROLE)) for g in range(len(GRAMMAR)))
    return v


@lru_cache(maxsize=4096)
def arcs(initial: str, fault: int, g: int) -> tuple[tuple[str, int, int, str], ...]:
    """The composed arcs that read a row in grammar state g: (letter, cost, next state, initial written, "" for none), letters ascending."""
    out = [("D", DELETE, g, "")]
    if fault not in (1, 2):
        more = TRUNCATED if fault == 3 else 0
        if initial in GRAMMAR[g]:
            out.append(("K", KEEP + more, GRAMMAR[g][initial], initial))
        out += [("R", REROLE + more, GRAMMAR[g][c], c) for c in GRAMMAR[g] if c in ROLE]
    return tuple(out)


@lru_cache(maxsize=65536)
def before(initial: str, fault: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a row, from those after it."""
    return insert_closure(tuple(min(cost + after[to] for _, cost, to, _ in arcs(initial, fault, g)) for g in range(len(GRAMMAR))))


@lru_cache(maxsize=65536)
def forward(initial: str, fault: int, after: tuple[int, ...], g: int) -> tuple[tuple[tuple[str, int, str], ...], int]:
    """The edits from state g up to and with a row, (letter, cost, initial written), on the path with the least string; and the state reached."""
    here, edits = before(initial, fault, after), []
    while True:
        options = [(letter, cost, to, c, False) for letter, cost, to, c in arcs(initial, fault, g) if cost + after[to] == here[g]]
        options += [("I", INSERT, to, c, True) for c, to in GRAMMAR[g].items() if c in ROLE and INSERT + here[to] == here[g]]
        letter, cost, g, c, inserted = min(options)
        edits.append((letter, cost, c))
        if not inserted:
            return tuple(edits), g


END = insert_closure(tuple(0 if g in FINAL else NEVER for g in range(len(GRAMMAR))))


def finish(g: int) -> tuple[tuple[str, int, str], ...]:
    """The edits after the last row."""
    edits = []
    while not (g in FINAL and END[g] == 0):
        c, g = min((c, to) for c, to in GRAMMAR[g].items() if c in ROLE and INSERT + END[to] == END[g])
        edits.append(("I", INSERT, c))
    return tuple(edits)


def _pack(v: tuple[int, ...]) -> int:
    """Costs to the end, from the least of them on: they differ by a few insertions, so each fits a byte."""
    low = min(v)
    return sum((x - low) << (8 * i) for i, x in enumerate(v))


@lru_cache(maxsize=4096)
def _unpack(x: int) -> tuple[int, ...]:
    return tuple((x >> (8 * i)) & 255 for i in range(len(GRAMMAR)))


def damage(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): rows damaged by crc32 of ``conv:turn`` modulo 20; a dropped row stays as a mark that its conversation exists."""
    require(df, conv_col, turn_col, role_col, text_col)

    def col(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(col(conv_col), F.lit(":"), col(turn_col)).cast("binary")) % 20
    rows = df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), col(role_col).alias("role"), col(text_col).alias("text"), kind.alias("kind"))
    rows = rows.withColumns({"text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")), "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def intact(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows in the form that ``repair`` takes, without any damage."""
    require(df, conv_col, turn_col, role_col, text_col)
    return df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))], F.lit(False).alias("gone"))


EDITS = "turn long, role string, text string, edit string, cost long, fault string, old_role string"


def repair(rows: DataFrame) -> DataFrame:
    """(conv, at, turn, role, text, edit, cost, fault, old_role): each conversation's rows and edits in order.

    rows: (conv, turn, role, text, gone). role and text are the repaired ones, also of deleted rows (which keep their
    own); an inserted row has no turn and no old_role; a row that is gone leaves one without an edit, at -1.
    The rows of a conversation stay in one partition.
    """
    ship(rows.sparkSession)
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))) > 1
    rest = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(rest == "", 1).when(seen, 2).when(~F.right(rest, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    coded = rows.repartition("conv").withColumn("fault", F.when(F.col("gone"), 0).otherwise(fault))
    kind = dict(rows.dtypes)["conv"]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, after, n = False, None, END, 0
        for b in batches:
            states, places = [], []
            for c, role, fault, gone in zip(*(b.column(x).to_pylist() for x in ("conv", "initial", "fault", "gone")), strict=True):
                if not begun or c != conv:
                    begun, conv, after, n = True, c, END, 0
                states.append(_pack(after))
                places.append(n)
                n -= 1
                if not gone:
                    after = _unpack(_pack(before(role, fault, _unpack(_pack(after)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(states, pa.int64()), pa.array(places, pa.int64())], names=[*b.schema.names, "after", "place"])

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        begun, conv, g, at = False, None, 0, 0
        for b in batches:
            if schema is None:
                schema = pa.schema([pa.field("conv", b.schema.field("conv").type), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()), ("cost", pa.int64()), ("fault", pa.string()), ("old_role", pa.string())])
            out: list[tuple] = []
            for c, turn, role, text, fault, gone, after in zip(*(b.column(x).to_pylist() for x in ("conv", "turn", "role", "text", "fault", "gone", "after")), strict=True):
                if not begun or c != conv:
                    if begun:
                        for letter, cost, i in finish(g):
                            out.append((conv, at, None, ROLE[i], "", letter, cost, None, None))
                            at += 1
                    begun, conv, g, at = True, c, 0, 0
                if gone:
                    out.append((c, -1, None, None, None, None, 0, None, None))
                    continue
                edits, g = forward(role[:1], fault, _unpack(after), g)
                for letter, cost, i in edits:
                    if letter == "I":
                        out.append((c, at, None, ROLE[i], "", letter, cost, None, None))
                    else:
                        out.append((c, at, turn, ROLE[i] if letter == "R" else role, text, letter, cost, FAULTS[fault], role))
                    at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        tail = [(conv, at + k, None, ROLE[i], "", letter, cost, None, None) for k, (letter, cost, i) in enumerate(finish(g))] if begun else []
        if tail:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*tail, strict=True), schema, strict=True)], schema=schema)

    coded = coded.withColumn("initial", F.left("role", F.lit(1))).select("conv", "turn", "role", "text", "gone", "fault", "initial")
    latest = coded.sortWithinPartitions(F.asc_nulls_first("conv"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc(F.col("fault") == 2))
    passed = latest.mapInArrow(back, f"conv {kind}, turn long, role string, text string, gone boolean, fault int, initial string, after long, place long")
    first = passed.sortWithinPartitions(F.asc_nulls_first("conv"), "place")
    return first.mapInArrow(ahead, f"conv {kind}, at long, {EDITS}")


def digests(edits: DataFrame) -> DataFrame:
    """A row for each conversation of ``repair``'s result: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    kind = dict(edits.dtypes)["conv"]
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    class Sums:
        def __init__(self, conv):
            self.conv, self.first, self.last, self.turns = conv, None, None, 0
            self.faults, self.illegal, self.cost, self.audit, self.previous = dict.fromkeys(FAULTS, 0), 0, 0, [], None
            self.sha, self.any = hashlib.sha256(), False

        def add(self, turn, role, text, edit, cost, fault, old_role):
            if edit is None:
                return
            self.audit.append(edit)
            self.cost += cost
            if edit != "I":
                self.faults[fault] += 1
                if self.previous is not None and self.previous + old_role[:1] not in ADJACENT:
                    self.illegal += 1
                self.previous = old_role[:1]
                if turn is not None and turn != self.last:
                    self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
            if edit != "D":
                self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
                self.any = True

        def row(self):
            gaps = self.last - self.first + 1 - self.turns if self.turns else 0
            return (self.conv, min(gaps, 2**63 - 1), *(self.faults[f] for f in FAULTS[1:]), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv_type = None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            conv_type, out = b.schema.field("conv").type, []
            for c, *values in zip(*(b.column(x).to_pylist() for x in ("conv", "turn", "role", "text", "edit", "cost", "fault", "old_role")), strict=True):
                if now is None or c != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = Sums(c)
                now.add(*values)
            if out:
                yield batch(out)
        if now is not None:
            yield batch([now.row()])

    ordered = edits.sortWithinPartitions(F.asc_nulls_first("conv"), "at")
    return ordered.mapInArrow(run, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
