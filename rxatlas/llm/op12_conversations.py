"""Conversations repaired at least cost so that their turns read: an optional system turn, then user and assistant in turn.

A turn may be kept, given another role (2), deleted (3; blank and repeated turns must be) or preceded by empty turns of
the role that is due (2 each); a truncated turn that stays costs 1. The state is what was said last (nothing, system,
user, assistant), so the costs of all ways on from a place are a vector of four numbers. Of all cheapest
edits the one whose letters (D, I, K, R) come first in ASCII order is taken.

**Four-Russians tables.** A turn is one of nine symbols (role class and truncation, or "must go"). Cost vectors less their
smallest entry are few: starting from the end's vector, every reachable one gets a number. For each of them
and each block of ``BLOCK`` symbols a table holds the vector before the block and the cost between. A conversation is read from
its end, one look-up a block. Afterwards the blocks are expanded backward, symbol by symbol, from the vectors that stand at
their ends, and followed from the first turn on: the least letter among the cheapest edits at each place gives the least
string, as a letter settles the next state.

**Partitioning.** Turns are dealt by ranges of (conversation, turn, role, start of the text) and sorted, so a conversation with very
many turns is spread over several tasks. One that lies inside a task is finished there. The first and the last one of a
task, and what is longer than ``HELD`` turns, may go on in another task: their turns are staged, repeats are found by a grouped
minimum, and a second, small pass folds one byte for each turn (no more than the letters of the result row) and then streams
the texts through the digest. No task holds the texts of a long conversation.

Defined results: null roles and texts are one space; turns are ordered by number (nulls first), equal numbers by role and text in
code-point order; equal turns with one number count as repeats; a conversation whose turns are all absent has a result row with zeros;
a null conversation id is a conversation of its own; a role's class is its first letter (s, u, a), any other role, the
empty one too, can only be deleted or given another role. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textops import pieces

BLOCK = 4
HELD = 4096  # turns of a conversation that a task of the first pass holds
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)  # what may always follow a state
ROLE = {USER: "user", ASSISTANT: "assistant"}
CLASSES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
GO = 8  # the symbol of a turn that must be deleted; others are 2 * class + truncated, with class 0 for other roles
SYMBOLS = 9
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\v\f\r"

Vector = tuple[int, ...]


def _kept(state: int, role: int) -> int | None:
    """The state after a turn of a role class, where it may stand."""
    if role == SYSTEM:
        return SYSTEM if state == START else None
    return role if role and DUE[state] == role else None


def _with_insertions(costs: list[int]) -> list[int]:
    """The costs if empty turns may stand first."""
    user, assistant = costs[USER], costs[ASSISTANT]
    costs[USER], costs[ASSISTANT] = min(user, 2 + assistant), min(assistant, 2 + user)
    for state in (START, SYSTEM):
        costs[state] = min(costs[state], 2 + costs[USER])
    return costs


#: costs from the end on: nothing and a closed pair may end, other states are completed by empty turns
END: Vector = tuple(_with_insertions([0, 99, 99, 0]))


def _before(after: Vector, symbol: int) -> list[int]:
    """Costs from the place before a symbol, from those after it."""
    costs = [3 + c for c in after]
    if symbol != GO:
        role, truncated = divmod(symbol, 2)
        for state in range(4):
            kept = _kept(state, role)
            ways = [costs[state], 2 + truncated + after[DUE[state]]]
            if kept is not None:
                ways.append(truncated + after[kept])
            costs[state] = min(ways)
    return _with_insertions(costs)


class Tables:
    """Numbered vectors, transitions by symbol and by block, and the edits that each symbol takes."""

    def __init__(self) -> None:
        number, todo, steps = {END: 0}, [END], []
        for after in todo:
            row = []
            for symbol in range(SYMBOLS):
                costs = _before(after, symbol)
                least = min(costs)
                vector = tuple(c - least for c in costs)
                if vector not in number:
                    number[vector] = len(todo)
                    todo.append(vector)
                row.append((number[vector], least))
            steps.append(row)
        self.vectors = todo
        self.one, self.one_cost = (np.array([[s[i] for s in row] for row in steps]) for i in (0, 1))
        # a block's code is its symbols as digits, the last one lowest; it is read from the last one back
        to, cost = self.one, self.one_cost
        for _ in range(BLOCK - 1):
            cost = np.stack([(self.one_cost[to, s] + cost) for s in range(SYMBOLS)], axis=1).reshape(len(todo), -1)
            to = np.stack([self.one[to, s] for s in range(SYMBOLS)], axis=1).reshape(len(todo), -1)
        self.block, self.block_cost = to, cost
        self.edits = [[[self._edit(v, s, q) for q in range(4)] for s in range(SYMBOLS)] for v in range(len(todo))]

    def _edit(self, after: int, symbol: int, state: int) -> tuple[str, int]:
        """(letters, next state): the least letters among the cheapest edits of one symbol."""
        later = self.vectors[after]
        here = [c + int(self.one_cost[after, symbol]) for c in self.vectors[self.one[after, symbol]]]
        letters = ""
        while True:
            if here[state] == 3 + later[state]:
                return letters + "D", state
            if here[state] == 2 + here[DUE[state]]:
                letters, state = letters + "I", DUE[state]
                continue
            role, truncated = divmod(symbol, 2)
            kept = _kept(state, role)
            if kept is not None and here[state] == truncated + later[kept]:
                return letters + "K", kept
            return letters + "R", DUE[state]


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


@lru_cache(maxsize=1 << 16)
def _expanded(after: int, code: int, state: int) -> tuple[str, int]:
    """Letters and last state of a block, from the vector after it."""
    t = tables()
    symbols = [code // SYMBOLS**i % SYMBOLS for i in range(BLOCK)]  # the last one first
    behind = [after]
    for s in symbols[:-1]:
        behind.append(int(t.one[behind[-1], s]))
    letters = ""
    for s, v in zip(reversed(symbols), reversed(behind), strict=True):
        got, state = t.edits[v][s][state]
        letters += got
    return letters, state


def edits(symbols: bytes) -> tuple[str, int]:
    """(letters, cost) of the least string among the cheapest edits."""
    t = tables()
    head = len(symbols) % BLOCK  # turns before the first whole block
    codes = np.frombuffer(symbols, np.uint8, offset=head).astype(np.int64).reshape(-1, BLOCK) if len(symbols) > head else np.zeros((0, BLOCK), np.int64)
    codes = (codes @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()
    vector, cost, behind = 0, 0, [0] * len(codes)
    for i in range(len(codes) - 1, -1, -1):
        behind[i] = vector
        cost += int(t.block_cost[vector, codes[i]])
        vector = int(t.block[vector, codes[i]])
    first = [0] * head
    for i in range(head - 1, -1, -1):
        first[i] = vector
        cost += int(t.one_cost[vector, symbols[i]])
        vector = int(t.one[vector, symbols[i]])
    cost += t.vectors[vector][START]
    state, out = START, []
    for i in range(head):
        got, state = t.edits[first[i]][symbols[i]][state]
        out.append(got)
    for code, after in zip(codes, behind, strict=True):
        got, state = _expanded(after, code, state)
        out.append(got)
    out.append("I" * (END[state] // 2))
    return "".join(out), cost


def repaired(letters: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of the turns that stand after the edits."""
    state = START
    for letter in letters:
        if letter == "I":
            state = DUE[state]
            yield letter, ROLE[state], ""
            continue
        role, text = next(turns)
        if letter == "K":
            state = CLASSES[role[0]]
            yield letter, role, text
        elif letter == "R":
            state = DUE[state]
            yield letter, ROLE[state], text


def _flaw(text: str) -> str:
    """'blank', 'truncated' or '' of a text by itself."""
    end = text.rstrip(SPACE)[-1:]
    return "blank" if not end else "" if end in ".!?" else "truncated"


class Shape:
    """What is counted over a conversation's turns, one after the other."""

    def __init__(self) -> None:
        self.symbols = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.numbers = 0
        self.low = self.high = self.last = None

    def add(self, turn: int | None, initial: str, flaw: str, seen: bool) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.numbers = turn, self.numbers + 1
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if flaw == "blank":
            self.blank += 1
        elif seen:
            self.duplicate += 1
        elif flaw:
            self.truncated += 1
        self.symbols.append(GO if flaw == "blank" or seen else 2 * CLASSES.get(initial, 0) + bool(flaw))

    def counts(self) -> dict[str, int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.numbers
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPORT = ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"


class Digest:
    def __init__(self) -> None:
        self.sha, self.glue = hashlib.sha256(), b""

    def add(self, role: str, text: str) -> None:
        self.sha.update(self.glue + f"{role}:{text}".encode())
        self.glue = b"\n"


class Rows:
    """Rows gathered as columns and given out as batches."""

    def __init__(self, schema: pa.Schema, limit: int = 1 << 20):
        self.schema, self.limit = schema, limit
        self._empty()

    def _empty(self) -> None:
        self.columns, self.size = [[] for _ in self.schema], 0

    def add(self, values: dict, size: int = 100) -> None:
        for name, column in zip(self.schema.names, self.columns, strict=True):
            column.append(values.get(name))
        self.size += size

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.size >= self.limit:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
            self._empty()


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType([df.schema["conv"], *StructType.fromDDL(ddl).fields]))


def _first_pass(rows: DataFrame, texts: bool) -> DataFrame:
    """Sorted turns in; reports of whole conversations (``kind`` 0), their repaired turns with ``texts`` (1), and turns of
    conversations that may go on elsewhere (2) out."""
    kind = rows.schema["conv"].dataType.simpleString()
    ddl = f"kind int, part int, seq bigint, present boolean, turn bigint, role string, text string, letter string, {REPORT}"
    schema = _arrow(rows, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out = TaskContext.get().partitionId(), 0, Rows(schema)
        held: list[tuple] = []
        conv, started, opened = None, False, True

        def give_up() -> None:
            """The held turns are left to the second pass."""
            nonlocal seq
            for present, turn, role, text in held:
                out.add({"conv": conv, "kind": 2, "part": part, "seq": seq, "present": present, "turn": turn, "role": role, "text": text}, 60 + len(text))
                seq += 1
            held.clear()

        def finish() -> None:
            shape, seen, said = Shape(), set(), []
            for present, turn, role, text in held:
                if present:
                    shape.add(turn, role[:1], _flaw(text), (role, text) in seen)
                    seen.add((role, text))
                    said.append((role, text))
            letters, cost = edits(bytes(shape.symbols))
            digest = Digest()
            for i, (letter, role, text) in enumerate(repaired(letters, iter(said))):
                digest.add(role, text)
                if texts:
                    out.add({"conv": conv, "kind": 1, "part": 0, "seq": i, "role": role, "text": text, "letter": letter}, 60 + len(text))
            out.add({"conv": conv, "kind": 0, **shape.counts(), "cost": cost, "audit": letters, "repaired_sha256": digest.sha.hexdigest()}, 200 + len(letters))
            held.clear()

        for batch in pieces(batches, "text"):
            columns = [batch.column(c).to_pylist() for c in ("conv", "present", "turn", "role", "text")]
            for other, present, turn, role, text in zip(*columns, strict=True):
                if started and other != conv:
                    give_up() if opened else finish()
                    opened = False
                    yield from out.full()
                conv, started = other, True
                held.append((present, turn, role, text))
                if len(held) >= HELD or opened:
                    opened = True
                    give_up()
                    yield from out.full()
        give_up()
        yield from out.rest()

    return rows.mapInArrow(run, f"conv {kind}, {ddl}")


def _marked(opened: DataFrame) -> DataFrame:
    """Turns without texts: first letter of the role, flaw, and whether an earlier turn has the same role and text."""
    who = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    same = F.sha2(F.concat_ws(":", F.length(who).cast("string"), F.length("role").cast("string"), who, "role", "text"), 256)
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    flaw = F.when(end == "", "blank").when(end.isin(".", "!", "?"), "").otherwise("truncated")
    turns = opened.select("conv", "part", "seq", "present", "turn", F.substring("role", 1, 1).alias("initial"), flaw.alias("flaw"), same.alias("same"))
    firsts = turns.filter("present").groupBy("same").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    seen = F.coalesce(F.struct("part", "seq") > F.col("first"), F.lit(False))
    return turns.join(firsts, "same", "left").select("conv", "part", "seq", "present", "turn", "initial", "flaw", seen.alias("seen"))


def _by_conversation(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", "part", "seq")


def _folded(marked: DataFrame) -> DataFrame:
    """The report of each conversation, without its digest."""
    kind = marked.schema["conv"].dataType.simpleString()
    schema = _arrow(marked, REPORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, shape = Rows(schema), None, None

        def finish() -> None:
            letters, cost = edits(bytes(shape.symbols))
            out.add({"conv": conv, **shape.counts(), "cost": cost, "audit": letters}, 200 + len(letters))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "present", "turn", "initial", "flaw", "seen")]
            for other, present, turn, initial, flaw, seen in zip(*columns, strict=True):
                if shape is None or other != conv:
                    if shape is not None:
                        finish()
                    conv, shape = other, Shape()
                    yield from out.full()
                if present:
                    shape.add(turn, initial, flaw, seen)
        if shape is not None:
            finish()
        yield from out.rest()

    return _by_conversation(marked).mapInArrow(run, f"conv {kind}, {REPORT}")


def _second_pass(opened: DataFrame, reports: DataFrame, texts: bool) -> DataFrame:
    """Texts streamed after the report of their conversation, which sorts first."""
    kind = opened.schema["conv"].dataType.simpleString()
    turns = opened.filter("present").select("conv", "part", "seq", "role", "text")
    rows = turns.unionByName(reports.withColumns({"part": F.lit(-1), "seq": F.lit(0).cast("bigint")}), allowMissingColumns=True)
    ddl = f"kind int, part int, seq bigint, role string, text string, letter string, {REPORT}"
    schema = _arrow(opened, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, report, digest, place, state, n = Rows(schema), None, None, None, 0, START, 0

        def said(letter: str, role: str, text: str) -> None:
            nonlocal n
            digest.add(role, text)
            if texts:
                out.add({"conv": conv, "kind": 1, "part": 0, "seq": n, "role": role, "text": text, "letter": letter}, 60 + len(text))
            n += 1

        def insertions() -> None:
            nonlocal place, state
            letters = report["audit"]
            while place < len(letters) and letters[place] == "I":
                state, place = DUE[state], place + 1
                said("I", ROLE[state], "")

        def finish() -> None:
            insertions()
            out.add({"conv": conv, "kind": 0, **report, "repaired_sha256": digest.sha.hexdigest()}, 200 + len(report["audit"]))

        for batch in pieces(batches, "text"):
            columns = [batch.column(c).to_pylist() for c in ("conv", "part", "role", "text", "audit", *COUNTS)]
            for other, part, role, text, audit, *counts in zip(*columns, strict=True):
                if part < 0:
                    if report is not None:
                        finish()
                        yield from out.full()
                    conv, report, digest, place, state, n = other, {**dict(zip(COUNTS, counts, strict=True)), "audit": audit}, Digest(), 0, START, 0
                    continue
                insertions()
                letter, place = report["audit"][place], place + 1
                if letter != "D":
                    state = CLASSES[role[0]] if letter == "K" else DUE[state]
                    said(letter, role if letter == "K" else ROLE[state], text)
                    yield from out.full()
        if report is not None:
            finish()
        yield from out.rest()

    return _by_conversation(rows.select("conv", "part", "seq", "role", "text", "audit", *COUNTS)).mapInArrow(run, f"conv {kind}, {ddl}")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None, texts: bool = False) -> DataFrame:
    """One row per conversation: the counts, ``cost``, ``audit`` and the digest of the repaired turns; with ``texts``
    one row per repaired turn instead (conversation, ``place``, ``letter``, role, text).

    Rows for which ``present`` does not hold are no turns, but their conversation has a row in the result.
    """
    blank = F.lit(" ")
    here = F.coalesce(present, F.lit(False)) if present is not None else F.lit(True)
    rows = turns.select(
        F.col(conv).alias("conv"), here.alias("present"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), blank).alias("role"), F.coalesce(F.col(text).cast("string"), blank).alias("text"))
    order = ["conv", "turn", "role"]
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text", "present")
    first = common.staged(_first_pass(dealt, texts), "turns")
    opened = first.filter("kind = 2").select("conv", "part", "seq", "present", "turn", "role", "text")
    second = _second_pass(opened, _folded(_marked(opened)), texts)
    both = first.filter(f"kind = {int(texts)}").select(*second.columns).unionByName(second.filter(f"kind = {int(texts)}"))
    if texts:
        return both.select(F.col("conv").alias(conv), F.col("seq").alias("place"), "letter", F.col("role").alias(role), F.col("text").alias(text))
    return both.select(F.col("conv").alias(conv), *COUNTS, "audit", "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with one fault in four rows, told by a checksum of conversation and number: absent, emptied, without stops, repeated, or said by the user."""
    blank = F.lit(" ")
    number = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(number) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    rows = turns.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault != 0).alias("present"), F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


#: crc32 by its table, then the edits from the last turn back: (cost, letters, repaired text) for each of the four states
SQL = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) r(i))),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(4294967295, list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS fault FROM conversations, tab),
dam AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM src WHERE fault <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM dam),
fl AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last_char,
  lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM num),
sym AS (SELECT *, CASE WHEN last_char = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM fl),
cnt AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM sym GROUP BY conv_id),
r AS (
  SELECT conv_id, n + 1 AS i, {'c': 0, 'a': '', 'o': ''} AS v0, {'c': 4, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'} AS v1,
    {'c': 2, 'a': 'I', 'o': chr(10) || 'assistant:'} AS v2, {'c': 0, 'a': '', 'o': ''} AS v3 FROM cnt
  UNION ALL
  SELECT conv_id, i, list_sort([b0, {'c': b2.c + 2, 'a': 'I' || b2.a, 'o': chr(10) || 'user:' || b2.o}, {'c': b3.c + 4, 'a': 'II' || b3.a, 'o': chr(10) || 'user:' || chr(10) || 'assistant:' || b3.o}])[1],
    list_sort([b1, {'c': b2.c + 2, 'a': 'I' || b2.a, 'o': chr(10) || 'user:' || b2.o}, {'c': b3.c + 4, 'a': 'II' || b3.a, 'o': chr(10) || 'user:' || chr(10) || 'assistant:' || b3.o}])[1],
    list_sort([b2, {'c': b3.c + 2, 'a': 'I' || b3.a, 'o': chr(10) || 'assistant:' || b3.o}])[1],
    list_sort([b3, {'c': b2.c + 2, 'a': 'I' || b2.a, 'o': chr(10) || 'user:' || b2.o}])[1]
  FROM (SELECT conv_id, i,
      list_sort([{'c': v0.c + 3, 'a': 'D' || v0.a, 'o': v0.o}, {'c': v2.c + 2 + t, 'a': 'R' || v2.a, 'o': chr(10) || 'user:' || text || v2.o},
        CASE k WHEN 's' THEN {'c': v1.c + t, 'a': 'K' || v1.a, 'o': chr(10) || role || ':' || text || v1.o} WHEN 'u' THEN {'c': v2.c + t, 'a': 'K' || v2.a, 'o': chr(10) || role || ':' || text || v2.o} ELSE {'c': 999999, 'a': '', 'o': ''} END])[1] AS b0,
      list_sort([{'c': v1.c + 3, 'a': 'D' || v1.a, 'o': v1.o}, {'c': v2.c + 2 + t, 'a': 'R' || v2.a, 'o': chr(10) || 'user:' || text || v2.o},
        CASE k WHEN 'u' THEN {'c': v2.c + t, 'a': 'K' || v2.a, 'o': chr(10) || role || ':' || text || v2.o} ELSE {'c': 999999, 'a': '', 'o': ''} END])[1] AS b1,
      list_sort([{'c': v2.c + 3, 'a': 'D' || v2.a, 'o': v2.o}, {'c': v3.c + 2 + t, 'a': 'R' || v3.a, 'o': chr(10) || 'assistant:' || text || v3.o},
        CASE k WHEN 'a' THEN {'c': v3.c + t, 'a': 'K' || v3.a, 'o': chr(10) || role || ':' || text || v3.o} ELSE {'c': 999999, 'a': '', 'o': ''} END])[1] AS b2,
      list_sort([{'c': v3.c + 3, 'a': 'D' || v3.a, 'o': v3.o}, {'c': v2.c + 2 + t, 'a': 'R' || v2.a, 'o': chr(10) || 'user:' || text || v2.o},
        CASE k WHEN 'u' THEN {'c': v2.c + t, 'a': 'K' || v2.a, 'o': chr(10) || role || ':' || text || v2.o} ELSE {'c': 999999, 'a': '', 'o': ''} END])[1] AS b3
    FROM (SELECT r.*, sym.role, sym.text, left(sym.role, 1) AS k, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t
      FROM r JOIN sym ON r.conv_id IS NOT DISTINCT FROM sym.conv_id AND sym.i = r.i - 1) x(conv_id, i_after, v0, v1, v2, v3, role, text, k, t), LATERAL (SELECT i_after - 1 AS i))),
fin AS (SELECT conv_id, v0 FROM r WHERE i = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(v0.o[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@common.query("op12_conversation_repair", SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged(common.table(spark, sf_dir, "conversations"))
    out = repair(turns, present=F.col("present"))
    return out.select("conv_id", *(c for c in COUNTS if c != "cost"), "cost", "audit", "repaired_sha256")
