"""Repairing the structure of conversations by generalised LR parsing with weighted edits.

The roles of a conversation, known by their initials, must form an optional system row and then pairs of
user and assistant rows, or nothing. An LR table of that grammar is run over a conversation's rows with a
graph-structured stack: a row may be kept, given another role, or deleted, and empty rows may be inserted
before and after it, each at its cost. Where two ways lead to the same stack top they are merged, and the one
with the smaller (cost, audit) stays; the audit is the string of edit initials (K, R, D, I).

On Spark, rows that are equal are counted first (a map-side combine), then all rows are sorted by range of
(conversation, turn, role, text hash), so that a hot conversation is cut over as many tasks as its size asks
for. A task reads its rows as a stream, in segments of at most ``SEGMENT_ROWS`` rows and ``SEGMENT_BYTES``
bytes of text. Most conversations lie in one segment and are repaired there. Of the others, a segment is
parsed once from every stack top and yields the cheapest edits from each top to each other; these are
composed in order (a conversation's segments pass as a stream of small rows), and every segment then applies the edits that
were chosen for it. So no task ever holds a conversation, and the results do not depend on where it is cut.

Faults: a row is blank (no character but white space), a duplicate (role and text seen earlier in the
conversation) or truncated (its last character but white space is none of ``.!?``); the first that holds counts.
Blank rows and duplicates must be deleted. Rows with the same turn are ordered by role, then by the hash of
role and text. Nulls: a null role or text counts as one blank, null turns come first, null conversation ids are one
conversation. An empty role fits nowhere and is never kept. Texts are used whole; other columns are not read, whatever their names.
An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.llm.rows import small_batches
from tidewatch.session import materialise

COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
#: Rows (deletions of equal rows included) and bytes of text in one segment.
SEGMENT_ROWS = 512
SEGMENT_BYTES = 4 << 20

# The LR table. States are named by what lies on top of the stack: nothing, a system row, a user row, a whole pair
# that is not reduced yet, and the pairs so far. A shift on "pair" is always reduced at once.
START, SYSTEM, USER, PAIR, PAIRS = range(5)
SHIFT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (PAIRS, "u"): USER, (USER, "a"): PAIR}
GOTO = {START: PAIRS, SYSTEM: PAIRS}
TOPS = (START, SYSTEM, USER, PAIRS)
ACCEPTS = (START, PAIRS)
#: The stacks a segment may start from, below their tops; pairs rest on what came before them, user rows likewise.
BELOW = {START: (), SYSTEM: (START,), USER: (START,), PAIRS: (START,)}
LEGAL = ("su", "ua", "au")


class Node(NamedTuple):
    """A stack: its top, and the node below."""

    top: int
    below: Node | None


class Way(NamedTuple):
    """The cheapest edits that lead to a stack."""

    cost: int
    audit: str
    stack: Node


def shift(stack: Node, letter: str) -> Node | None:
    """The stack after reading a role, with all reductions done; nothing if the grammar does not allow it."""
    top = SHIFT.get((stack.top, letter))
    if top is None:
        return None
    if top != PAIR:
        return Node(top, stack)
    base = stack.below  # pair -> user assistant: both are popped
    if base.top == PAIRS:  # pairs -> pairs pair
        base = base.below
    return Node(GOTO[base.top], base)


def merge(tops: dict[int, Way], way: Way) -> bool:
    """Put a way among the stack tops; of two with one top the smaller (cost, audit) stays."""
    old = tops.get(way.stack.top)
    if old is not None and (old.cost, old.audit) <= (way.cost, way.audit):
        return False
    tops[way.stack.top] = way
    return True


def inserted(tops: dict[int, Way]) -> dict[int, Way]:
    """Every top that insertions reach."""
    open_tops = list(tops)
    while open_tops:
        way = tops[open_tops.pop()]
        for letter in "ua":
            stack = shift(way.stack, letter)
            if stack is not None and merge(tops, Way(way.cost + COST["I"], way.audit + "I", stack)):
                open_tops.append(stack.top)
    return tops


def step(tops: dict[int, Way], letter: str, truncated: bool) -> dict[int, Way]:
    """All tops after one row that may stay."""
    out: dict[int, Way] = {}
    more = TRUNCATED if truncated else 0
    for way in tops.values():
        merge(out, Way(way.cost + COST["D"], way.audit + "D", way.stack))
        for edit, role in (("K", letter), ("R", "u"), ("R", "a")):
            stack = shift(way.stack, role)
            if stack is not None:
                merge(out, Way(way.cost + COST[edit] + more, way.audit + edit, stack))
    return inserted(out)


def deleted(tops: dict[int, Way], n: int) -> dict[int, Way]:
    """All tops after ``n`` rows that must go. Insertions between them would only make the audit greater."""
    return inserted({top: Way(w.cost + n * COST["D"], w.audit + "D" * n, w.stack) for top, w in tops.items()})


def stack_of(top: int) -> Node:
    node = None
    for state in (*BELOW[top], top):
        node = Node(state, node)
    return node


def parse(rows: list[dict], entry: int, first: bool) -> dict[int, Way]:
    """The cheapest way from one stack top over a segment's rows to every other. Insertions before a row belong to the
    segment of the row before it, so that only the ``first`` segment of a conversation may begin with them."""
    tops = {entry: Way(0, "", stack_of(entry))}
    if first:
        inserted(tops)
    for row in rows:
        if row["stays"]:
            tops = step(tops, row["letter"], row["truncated"])
        if row["deletes"]:
            tops = deleted(tops, row["deletes"])
    return tops


def apply(rows: list[dict], entry: int, audit: str) -> list[dict[str, str]]:
    """The rows (role, text) that a segment's edits leave."""
    out = []
    stack = stack_of(entry)
    edits = iter(audit)

    def put(role: str, text: str) -> None:
        nonlocal stack
        stack = shift(stack, role[0])
        out.append({"role": role, "text": text})

    def wanted() -> str:
        return "assistant" if stack.top == USER else "user"

    def until_row() -> str:
        for edit in edits:
            if edit != "I":
                return edit
            put(wanted(), "")
        return ""

    for row in rows:
        for i in range(row["stays"] + row["deletes"]):
            edit = until_row()
            if edit == "K":
                put(row["role"], row["text"])
            elif edit == "R":
                put(wanted(), row["text"])
    until_row()
    return out


def faulty_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, h1, h2, n): the distinct rows with their number. Nulls in role and text are one blank."""
    blank = F.lit(" ")
    return (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
        .groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
        .select("*", *_hashes()))


def _hashes() -> list:
    return [F.xxhash64(F.lit(k), "role", "text").alias(f"h{k}") for k in (1, 2)]


def later_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h1, h2) of rows whose role and text stood in an earlier turn of the conversation."""
    blank = F.lit(" ")
    narrow = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")
    ).select("conv_id", "turn", "role", *_hashes()).distinct()
    place = F.struct(F.col("turn").isNotNull().alias("later"), F.col("turn"))
    again = narrow.groupBy("conv_id", "role", "h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    a, b = narrow.alias("a"), again.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
    for c in ("role", "h1", "h2"):
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, same).filter("NOT (a.turn <=> first.turn)").select("a.*")


ROW = "struct<role:string,text:string,letter:string,truncated:boolean,stays:int,deletes:int>"
CELL = "struct<entry:int,leave:int,cost:long,audit:string>"
SEGMENT = (f"conv_id long, part int, segment int, whole boolean, blank long, duplicate long, truncated long, illegal long, "
           f"head string, tail string, cells array<{CELL}>, rows array<{ROW}>")
WHITE = " \t\n\v\f\r"


def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The sorted rows; a marker comes before its row and makes it a later one."""
    marked = None
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["conv_id"], row["turn"], row["role"], row["h1"], row["h2"])
            if row["n"] == 0:
                marked = key
                continue
            row["later"] = key == marked
            yield row


def judged(row: dict) -> tuple[dict, dict[str, int]]:
    """What the parser needs of a row with its equals, and how many faults of each kind they have."""
    body, n = row["text"].strip(WHITE), row["n"]
    short = bool(body) and body[-1] not in ".!?"
    stays = int(bool(body) and not row["later"])
    faults = {"blank": 0 if body else n, "duplicate": n - stays if body else 0, "truncated": int(stays and short)}
    parsed = {"role": row["role"], "text": row["text"] if stays else "", "letter": row["role"][:1], "truncated": short,
              "stays": stays, "deletes": n - stays}
    return parsed, faults


class Segment:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv_id, number: int):
        self.conv_id, self.number = conv_id, number
        self.rows: list[dict] = []
        self.size = self.bytes = 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.head = self.tail = None

    def add(self, parsed: dict, faults: dict[str, int], n: int) -> None:
        letter = parsed["letter"]
        pairs = (n - 1) * (letter * 2 not in LEGAL) if n else 0
        if self.tail is None:
            self.head = letter
        else:
            pairs += self.tail + letter not in LEGAL
        self.tail = letter
        self.counts["illegal"] += pairs
        for kind, count in faults.items():
            self.counts[kind] += count
        self.rows.append(parsed)
        self.size += n
        self.bytes += len(parsed["text"])

    def record(self, part: int, whole: bool) -> dict:
        cells = []
        for entry in (START,) if whole else TOPS:
            ways = parse(self.rows, entry, whole)
            if whole:
                best = min((ways[t] for t in ACCEPTS if t in ways), key=lambda w: (w.cost, w.audit))
                ways = {best.stack.top: best}
            cells += [{"entry": entry, "leave": t, "cost": w.cost, "audit": w.audit} for t, w in sorted(ways.items())]
        return {"conv_id": self.conv_id, "part": part, "segment": self.number, "whole": whole, **self.counts,
                "head": self.head, "tail": self.tail, "cells": cells, "rows": self.rows}


def cut_segments(rows: Iterator[dict], part: int, most: int = SEGMENT_ROWS) -> Iterator[dict]:
    """The segments of a task's rows. A conversation is whole if the task has all of it in one segment: then it is
    neither the first nor the last one of the task."""
    open_segment: Segment | None = None
    conversations = 0

    def closed(ends: bool) -> dict:
        number = open_segment.number
        # A conversation at the start or the end of the task may go on in the neighbouring one.
        whole = ends and number == 0 and conversations > 1
        return open_segment.record(part, whole)

    for row in rows:
        parsed, faults = judged(row)
        if open_segment is not None and open_segment.conv_id != row["conv_id"]:
            yield closed(True)
            open_segment = None
        if open_segment is None:
            conversations += 1
            open_segment = Segment(row["conv_id"], 0)
        n = row["n"]
        while True:
            if open_segment.size >= most or open_segment.bytes >= SEGMENT_BYTES:
                yield closed(False)
                open_segment = Segment(row["conv_id"], open_segment.number + 1)
            now = min(n, most - open_segment.size)
            open_segment.add({**parsed, "deletes": now - parsed["stays"]}, faults, now)
            n -= now
            if not n:
                break
            parsed, faults = {**parsed, "text": "", "stays": 0}, {}
    if open_segment is not None:
        yield closed(False)


def segments(turns: DataFrame, most: int = SEGMENT_ROWS) -> DataFrame:
    """The stored segments of all conversations, with the cheapest edits from stack top to stack top."""
    order = ["conv_id", "turn", "role", "h1", "h2", "n"]
    markers = later_rows(turns).select("conv_id", "turn", "role", F.lit(None).cast("string").alias("text"), "h1", "h2", F.lit(0).cast("long").alias("n"))
    rows = faulty_rows(turns).select("conv_id", "turn", "role", "text", "h1", "h2", "n").unionByName(markers)
    # A row and its marker have equal keys up to the last, so they come to the same task; nulls come first.
    spread = rows.repartitionByRange(*order[:-1]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        held = 0
        for record in cut_segments(read_rows(batches), part, most):
            out.append(record)
            held += sum(len(r["text"]) for r in record["rows"]) + sum(len(c["audit"]) for c in record["cells"]) + 100
            if held > SEGMENT_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    kind = arrow_schema(SEGMENT)
    small_batches(turns.sparkSession)
    return materialise(spread.mapInArrow(run, SEGMENT), "segments")


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


class Chain(NamedTuple):
    """Edits up to a segment, as a linked list of the segments' audits."""

    before: Chain | None
    audit: str
    entry: int
    depth: int


def letters_after(a: Chain | None, b: Chain | None) -> tuple[str, str]:
    """The audits of two chains from where they part."""
    x: list[str] = []
    y: list[str] = []
    while a is not b:
        # Both chains have one link for each segment, so they stay level.
        x.append(a.audit)
        y.append(b.audit)
        a, b = a.before, b.before
    return "".join(reversed(x)), "".join(reversed(y))


def follow(state: dict[int, tuple[int, Chain | None]], cells: list[dict]) -> dict[int, tuple[int, Chain | None]]:
    """The cheapest chains to every stack top after one more segment."""
    out: dict[int, tuple[int, Chain | None]] = {}
    for cell in cells:
        if cell["entry"] not in state:
            continue
        cost, before = state[cell["entry"]]
        new = (cost + cell["cost"], Chain(before, cell["audit"], cell["entry"], before.depth + 1 if before else 1))
        old = out.get(cell["leave"])
        if old is None or _smaller(new, old):
            out[cell["leave"]] = new
    return out


def _smaller(new: tuple[int, Chain], old: tuple[int, Chain]) -> bool:
    if new[0] != old[0]:
        return new[0] < old[0]
    x, y = letters_after(new[1], old[1])
    return x < y


CHOSEN = "conv_id long, part int, segment int, entry int, audit string, cost long, illegal long"


def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The edits chosen for each segment of the conversations in a sorted stream of segments."""
    conv: tuple | None = None
    state: dict[int, tuple[int, Chain | None]] = {}
    places: list[tuple[int, int]] = []
    illegal, tail = 0, None

    def finish() -> list[dict]:
        ends = [state[t] for t in ACCEPTS if t in state]
        best = min(ends, key=cmp_to_key(lambda a, b: -1 if _smaller(a, b) else 1))
        out = []
        link = best[1]
        for part, segment in reversed(places):
            out.append({"conv_id": conv[0], "part": part, "segment": segment, "entry": link.entry, "audit": link.audit, "cost": 0, "illegal": 0})
            link = link.before
        out[-1].update(cost=best[0], illegal=illegal, entry=START, audit=link.audit + out[-1]["audit"])
        return out[::-1]

    for batch in batches:
        for row in batch.to_pylist():
            if conv != (row["conv_id"],):
                if conv is not None:
                    yield finish()
                conv, places, illegal, tail = (row["conv_id"],), [], 0, None
                # Insertions before the first row.
                state = {t: (w.cost, Chain(None, w.audit, START, 0)) for t, w in inserted({START: Way(0, "", stack_of(START))}).items()}
            state = follow(state, row["cells"])
            places.append((row["part"], row["segment"]))
            illegal += row["illegal"] + (tail is not None and tail + row["head"] not in LEGAL)
            tail = row["tail"]
    if conv is not None:
        yield finish()


def _streamed(table: DataFrame, make, schema: str) -> DataFrame:
    """Rows made from the segments of a conversation in order. A conversation's segments come to one task as a stream."""
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in make(batches):
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    ordered = table.repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment")
    return ordered.mapInArrow(run, schema)


REPAIRED = (f"conv_id long, part int, segment int, whole boolean, blank long, duplicate long, truncated long, illegal long, cost long, "
            "audit string, turns array<struct<role:string,text:string>>")


class Repaired(NamedTuple):
    """Repaired conversations: those that lie in one segment, and those that are cut in several."""

    whole: DataFrame
    cut: DataFrame

    def pieces(self) -> DataFrame:
        return self.whole.unionByName(self.cut)


def repair(turns: DataFrame, segment_rows: int = SEGMENT_ROWS) -> Repaired:
    """The repaired conversations of ``turns`` (conv_id, turn, role, text), a row for each segment.

    (conv_id, part, segment: the order of a conversation's segments, whole: whether there is only one, blank, duplicate,
    truncated, illegal, cost, audit: sums and edits of the segment, turns: the rows that the edits leave).
    """
    stored = segments(turns, segment_rows)
    small_batches(turns.sparkSession)
    kept = ["conv_id", "part", "segment", "whole", "blank", "duplicate", "truncated"]
    only = stored.filter("whole").select(
        *kept, "rows", "illegal", F.col("cells")[0].entry.alias("entry"), F.col("cells")[0].audit.alias("audit"), F.col("cells")[0].cost.alias("cost"))
    cut = stored.filter("NOT whole")
    chosen = materialise(
        _streamed(cut.select("conv_id", "part", "segment", "illegal", "head", "tail", "cells"), compose, CHOSEN), "chosen")
    a, b = cut.select(*kept, "rows").alias("a"), chosen.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.segment") == F.col("b.segment"))
    put_together = a.join(b, same).select("a.*", "b.illegal", "b.entry", "b.audit", "b.cost")
    kind = arrow_schema(REPAIRED)
    names = kind.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [{**{c: r[c] for c in names}, "turns": apply(r["rows"], r["entry"], r["audit"])} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(made, schema=kind)

    return Repaired(only.mapInArrow(run, REPAIRED), put_together.mapInArrow(run, REPAIRED))


def repaired_turns(found: Repaired) -> DataFrame:
    """(conv_id, part, segment, position, role, text): the repaired rows one by one, ordered by these columns."""
    return found.pieces().select("conv_id", "part", "segment", F.posexplode("turns").alias("position", "t")).select(
        "conv_id", "part", "segment", "position", "t.role", "t.text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The SHA-256 of each conversation whose pieces of text come in order."""
    conv, made, begun = None, None, False
    for batch in batches:
        for row in batch.to_pylist():
            if conv != (row["conv_id"],):
                if conv is not None:
                    yield [{"conv_id": conv[0], "repaired_sha256": made.hexdigest()}]
                conv, made, begun = (row["conv_id"],), hashlib.sha256(), False
            if row["n"]:
                made.update((b"\n" if begun else b"") + row["lines"].encode())
                begun = True
    if conv is not None:
        yield [{"conv_id": conv[0], "repaired_sha256": made.hexdigest()}]


def report(found: Repaired) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation.

    The digest of ``role:text`` lines takes a conversation's whole text in order, so that of a conversation in many
    segments passes one task, as a stream of one row for each segment. Nothing but digest and audit is kept of it.
    """
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    only = found.whole.withColumn("lines", lines).select("conv_id", *counts, "audit", F.sha2(F.col("lines").cast("binary"), 256).alias("repaired_sha256"))
    cut = found.cut.withColumn("lines", lines).select("conv_id", "part", "segment", F.size("turns").alias("n"), "lines", *counts, "audit")
    digests = _streamed(cut.select("conv_id", "part", "segment", "n", "lines"), _digests, "conv_id long, repaired_sha256 string")
    audits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "segment", "audit"))), lambda x: x.audit), "")
    sums = cut.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts], audits.alias("audit"))
    a, b = sums.alias("a"), digests.alias("b")
    return only.unionByName(a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select("a.*", "b.repaired_sha256"))


# Damage, to try the repair on: what happens to a row follows from a checksum of its conversation and turn.

DROP, EMPTY, UNSTOP, REPEAT, USURP = range(5)


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text; nulls in role and text one blank) after the damage that
    crc32(``conv_id:turn``) modulo 20 names: 0 the row goes, 1 its text is emptied, 2 it loses all ``.!?``,
    3 it stands twice, 4 its role becomes user. Ids and turns that are null count as one blank."""
    def name(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.col("kind")
    text = F.coalesce("text", F.lit(" "))
    return (
        turns.withColumn("kind", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20)
        .filter(kind != DROP)
        .select("conv_id", "turn", F.when(kind == USURP, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
                F.when(kind == EMPTY, F.lit("")).when(kind == UNSTOP, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                F.explode(F.when(kind == REPEAT, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
        .drop("copy")
    )


def turn_gaps(original: DataFrame, left: DataFrame) -> DataFrame:
    """(conv_id, gaps) for every conversation of ``original``: how many turns are missing between the first and the last
    turn of ``left``; null if that does not fit a long. Turns are made distinct before they are counted, so a hot conversation is spread over tasks."""
    here = left.select("conv_id", "turn", F.lit(True).alias("stays")).unionByName(
        original.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(False).alias("stays"))).distinct()
    turn = F.col("turn").cast("decimal(38,0)")
    gap = F.max(turn) - F.min(turn) + 1 - F.count("turn")
    return here.groupBy("conv_id").agg(F.coalesce(gap, F.lit(0)).try_cast("long").alias("gaps"))
