"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash

from tests.llm import cases
from tidewatch.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def spoiled(rows):
    """The damage of the contract, in plain Python; rows with one turn are ordered by role only where that settles it."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for turns in out.values():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], spark_hash(r[1], r[2])))
    return out


def spark_hash(role, text):
    """The order of rows that agree in turn and role: chained XXH64 over 1, role, text as Spark computes it."""
    seed = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)
    for part in (role, text):
        seed = xxhash.xxh64_intdigest(part.encode(), seed)
    return signed(seed)


def searched(turns):
    """(cost, audit, rows) of the cheapest edits, ties by the audit: uniform-cost search over (row, roles so far)."""
    seen, kinds = set(), []
    for _, role, text in turns:
        body = text.strip(" \t\n\v\f\r")
        if not body:
            kinds.append("blank")
        elif (role, text) in seen:
            kinds.append("duplicate")
        else:
            kinds.append("truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, rows = heapq.heappop(heap)
        if i == len(turns) and GOOD.fullmatch("".join(r[0][0] for r in rows)):
            # Only the smallest of all equally cheap audits is popped first.
            return cost, audit, rows, kinds
        # What can still follow depends on the first role and on the last one alone.
        if (i, state) in done:
            continue
        done.add((i, state))

        def push(more, edit, at, row=None):
            new = rows + ((row,) if row else ())
            letters = "".join(r[0][:1] or "?" for r in new)
            if not re.fullmatch("s?(ua)*u?", letters):
                return
            name = "" if not letters else "s" if letters == "s" else letters[-1]
            heapq.heappush(heap, (cost + more, audit + edit, at, name, new))

        for role in ("user", "assistant"):
            push(5, "I", i, (role, ""))
        if i < len(turns):
            _, role, text = turns[i]
            push(2, "D", i + 1)
            if kinds[i] not in ("blank", "duplicate"):
                extra = 5 if kinds[i] == "truncated" else 0
                if role:
                    push(extra, "K", i + 1, (role, text))
                for other in ("user", "assistant"):
                    push(1 + extra, "R", i + 1, (other, text))


def expected(rows):
    out = {}
    for conv, turns in spoiled(rows).items():
        known = {t for t, _, _ in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        cost, audit, kept, kinds = searched(turns)
        letters = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def run(spark, monkeypatch, rows):
    monkeypatch.setattr(queries, "table", lambda *_: spark.createDataFrame(rows, SCHEMA))
    got = queries.op11_conversations(spark, "")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    table = [tuple(r) for r in got.collect()]
    assert len(table) == len({r[0] for r in table})
    return {r[0]: r[1:] for r in table}


def random_rows(rng, conversations_, most):
    texts = ["Hello.", "Is it?", "cut off", "cut off,", "", " \n", "Yes!", "éa ☃", "no. ", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "umpire"]
    return [
        (None if c == 0 else c, rng.choice([None, t, t, t, t + 1, t * 3]), rng.choice(roles), rng.choice(texts))
        for c in range(conversations_) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("size", [512, 3])
def test_against_a_search_over_all_edits(spark, monkeypatch, size):
    """Also with segments of three rows: the result must not depend on where a conversation is cut."""
    rows = random_rows(random.Random(size), 150, 9)
    monkeypatch.setattr(conversations.repair, "__defaults__", (size,))
    assert run(spark, monkeypatch, rows) == expected(rows)


def test_given_conversations(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op11_conversations(spark, folder).collect()}
    assert got == expected(rows)


def test_a_hot_conversation(spark, monkeypatch):
    """One conversation holds most rows, many of them equal; it is cut over tasks and segments."""
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Same again.", f"Text {t}.", f"text {t}"])) for t in range(900)]
    rows += [(7, 5, "user", "Copy.")] * 400 + random_rows(rng, 20, 5)
    monkeypatch.setattr(conversations.repair, "__defaults__", (64,))
    pieces = conversations.repair(conversations.damage(spark.createDataFrame(rows, SCHEMA)))
    sizes = [r[0] for r in pieces.pieces().selectExpr("length(audit)").collect()]
    assert max(sizes) <= 64 + 2 * 64 and sum(s > 30 for s in sizes) > 10
    assert run(spark, monkeypatch, rows) == expected(rows)


def test_all_rows_dropped_and_empty(spark, monkeypatch):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert run(spark, monkeypatch, [(gone, 0, "user", "Gone.")]) == {gone: none}
    assert run(spark, monkeypatch, []) == {}


def test_awkward_columns_and_long_texts(spark):
    """Clashing names are not read; a very long text is one row; extreme turns do not overflow."""
    df = spark.createDataFrame(
        [(1, 0, "user", cases.LONG + ".", 9, "x"), (1, 1, "assistant", "Fine.", 9, "y"), (2, -(2**63), "user", "A.", 1, "z"),
         (2, 2**63 - 1, "assistant", "B.", 1, "z")],
        SCHEMA + ", cost long, audit string")
    told = {r.conv_id: r for r in conversations.report(conversations.repair(df)).collect()}
    assert (told[1].audit, told[2].audit, told[1].cost) == ("KK", "KK", 0)
    assert told[1].repaired_sha256 == hashlib.sha256(f"user:{cases.LONG}.\nassistant:Fine.".encode()).hexdigest()
    kept = conversations.repaired_turns(conversations.repair(df)).filter("conv_id = 1").orderBy("part", "segment", "position").collect()
    assert [(r.role, len(r.text)) for r in kept] == [("user", len(cases.LONG) + 1), ("assistant", 5)]
    assert {r.conv_id: r.gaps for r in conversations.turn_gaps(df, df).collect()} == {1: 0, 2: None}
