"""Conversation repair and prefix tries against plain Python: nulls, ties, repeats, empty tables, small segments and shards."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import conversation_repair as repair
from tracewright.llm import prefix_trie as tries

SCHEMA = "conv_id long, turn long, role string, text string, digest string, segment long, n int"
rng = random.Random(11)
ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
TEXTS = ["Yes.", "No!", "why", "", " \t", None, "Is it? ", "é.", "x" * 40_000 + "."]
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def rows_of(conversations, longest):
    out = []
    for c in [*range(conversations), None]:
        for t in range(rng.randrange(longest)):
            out.append((c, None if rng.random() < 0.1 else t + (t > 3), rng.choice(ROLES), rng.choice(TEXTS) if rng.random() < 0.5 else f"text {rng.randrange(99)}{rng.choice('.!? ')}", "d", 1, 1))
    return out


ROWS = rows_of(60, 12)
ROWS += ROWS[:9]


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def space(value):
    return " " if value is None else str(value)


def damaged(rows):
    for c, t, role, text, *_ in rows:
        fate, role, text = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20, space(role), space(text)
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            yield from [(c, t, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)


def order(row):
    c, t, role, text = row
    return t is not None, t or 0, hashlib.sha256(f"{'none' if c is None else c}:{len(role)}:{role}{text}".encode()).digest()


def cheapest(rows):
    """By Dijkstra's search over (rows read, last initial), the audit breaking ties."""
    rows, seen, faults = sorted(rows, key=order), set(), []
    for _, _, role, text in rows:
        shown = VISIBLE.findall(text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    report = {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
    report["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    report["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return report | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
        follow = {"": "us", "s": "u", "u": "a", "a": "u"}[last]
        new = "user" if "u" in follow else "assistant"
        heapq.heappush(heap, (cost + 2, audit + "I", i, new[0], (*lines, new + ":")))
        if i < len(rows):
            role, text, extra = rows[i][2], rows[i][3], faults[i] == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
            if faults[i] in ("", "truncated"):
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, new[0], (*lines, f"{new}:{text}")))
                if role and role[0] in follow:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))


def expected(rows):
    by = defaultdict(list)
    for row in rows:
        by[row[0]] += damaged([row])
    return {c: cheapest(own) for c, own in by.items()}


@pytest.mark.parametrize("most", [2, 5, repair.SEGMENT])
def test_repairs_against_a_search(spark, conversations, tmp_path, monkeypatch, most):
    monkeypatch.setattr(repair, "load", lambda *_: conversations)
    monkeypatch.setattr(repair.repair, "__defaults__", (most,))
    got = {r["conv_id"]: r.asDict() for r in repair.op11_conversation_repair(spark, "").collect()}
    want = expected(ROWS)
    assert got.keys() == want.keys() and len(got) == len({r[0] for r in ROWS})
    for c, row in want.items():
        assert {k: got[c][k] for k in row} == row, c


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: r.asDict() for r in repair.op11_conversation_repair(spark, "/root/testdata/sf0.01").collect()}
    want = expected(rows)
    assert {c: {k: got[c][k] for k in row} for c, row in want.items()} == want


def test_no_rows_after_damage(spark, conversations, monkeypatch):
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    monkeypatch.setattr(repair, "load", lambda *_: spark.createDataFrame([(7, gone, "user", "Hi.")], "conv_id long, turn long, role string, text string"))
    (row,) = repair.op11_conversation_repair(spark, "").collect()
    assert row.asDict() == {k: 0 for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"conv_id": 7, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    monkeypatch.setattr(repair, "load", lambda *_: conversations.where("false"))
    assert repair.op11_conversation_repair(spark, "").count() == 0


def test_very_many_equal_rows(spark):
    """A conversation far beyond one segment: rows of one turn are counted, and none but the first is kept."""
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("conv_id"), F.lit(3).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    got = repair.repair(rows)
    (row,) = got.report.collect()
    assert (row["duplicate"], row["cost"], row["illegal"]) == (99_999, 3 * 99_999 + 2, 99_999) and row["audit"] == "K" + "D" * 99_999 + "I"
    assert [(r["edit"], r["role"], r["text"]) for r in got.rows.orderBy("segment", "n").collect()] == [("K", "user", "Hi."), ("I", "assistant", "")]


def nodes_of(conversations):
    """conversations: conv_id -> turns (role, text); every prefix with its members."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for prefix, own in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        kids = {p[: len(prefix) + 1] for p in below if len(p) > len(prefix)}
        leaves = [p for p in below if not any(q[: len(p)] == p and q != p for q in below)]
        saved = sum((len(members[p]) - 1) * len(re.findall(tries.WORD, p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in own if len(conversations[c]) == len(prefix)))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(own), len(prefix), parent, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [x for _, x in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


@pytest.mark.parametrize("most", [1, 7, 60, tries.SHARD])
def test_tries_against_all_prefixes(spark, monkeypatch, most):
    texts = ["a b", "a", "", None, "c\td e"]
    rows = [(c, None if rng.random() < 0.2 else t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in [*range(75), 200, 10**12, None] for t in range(rng.randrange(1, 6))]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit(1), "words": F.lit("x"), "path": F.lit(2)}).repartition(3)
    monkeypatch.setattr(tries, "load", lambda *_: table)
    monkeypatch.setattr(tries.trie, "__defaults__", (most,))
    monkeypatch.setattr(tries, "BUCKET", 8)
    got = tries.op13_prefix_trie(spark, "").collect()
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == nodes_of(rebuilt(rows))
    monkeypatch.setattr(tries, "load", lambda *_: table.where("false"))
    assert tries.op13_prefix_trie(spark, "").count() == 0


def test_double_arrays_hold_their_sequences():
    for size in (3, 40, 700):
        sequences = sorted({tuple(rng.randrange(size) for _ in range(rng.randrange(1, 7))) for _ in range(400)})
        arrays = [np.array(s) for s in sequences]
        shared = np.array([0] + [tries.common(a, b) for a, b in zip(arrays, arrays[1:], strict=False)])
        trie = tries.pack(arrays, shared)
        prefixes = {s[:k] for s in sequences for k in range(len(s) + 1)}
        assert (trie.check >= 0).sum() == len(prefixes)
        for s in [*sequences, *(tuple(rng.randrange(size) for _ in range(4)) for _ in range(200))]:
            node = np.zeros(1, np.int64)
            for k, code in enumerate(s):
                node = trie.step(node, np.array([code]))
                assert (node[0] >= 0) == (s[: k + 1] in prefixes)
                if node[0] < 0:
                    break
