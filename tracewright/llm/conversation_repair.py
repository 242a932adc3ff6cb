"""Repair of conversation structure by Hirschberg's divide and conquer over a four-state machine.

A repaired conversation is empty, or an optional system turn followed by pairs of user and assistant turns. Between two rows the machine
is in one of four states: nothing yet, after system, after user, after assistant. Rows are kept, given another role or deleted, and
empty turns inserted, each at a cost; of the cheapest edits those whose initials come first in ASCII order are wanted.

The recursion runs forward costs from the left and backward costs from the right up to the middle row, picks the crossing state of least
total cost, of ties the one whose left edits come first, and goes on in both halves, so memory is linear in the rows. Edits up to a row end
with that row's own edit and hold as many of these as there are rows: none is a prefix of another, and one rank a state orders them.

Spark sorts all rows by conversation and turn into ranges and cuts these into segments of bounded length, so a conversation of any
size is dealt over many tasks. A segment's costs and ranks between any two states stand for it when the same recursion picks the states
at the segments' borders; then each segment is repaired on its own.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"  # of SYSTEM, USER, ASSISTANT; any other initial is numbered 3
WHOLE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, ENDLESS = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
#: Rows a segment holds at most.
SEGMENT = 16_384
FAR = 1 << 60
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the state after a user or assistant turn that may follow
ROLES = {USER: "user", ASSISTANT: "assistant"}
Table = tuple[tuple[tuple[int, object], ...], ...]


def _row_table(code: int) -> Table:
    """[from][to] -> (cost, edits) of insertions and one row, code: initial * 4 + fault; cost FAR where there is no way."""
    initial, fault = divmod(code, 4)
    extra = ENDLESS if fault == TRUNCATED else 0
    best = [[(FAR, "")] * 4 for _ in range(4)]
    for start in range(4):
        at = start
        for inserted in range(3):
            ways = [(at, DELETE, "D")]
            if fault in (WHOLE, TRUNCATED):
                ways.append((NEXT[at], REROLE + extra, "R"))
                if initial < 3 and (initial + 1 == NEXT[at] or initial + 1 == SYSTEM and at == NOTHING):
                    ways.append((initial + 1, extra, "K"))
            for end, cost, edit in ways:
                best[start][end] = min(best[start][end], (cost + INSERT * inserted, "I" * inserted + edit))
            at = NEXT[at]
    return tuple(map(tuple, best))


ROW_TABLES = [_row_table(code) for code in range(16)]
#: What is inserted after the last row, by state.
CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def advance(costs: tuple[int, ...], ranks: tuple[int, ...], table: Table) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Costs and ranks of the four states after one more item."""
    best = []
    for end in range(4):
        ways = [(costs[p] + table[p][end][0], ranks[p], table[p][end][1]) for p in range(4) if costs[p] < FAR and table[p][end][0] < FAR]
        best.append(min(ways, default=(FAR, 4, table[end][end][1])))
    order = sorted(range(4), key=lambda s: best[s][1:])
    return tuple(b[0] for b in best), tuple(order.index(s) for s in range(4))


def retreat(costs: tuple[int, ...], table: Table) -> tuple[int, ...]:
    """Costs from the four states to the end with one more item before them."""
    return tuple(min(min(table[p][q][0] + costs[q] for q in range(4)), FAR) for p in range(4))


@functools.lru_cache(100_000)
def _advance_code(costs: tuple[int, ...], ranks: tuple[int, ...], code: int):
    return advance(costs, ranks, ROW_TABLES[code])


@functools.lru_cache(100_000)
def _retreat_code(costs: tuple[int, ...], code: int):
    return retreat(costs, ROW_TABLES[code])


def _shifted(costs: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    least = min(costs)
    return least, tuple(c - least if c < FAR else FAR for c in costs)


def forward(items: Sequence, low: int, high: int, start: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Costs and ranks of the states after items[low:high] (row codes or tables), from state start."""
    total, costs, ranks = 0, tuple(0 if s == start else FAR for s in range(4)), (0, 1, 2, 3)
    for k in range(low, high):
        item = items[k]
        more, costs = _shifted(costs)
        total += more  # costs relative to the least one recur, so few calls are computed
        costs, ranks = advance(costs, ranks, item) if isinstance(item, tuple) else _advance_code(costs, ranks, int(item))
    return tuple(c + total if c < FAR else FAR for c in costs), ranks


def backward(items: Sequence, low: int, high: int, end: int) -> tuple[int, ...]:
    """Costs from each state before items[low:high] to state end."""
    total, costs = 0, tuple(0 if s == end else FAR for s in range(4))
    for k in range(high - 1, low - 1, -1):
        item = items[k]
        more, costs = _shifted(costs)
        total += more
        costs = retreat(costs, item) if isinstance(item, tuple) else _retreat_code(costs, int(item))
    return tuple(c + total if c < FAR else FAR for c in costs)


def crossings(items: Sequence, start: int, end: int) -> list[int]:
    """The state before the first item, after each one: the cheapest way from start to end, of ties the first in the order of edits."""
    states = [start] * (len(items) + 1)
    states[-1] = end

    def between(low: int, high: int) -> None:
        if high - low < 2:
            return
        middle = (low + high) // 2
        costs, ranks = forward(items, low, middle, states[low])
        rest = backward(items, middle, high, states[high])
        states[middle] = min((s for s in range(4) if costs[s] < FAR and rest[s] < FAR), key=lambda s: (costs[s] + rest[s], ranks[s]))
        between(low, middle)
        between(middle, high)

    between(0, len(items))
    return states


def closed(costs: tuple[int, ...], ranks: tuple[int, ...]) -> tuple[int, int]:
    """(cost, state after the last row) of the best way to end."""
    ways = [(costs[s] + INSERT * len(CLOSING[s]), ranks[s], s) for s in range(4) if costs[s] < FAR]
    cost, _, state = min(ways)
    return cost, state


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, code, n) of the distinct rows of rows(conv_id, turn, role, text); null roles and texts are one space.

    digest stands for conversation, role and text; n counts equal rows of a turn. A row is blank, else a duplicate of an earlier row of its
    conversation, else truncated, else whole; of n equal rows the fault is the first one's, the others are duplicates unless blank.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    trimmed = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), WHOLE).otherwise(TRUNCATED)
    initial = F.left("role", F.lit(1))
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    slim = rows.select("conv_id", "turn", digest_of().alias("digest"), (number * 4 + fault).alias("code"))
    scratch = Scratch(rows.sparkSession)
    slim = scratch.table(slim.groupBy("conv_id", "turn", "digest", "code").agg(F.count("*").alias("n")), "distinct")
    again = slim.groupBy("digest").agg(F.min(F.struct("turn"))["turn"].alias("first_turn"), F.count("*").alias("turns")).where("turns > 1")
    repeats = F.col("turns").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn")) & (F.col("code") % 4 != BLANK)
    code = F.when(repeats, F.col("code") - F.col("code") % 4 + DUPLICATE).otherwise(F.col("code"))
    return slim.join(again, "digest", "left").select("conv_id", "turn", "digest", code.cast("int").alias("code"), "n")


def digest_of() -> Column:
    head = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.length("role").cast("string"), F.concat("role", "text"))
    return F.unhex(F.sha2(head, 256))


def _mapped(df: DataFrame, function: Callable[[Iterator[dict]], Iterator[dict]], schema: str, size: int = 256) -> DataFrame:
    """Rows of df through function as dictionaries, in batches of Arrow; size rows go out at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in function(row for batch in batches for row in batch.to_pylist()):
            out.append(row)
            if len(out) == size:
                yield pa.RecordBatch.from_pylist(out, kind)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return df.mapInArrow(run, schema)


SEGMENTS = "conv_id long, segment long, codes binary, digests binary, head int, tail int, illegal long, costs array<long>, ranks array<int>"


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """SEGMENTS: stretches of at most most rows of one conversation, numbered in order, of marked() rows."""

    def cut(rows: Iterator[dict]) -> Iterator[dict]:
        number = TaskContext.get().partitionId() << 32
        codes, digests, owner = bytearray(), bytearray(), None

        def closed_segment():
            table = [forward(codes, 0, len(codes), start) for start in range(4)]
            initials = np.frombuffer(bytes(codes), np.uint8) >> 2
            fits = (initials[:-1] * 4 + initials[1:])[:, None] == (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1)
            illegal = int((~fits.any(1)).sum())
            costs, ranks = ([x for part in parts for x in part] for parts in zip(*table, strict=True))
            return {"conv_id": owner, "segment": number, "codes": bytes(codes), "digests": bytes(digests), "head": codes[0], "tail": codes[-1], "illegal": illegal, "costs": costs, "ranks": ranks}

        for row in rows:
            again = row["code"] - row["code"] % 4 + (BLANK if row["code"] % 4 == BLANK else DUPLICATE)
            left, code = row["n"], row["code"]
            while left:
                if codes and (len(codes) >= most or row["conv_id"] != owner):
                    yield closed_segment()
                    number += 1
                    codes, digests = bytearray(), bytearray()
                owner = row["conv_id"]
                take = 1 if code != again else min(left, most - len(codes))
                codes += bytes([code]) * take
                digests += row["digest"] * take
                left, code = left - take, again
        if codes:
            yield closed_segment()

    keys = ["conv_id", "turn", "digest"]
    return _mapped(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), cut, SEGMENTS, 32)


CHOSEN = "conv_id long, cost long, illegal long, borders array<struct<segment:long,before:int,after:int,last:boolean>>"


def borders(cut: DataFrame) -> DataFrame:
    """CHOSEN: a conversation's cost, its illegal neighbours, and the states at the borders of its segments."""
    each = F.struct("segment", "illegal", "head", "tail", "costs", "ranks")
    whole = cut.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("parts"))  # one entry for each SEGMENT rows

    def choose(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            parts = row["parts"]
            tables = [tuple(tuple(zip(p["costs"][4 * s : 4 * s + 4], p["ranks"][4 * s : 4 * s + 4], strict=True)) for s in range(4)) for p in parts]
            cost, end = closed(*forward(tables, 0, len(tables), NOTHING))
            states = crossings(tables, NOTHING, end)
            pairs = [(a["tail"] >> 2, b["head"] >> 2) for a, b in zip(parts, parts[1:], strict=False)]
            illegal = sum(p["illegal"] for p in parts) + sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in pairs)
            last = len(parts) - 1
            chosen = [{"segment": p["segment"], "before": states[k], "after": states[k + 1], "last": k == last} for k, p in enumerate(parts)]
            yield {"conv_id": row["conv_id"], "cost": cost, "illegal": illegal, "borders": chosen}

    return _mapped(whole, choose, CHOSEN, 1024)


class Repaired(NamedTuple):
    """report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; rows: conv_id, segment, n, edit, role, text."""

    report: DataFrame
    rows: DataFrame


def repair(rows: DataFrame, most: int = SEGMENT) -> Repaired:
    """What is wrong with the conversations of rows(conv_id, turn, role, text), and their cheapest repair.

    Repaired rows stand in the order of (segment, n); edit is K (kept), R (another role) or I (inserted, with empty text).

    - rows go by turn, null turns first, rows of one turn by the digest of role and text; rows without a conversation are one conversation;
    - null and empty roles and texts are one space and nothing: an initial that fits nowhere, a blank text;
    - an audit is one value a conversation, so of a conversation of any length; its segments' costs meet in one task, their rows never;
    - an empty table gives empty results; other columns of rows are not looked at.
    """
    scratch = Scratch(rows.sparkSession)
    distinct = scratch.table(marked(rows), "marked")
    cut = scratch.table(segments(distinct, most), "segments")
    chosen = scratch.table(borders(cut), "borders")

    def edit(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            states, audit, reached = crossings(row["codes"], row["before"], row["after"]), "", bytearray()
            pieces = [ROW_TABLES[code][states[k]][states[k + 1]][1] for k, code in enumerate(row["codes"])]
            for k, piece in enumerate([*pieces, CLOSING[row["after"]] if row["last"] else ""]):
                state = states[k]
                for one in piece:
                    state = NEXT[state] if one == "I" else states[k + 1]
                    reached.append(state)
            audit = "".join(pieces) + (CLOSING[row["after"]] if row["last"] else "")
            yield {k: row[k] for k in ("conv_id", "segment", "digests")} | {"audit": audit, "reached": bytes(reached)}

    each = cut.join(chosen.select(F.inline("borders")), "segment").select("conv_id", "segment", "codes", "digests", "before", "after", "last")
    edited = scratch.table(_mapped(each, edit, "conv_id long, segment long, digests binary, audit string, reached binary", 32), "edited")
    return Repaired(_report(distinct, chosen, edited), _repaired_rows(rows, edited))


def _report(distinct: DataFrame, chosen: DataFrame, edited: DataFrame) -> DataFrame:
    fault, again = F.col("code") % 4, F.col("n") - 1
    total = lambda *ways: F.sum(functools.reduce(lambda c, w: c.when(*w), ways, F).otherwise(0))
    counts = distinct.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        total((fault == BLANK, F.col("n"))).alias("blank"),
        total((fault == DUPLICATE, F.col("n")), (fault != BLANK, again)).alias("duplicate"),
        total((fault == TRUNCATED, 1)).cast("long").alias("truncated"),
    )
    parts = F.array_sort(F.collect_list(F.struct("segment", "audit")))
    audits = edited.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
    out = counts
    for part in (chosen.select("conv_id", "illegal", "cost"), audits):
        part = part.withColumnRenamed("conv_id", "same")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("same"))).drop("same")
    return out


def _repaired_rows(rows: DataFrame, edited: DataFrame) -> DataFrame:
    def place(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            at = 0
            for n, (edit, state) in enumerate(zip(row["audit"], row["reached"], strict=True)):
                own = None if edit == "I" else row["digests"][32 * at : 32 * at + 32]
                at += edit != "I"
                if edit != "D":
                    yield {"conv_id": row["conv_id"], "segment": row["segment"], "n": n, "edit": edit, "new_role": None if edit == "K" else ROLES[state], "digest": own}

    placed = _mapped(edited, place, "conv_id long, segment long, n int, edit string, new_role string, digest binary", 4096)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    texts = rows.select("conv_id", role.alias("role"), text.alias("text")).select(digest_of().alias("digest"), "role", "text").dropDuplicates(["digest"])
    own = placed.where("edit <> 'I'").join(texts, "digest").withColumn("role", F.coalesce("new_role", "role"))
    new = placed.where("edit = 'I'").withColumns({"role": F.col("new_role"), "text": F.lit("")})
    columns = ["conv_id", "segment", "n", "edit", "role", "text"]
    return own.select(columns).unionByName(new.select(columns))


def line_digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the lines role:text of repaired rows, joined by newlines; read as a sorted stream, never gathered."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for owner, own in itertools.groupby(rows, key=lambda row: row["conv_id"]):
            digest = hashlib.sha256()
            for k, row in enumerate(own):
                digest.update(f"{chr(10) if k else ''}{row['role']}:{row['text']}".encode())
            yield {"conv_id": owner, "repaired_sha256": digest.hexdigest()}

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "n")
    return _mapped(ordered, run, "conv_id long, repaired_sha256 string", 1024)


def damaged(conversations: DataFrame) -> DataFrame:
    """The test's damage: a row's fate is crc32 of conv_id:turn modulo 20; nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = load(spark, sf_dir, "conversations")
    report, rows = repair(damaged(conversations))
    out = conversations.select("conv_id").distinct()
    for part in (report, line_digests(rows)):
        part = part.withColumnRenamed("conv_id", "same")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("same")), "left").drop("same")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    none = hashlib.sha256().hexdigest()
    return out.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(none))})
