"""Prefix trie of conversations, packed into double arrays shard by shard.

A conversation is the string of its turns' digests. Equal conversations are one sequence with a count, sequences are sorted into ranges,
and a range is cut into shards of neighbouring sequences, so that a turn that very many conversations begin with is spread over shards by what
follows it. A shard numbers its turns densely, packs its trie into the arrays BASE and CHECK (child = BASE[node] + turn, CHECK[child] = node)
and walks its sequences through them to add up each node's figures. These are sums over sequences: words, children and leaves belong to
the sequence that is the first to reach them. Only nodes on the way to a shard's first or last sequence occur in other shards as well; these
few are merged by their digest, after taking off what a shard's first sequence claims but the shard before has already.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, load

#: Turns a shard holds at most, but for a single longer conversation.
SHARD = 200_000
#: Conversation ids gathered at once; more are read as a stream.
BUCKET = 4096
#: Free places that are tried for a node's children before they go behind all others.
TRIES = 64
WORD = r"[^\x20\x09-\x0D]+"
NONE = hashlib.sha256().hexdigest()


class DoubleArray:
    """BASE and CHECK of a trie; the root is slot 0, CHECK is -1 where nothing is."""

    def __init__(self, size: int):
        self.base, self.check = np.zeros(size + 2, np.int64), np.full(size + 2, -1, np.int64)
        self.check[0] = 0
        self.free, self.end = 1, 1  # no free slot before free, none taken from end on

    def add(self, node: int, codes: np.ndarray) -> np.ndarray:
        """Slots of a node's children, whose codes ascend: the first free place that fits, of the next few."""
        while self.free < self.end and self.check[self.free] >= 0:
            self.free += 1
        offsets, at = codes - codes[0], self.free
        for _ in range(TRIES):
            if at >= self.end:
                break
            places = at + offsets
            if (self.check[places[places < self.end]] < 0).all():
                break
            at += 1
        else:
            at = self.end
        places = at + offsets
        top = int(places[-1]) + 1
        if top > len(self.check):
            more = max(top, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.pad(self.base, (0, more)), np.pad(self.check, (0, more), constant_values=-1)
        self.base[node], self.check[places] = at - codes[0], node
        self.end = max(self.end, top)
        return places

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Children of nodes by codes; -1 where there is none."""
        places = self.base[nodes] + codes
        known = (places > 0) & (places < len(self.check))
        return np.where(known & (self.check[np.where(known, places, 0)] == nodes), places, -1)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    size = min(len(a), len(b))
    differ = np.flatnonzero(a[:size] != b[:size])
    return int(differ[0]) if len(differ) else size


def pack(sequences: list[np.ndarray], shared: np.ndarray) -> DoubleArray:
    """The trie of ascending, distinct sequences of dense ids; shared: the common prefix of each with the one before."""
    lengths = np.array([len(s) for s in sequences])
    trie, slots, starts, depth = DoubleArray(int(lengths.sum())), np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    while len(starts):
        opened = np.flatnonzero((shared <= depth) & (lengths > depth))  # where nodes of the next depth begin
        parent = np.searchsorted(starts, opened, "right") - 1
        codes = np.array([sequences[i][depth] for i in opened], np.int64)
        cuts = np.flatnonzero(np.diff(parent)) + 1
        groups = np.split(np.arange(len(opened)), cuts) if len(opened) else []
        below = np.zeros(len(opened), np.int64)
        for group in groups:
            below[group] = trie.add(int(slots[parent[group[0]]]), codes[group])
        slots, starts, depth = below, opened, depth + 1
    return trie


NODES = (
    "shard long, edge boolean, depth int, key binary, parent_key binary, parent_conv_id long, conv_id long, n long, children long, leaves long, saved long, ends_sha256 string, "
    "first_path binary, first_words array<int>, last_path binary"
)


def shard_nodes(shard: int, rows: list[dict]) -> pa.RecordBatch:
    """NODES of a shard: rows(path, words, n, conv_id, ends_sha256), ascending and distinct by path."""
    digests = np.frombuffer(b"".join(r["path"] for r in rows), "S32")
    dense = np.unique(digests, return_inverse=True)[1].astype(np.int64)
    lengths = np.array([len(r["path"]) // 32 for r in rows])
    sequences = np.split(dense, np.cumsum(lengths)[:-1])
    shared = np.array([0, *(common(a, b) for a, b in itertools.pairwise(sequences))])
    leaf = np.append(shared[1:] < lengths[:-1], True)
    trie = pack(sequences, shared)
    size = len(trie.check)
    n, conv, children, leaves, saved = (np.zeros(size, np.int64) for _ in range(5))
    conv[:], depths, ends = np.iinfo(np.int64).max, np.zeros(size, np.int32), np.full(size, -1, np.int64)
    members, least = np.array([r["n"] for r in rows]), np.array([r["conv_id"] for r in rows])
    before = [np.append(0, np.cumsum(np.array(r["words"], np.int64))) for r in rows]  # words of the first k turns
    paths = {0: [0], len(rows) - 1: [0]}  # the slots on the way to the first and the last sequence
    active, at, depth = np.arange(len(rows)), np.zeros(len(rows), np.int64), 0
    while len(active):
        total, past, claimed = (np.array(x) for x in zip(*((before[i][-1], before[i][max(depth - 1, 0)], before[i][max(depth - 1, shared[i])]) for i in active), strict=True))
        np.add.at(n, at, members[active])
        np.minimum.at(conv, at, least[active])
        np.add.at(children, at, (shared[active] <= depth) & (lengths[active] > depth))
        np.add.at(leaves, at, leaf[active])
        np.add.at(saved, at, members[active] * (total - past) - (total - claimed))
        depths[at] = depth
        done = lengths[active] == depth
        ends[at[done]] = active[done]
        active, at = active[~done], at[~done]
        at = trie.step(at, np.array([sequences[i][depth] for i in active], np.int64))
        for i, path in paths.items():
            path += at[active == i].tolist()
        depth += 1
    keys: dict[int, bytes] = {}
    for i, path in paths.items():
        digest = hashlib.sha256()
        for k, slot in enumerate(path):
            keys[slot] = digest.copy().digest()
            digest.update(rows[i]["path"][32 * k : 32 * k + 32])
    used = np.flatnonzero(n)
    parents = trie.check[used]
    inner = [int(p) not in keys for p in parents]
    root = [slot == 0 for slot in used]
    data = [
        pa.array(np.full(len(used), shard)), pa.array([int(s) in keys for s in used]), pa.array(depths[used]), pa.array([keys.get(int(s)) for s in used], pa.binary()),
        pa.array([None if r else keys.get(int(p)) for p, r in zip(parents, root, strict=True)], pa.binary()), pa.array(conv[parents], mask=~np.array(inner)),
        *(pa.array(x[used]) for x in (conv, n, children, leaves, saved)), pa.array([rows[e]["ends_sha256"] if e >= 0 else None for e in ends[used]], pa.string()),
        pa.array([rows[0]["path"] if r else None for r in root], pa.binary()), pa.array([rows[0]["words"] if r else None for r in root], pa.list_(pa.int32())),
        pa.array([rows[-1]["path"] if r else None for r in root], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(data, names=[part.split()[0] for part in NODES.split(", ")])


def in_shards(sequences: DataFrame, most: int = SHARD) -> DataFrame:
    """NODES of all shards of sequences(path, words, n, conv_id, ends_sha256), numbered in the order of paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, turns = TaskContext.get().partitionId() << 32, [], 0
        for row in (row for batch in batches for row in batch.to_pylist()):
            if rows and turns + len(row["words"]) > most:
                yield shard_nodes(shard, rows)
                shard, rows, turns = shard + 1, [], 0
            rows.append(row)
            turns += len(row["words"]) + 1
        if rows:
            yield shard_nodes(shard, rows)

    return sequences.select("path", "words", "n", "conv_id", "ends_sha256").repartitionByRange("path").sortWithinPartitions("path").mapInArrow(run, NODES)


FIXES = "key binary, children long, leaves long, saved long"


def overlaps(nodes: DataFrame) -> DataFrame:
    """FIXES: what a shard's first sequence claims of nodes that the shard before has, to be added to the nodes' sums; one row a shard is looked at."""
    order = W.orderBy("shard")
    ends = nodes.where("depth = 0").select("first_path", "first_words", F.lag("last_path").over(order).alias("before")).where("before IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            shared = common(*(np.frombuffer(row[c], "S32") for c in ("before", "first_path")))
            longer = len(row["before"]) == 32 * shared  # the shard before ends with a beginning of this one's first sequence: no leaf
            words = np.append(0, np.cumsum(row["first_words"][:shared]))
            digest, keys = hashlib.sha256(), []
            for k in range(shared + 1):
                keys.append(digest.copy().digest())
                digest.update(row["first_path"][32 * k : 32 * k + 32])
            depth = np.arange(shared + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(-(depth < shared).astype(np.int64)), pa.array(np.full(shared + 1, -int(longer))), pa.array((words[-1] - words[np.maximum(depth - 1, 0)]).astype(np.int64))],
                names=["key", "children", "leaves", "saved"],
            )

    return ends.mapInArrow(run, FIXES)


def merged(nodes: DataFrame) -> DataFrame:
    """The trie's nodes from NODES: those on shards' edges are merged by key, the others are whole."""
    sums = ("n", "children", "leaves", "saved")
    edges = nodes.where("edge").select("shard", "key", "parent_key", "depth", "conv_id", *sums, "ends_sha256")
    fixes = overlaps(nodes).select(F.lit(0).cast("long").alias("n"), *FIXES.replace(" binary", "").replace(" long", "").split(", "))
    shared = edges.unionByName(fixes, allowMissingColumns=True).groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums), F.max("ends_sha256").alias("ends_sha256")
    )
    shared = Scratch(nodes.sparkSession).table(shared, "edges")
    parents = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    near = edges.select("shard", F.col("key").alias("parent_key")).join(parents, "parent_key")  # a node with very many children has a row for each shard
    columns = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    inner = nodes.where("NOT edge")
    return (
        shared.join(parents, "parent_key", "left").select(columns)
        .unionByName(inner.where("parent_key IS NOT NULL").drop("parent_conv_id").join(near, ["shard", "parent_key"]).select(columns))
        .unionByName(inner.where("parent_key IS NULL").select(columns))
    )


def turn_strings(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): array of struct(turn, digest, words) in order of turns; null roles and texts are empty. A conversation's turns are one row's digests."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    turn = F.struct("turn", digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).alias("words"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def sequences(conversations: DataFrame) -> DataFrame:
    """Distinct sequences of conversations(conv_id, turns): path, words, n, conv_id (the smallest), ends_sha256 of all conv_ids."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    scratch = Scratch(conversations.sparkSession)
    rows = conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = scratch.table(rows.withColumn("sequence", F.unhex(F.sha2("path", 256))), "sequences")
    ids = rows.groupBy("sequence", F.floor(F.col("conv_id") / BUCKET).alias("bucket")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    parts = ids.select("sequence", "bucket", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("first"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        flat = (row for batch in batches for row in batch.to_pylist())
        for _, own in itertools.groupby(flat, key=lambda row: row["sequence"]):
            digest, n, first = hashlib.sha256(), 0, None
            for row in own:
                digest.update((("," if n else "") + row["text"]).encode())
                n, first = n + row["n"], row["first"] if n == 0 else first
            out.append((first, n, digest.hexdigest()))
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["conv_id", "n", "ends_sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["conv_id", "n", "ends_sha256"])

    members = parts.repartition("sequence").sortWithinPartitions("sequence", "bucket").mapInArrow(run, "conv_id long, n long, ends_sha256 string")
    return scratch.table(members.join(rows.select("conv_id", "path", "words"), "conv_id"), "distinct")


def trie(conversations: DataFrame, most: int = SHARD) -> DataFrame:
    """Nodes of the trie of conversations(conv_id, turns), as turn_strings() gives them or rebuilt from these.

    conv_id (the smallest member), depth, parent_conv_id (null for the root), n, children, leaves, saved, ends_sha256 (null: no member ends here).

    - equal conversations are members of the same nodes; conversations without turns are members of the root alone;
    - turns are equal by role and text; turns of one number are in order of their digests, null numbers first;
    - no conversations, no nodes; conv_ids are not null and differ.
    """
    nodes = Scratch(conversations.sparkSession).table(in_shards(sequences(conversations), most), "nodes")
    return merged(nodes)


def shared_start(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The test's sharing: the first h turns of a conversation are those of the last one whose id every divides, h = crc32 of its id modulo most."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    bases = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("start"))
    rows = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(bases, "base", "left")
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    start = F.coalesce(F.slice("start", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(start, rest).alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = turn_strings(load(spark, sf_dir, "conversations"))
    own = Scratch(spark).table(own, "turns")
    long: dict[str, Column] = {c: F.col(c).cast("long") for c in ("depth", "n", "children", "leaves", "saved")}
    return trie(shared_start(own)).select(
        "conv_id", long["depth"].alias("depth"), "parent_conv_id", long["n"].alias("n_convs"), long["children"].alias("n_children"), long["leaves"].alias("n_leaves"),
        long["saved"].alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"),
    )


#: crc32 by its definition, byte by byte; conversations as lists of (role, text), nodes as prefixes of these.
OP13_SQL = r"""
WITH crc AS (SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)),
own AS (SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, p, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 4 AS h FROM own, crc),
rebuilt AS (SELECT h.conv_id, list_concat(coalesce(b.p, [])[:h], h.p[h + 1:]) AS p FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
members AS (SELECT conv_id, d, p[:d] AS k, len(p) = d AS ends FROM (SELECT conv_id, p, unnest(range(len(p) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS e,
                 CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].x, '[^\x20\x09-\x0D]+')) END AS w FROM members GROUP BY k, d),
kids AS (SELECT k[:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (SELECT k[:up] AS k, count(*) FILTER (leaf) AS leaves, sum((n - 1) * w) AS saved
          FROM (SELECT nodes.*, kids.k IS NULL AS leaf, unnest(range(d + 1)) AS up FROM nodes LEFT JOIN kids USING (k)) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(v.e) AS ends_sha256
FROM nodes v LEFT JOIN nodes u ON v.d > 0 AND u.k = v.k[:v.d - 1] LEFT JOIN kids ON kids.k = v.k JOIN below ON below.k = v.k
"""
