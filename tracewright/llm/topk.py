"""Exact top-k inner products over an impact-ordered index, a score at a time.

Vectors are held in blocks. A block's postings (vector, dimension, value) are split
into segments by quantised impact, the power of two below |value|. For a batch of
queries segments are added in descending impact, and only for vectors that some query of the
batch may still want: what is missing from a score is bounded by the norms of the query and of the
vector's remaining postings, and a vector that cannot reach the k-th best of a query is out.
That k-th best is the larger of the block's own lower bound and of what the task has
found before, so later blocks, which come in descending order of their largest norm, lose
most vectors early. Segments are added until scoring the members that remain possible costs
less than the segments to come; these are then scored exactly from their full integers.

The index stays where it is: queries go to it in chunks of bounded size, one after
another, and the best k of all blocks are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, load

BLOCK, BATCH = 2048, 512
CHUNK_BYTES = 32 << 20  # of queries that every task holds at once
#: Bytes of pairs that are scored exactly at once; how many times cheaper than further segments the pairs left must be to leave the index for them.
RESCORED, LEAVE = 32 << 20, 4
#: Whole numbers up to this are exact as floats; scores below this fit 64 bits.
EXACT, FITS = 2.0**53, 2.0**62


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors that are null, empty, or hold null or non-finite components are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(ok)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(width, ids, vectors): up to size vectors of one width as arrays; ids long, values 64-bit, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(width):
            ids, values = held.pop(width)
            return pa.RecordBatch.from_pydict(
                {"width": pa.array([width], pa.int32()), "ids": [np.array(ids, np.int64).tobytes()], "vectors": [np.array(values, np.int64).tobytes()]}
            )

        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = v.values.to_numpy()
                ids, values = held.setdefault(len(v), ([], []))
                ids.append(vec_id)
                values.append(v)
                if len(ids) == size:
                    yield out(len(v))
        for width in list(held):
            yield out(width)

    return rows.mapInArrow(run, "width int, ids binary, vectors binary")


def segments(index: DataFrame) -> DataFrame:
    """The index: each block's largest squared norm and its postings by descending quantised impact (per level the count, then positions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, ids, vectors in zip(*batch.columns, strict=True):
                flat = np.frombuffer(vectors.as_buffer(), np.int64)
                impact = np.where(flat == 0, -1, np.frexp(np.abs(flat.astype(float)))[1] - 1)
                levels = np.unique(impact[impact >= 0])[::-1]
                order = [np.flatnonzero(impact == level) for level in levels]
                norm = float((flat.reshape(-1, width.as_py()).astype(float) ** 2).sum(1).max())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([norm])] + [pa.array([x.as_py()], t) for x, t in ((width, pa.int32()), (ids, pa.binary()), (vectors, pa.binary()))]
                    + [pa.array([[len(x) for x in order]], pa.list_(pa.int64())), pa.array([np.concatenate([*order, np.zeros(0, np.int64)]).astype(np.int32).tobytes()], pa.binary())],
                    names=["norm", "width", "ids", "vectors", "counts", "postings"],
                )

    return index.mapInArrow(run, "norm double, width int, ids binary, vectors binary, counts array<long>, postings binary")


def best(queries, query_ids, vectors, ids, counts, postings, k: int, floor=None):
    """(query, vector, score) positions and exact scores of each query's k best in a block, itself left out by id, and how many products of components it took.

    floor: for each query a score that results must reach, -inf where there is none.
    """
    m, n = len(queries), len(vectors)
    floor = np.full(m, -np.inf) if floor is None else floor
    norms, missing = np.sqrt((queries.astype(float) ** 2).sum(1)), (vectors.astype(float) ** 2).sum(1)
    whole = np.sqrt(missing)
    # up to 2^53 all sums are exact; beyond it the bounds give way to what floats may have lost
    lost = np.where(missing >= EXACT, missing * 1e-13, 0.0)
    own = query_ids[:, None] == ids[None, :]

    def slack(q=slice(None)):
        most = norms[q, None] * whole[None, :]
        return norms[q, None] * np.sqrt(missing + lost)[None, :] * (1 + 1e-9) + np.where(most >= EXACT, most * 1e-12, 1e-6)

    alive = ~own & (norms[:, None] * whole[None, :] < FITS) & (slack() >= floor[:, None])
    partial, asked, width = np.zeros((m, n)), queries.astype(float), vectors.shape[1]
    flat, at, added = vectors.ravel(), 0, 0
    for count in counts:
        wanted, q = alive.any(0), np.flatnonzero(alive.any(1))
        if LEAVE * alive.sum() * width <= len(q) * wanted.mean() * (len(postings) - at):
            break
        where = postings[at : at + count]
        at += count
        where = where[wanted[where // width]]
        rows, which = np.unique(where // width, return_inverse=True)
        segment = np.zeros((len(rows), width))
        segment[which, where % width] = flat[where]
        added += len(q) * len(where)
        partial[np.ix_(q, rows)] += asked[q] @ segment.T
        missing[rows] = np.maximum(0, missing[rows] - (segment**2).sum(1))
        bound, kth = slack(), floor
        if n > k:
            lower = np.where(alive, partial - bound, -np.inf)
            kth = np.maximum(floor, -np.partition(-lower, k - 1, axis=1)[:, k - 1])
        alive &= partial + bound >= kth[:, None]
    q, v = np.nonzero(alive)
    added, step = added + len(q) * width, max(1, RESCORED // (16 * width))
    parts = [np.einsum("ij,ij->i", queries[q[s : s + step]], vectors[v[s : s + step]]) for s in range(0, len(q), step)]
    score = np.concatenate([np.zeros(0, np.int64), *parts])
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], v[rank < k], score[rank < k], added


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK, batch: int = BATCH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query, ties to the smaller vec_id.

    Queries are the vectors whose id is divisible by every; candidates are all vectors with another id.

    - vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids;
    - vectors of different widths don't meet; with fewer than k candidates all are returned;
    - repeated rows are candidates as often as they occur, and one query;
    - a pair takes no part where the product of its lengths is 2^62 or more, as its score might not fit 64 bits; its vectors' other pairs do;
    - an empty table gives an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.table(quantised(vectors), "quantised")
    index = scratch.table(segments(blocks(rows, block)), "index")
    asked = scratch.table(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), "queries")
    number, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    chunks = max(1, -(-number * (width or 1) * 8 // chunk_bytes))
    found = []
    for chunk in range(chunks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == chunk) if chunks > 1 else asked
        got = _searched(index, blocks(part, batch).collect(), k)  # about chunk_bytes
        found.append(scratch.table(got, f"found_{chunk}"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    merged = reduce(DataFrame.unionAll, found)
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(index: DataFrame, asked: list, k: int) -> DataFrame:
    """query_id, vec_id, score: of each task's blocks the k best of each query in asked, rows of blocks()."""
    shared = index.sparkSession.sparkContext.broadcast([(r["width"], bytes(r["ids"]), bytes(r["vectors"])) for r in asked])
    number = lambda x, t=np.int64: np.frombuffer(x, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = {}  # by batch of queries: the k best scores so far
        for b in batches:
            for width, ids, values, counts, postings in zip(*b.columns, strict=True):
                w, vi, vectors = width.as_py(), number(ids.as_buffer()), number(values.as_buffer()).reshape(-1, width.as_py())
                for i, (query_width, query_ids, queries) in enumerate(shared.value):
                    if query_width != w:
                        continue
                    qi = number(query_ids)
                    top = tops.setdefault(i, np.full((len(qi), k), -np.inf))
                    q, v, score, _ = best(number(queries).reshape(-1, w), qi, vectors, vi, counts.as_py(), number(postings.as_buffer(), np.int32), k, top.min(1))
                    block = np.full((len(qi), k), -np.inf)
                    block[q, np.arange(len(q)) - np.searchsorted(q, q)] = score
                    tops[i] = -np.sort(-np.concatenate([top, block], 1), axis=1)[:, :k]
                    yield pa.RecordBatch.from_arrays([pa.array(qi[q]), pa.array(vi[v]), pa.array(score)], names=["query_id", "vec_id", "score"])

    ordered = index.sortWithinPartitions(F.desc("norm")).select("width", "ids", "vectors", "counts", "postings")
    return ordered.mapInArrow(run, "query_id long, vec_id long, score long")


def op6_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
