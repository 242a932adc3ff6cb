"""Packing token sequences into windows by non-negative least squares over length combinations.

Documents are cut into whole windows and one remainder each. The histogram of
remainder lengths is matched by repeat counts of shallow combinations (two or
three lengths that fill a window): a non-negative least-squares problem, solved by
accelerated projected gradient, rounded down, and completed by greedy best fit over
the lengths that are left. Only the histogram (one count per length below the
window) and the plan, both bounded by the window, meet on the driver; pieces find
their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, load, text_or_empty

WINDOW = 1024
#: Tokens that the vocabulary has besides the ranks; they are found inside texts too.
ADDED = {"<|endoftext|>": 50256}
#: What the vocabulary's pattern takes for white space. A run of it is one piece, but for the last character where more text follows.
#: The library's pattern gives up on runs of a million; those of LONG_RUN are taken out of the text beforehand.
LONG_RUN = 100_000
BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long"
_encoders: dict[str, object] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """The byte-level BPE of the vocabulary file and its one added token, and the same of whole texts as one piece; kept for the life of the Python worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        split = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
        _encoders[path] = split, tiktoken.Encoding("piece", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def encode(path: str, text: str) -> np.ndarray:
    """The text's ids; added tokens count wherever they stand."""
    split, piece = encoder(path)
    if len(text) < LONG_RUN or not BLANKS.search(text):
        return split.encode_to_numpy(text, allowed_special="all")
    ((added, added_id),), out = ADDED.items(), []
    for k, part in enumerate(text.split(added)):
        at = 0
        out += [np.full(min(k, 1), added_id, np.uint32)]
        for run in BLANKS.finditer(part):
            end = run.end() - (run.end() < len(part))
            out += [split.encode_to_numpy(part[at : run.start()]), piece.encode_to_numpy(part[run.start() : end])]
            at = end
        out.append(split.encode_to_numpy(part[at:]))
    return np.concatenate(out)


def cut_pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Rows of PIECES: whole windows and one remainder per document; nth counts a task's pieces of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            out: list[tuple] = []
            ids_column, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                doc_id = ids_column[i].as_py()
                ids = np.append(encode(path, texts[i].as_py()).astype("<u4"), np.uint32(0))
                raw, total = memoryview(ids.tobytes()), len(ids)
                for start in range(0, total, window):
                    length = min(window, total - start)
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    out.append((doc_id, start, length, crc, total, part, int(seen[length])))
                    seen[length] += 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"],
                )

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) of those given that sum to the window, each in ascending order."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    a = lengths[lengths <= window // 2]
    a = a[present[window - a]]
    rows = [np.stack([np.zeros_like(a), a, window - a], 1)]
    for x in lengths[lengths <= window // 3]:
        y = lengths[(lengths >= x) & (lengths <= (window - x) // 2)]
        y = y[present[window - x - y]]
        rows.append(np.stack([np.full_like(y, x), y, window - x - y], 1))
    return np.concatenate(rows)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|^2, A the number of times a combination uses each length."""
    if not len(combos):
        return np.zeros(0)
    size, used = len(histogram), combos > 0

    def forward(x):
        y = np.bincount(combos.ravel(), np.repeat(x, combos.shape[1]), size)
        y[0] = 0
        return y

    def backward(r):
        return (r[combos] * used).sum(1)

    v = np.ones(len(combos))
    for _ in range(20):  # largest eigenvalue of A'A by power iteration, for the step
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = z = np.zeros(len(combos))
    t = 1.0
    target = histogram.astype(float)
    target[0] = 0
    for _ in range(steps):
        after = np.maximum(0, z - backward(forward(z) - target) / (1.05 * norm))
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) of sequences that use up the histogram: counts by length, index 0 unused."""
    left = histogram.astype(np.int64).copy()
    combos = combinations(np.flatnonzero(left[1:]) + 1, window)
    wanted = np.floor(solve_counts(combos, left) + 1e-9).astype(np.int64)
    out: list[tuple[int, tuple[int, ...]]] = []
    for j in np.argsort(-wanted, kind="stable"):
        if wanted[j] <= 0:
            break
        lengths = tuple(int(x) for x in combos[j] if x)
        fits = min([int(wanted[j]), *(int(left[x]) // lengths.count(x) for x in set(lengths))])
        if fits > 0:
            for x in lengths:
                left[x] -= fits
            out.append((fits, lengths))
    return out + greedy(left, window)


def greedy(left: np.ndarray, window: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, longest first; all pieces of a length and all open sequences of a shape are handled at once."""
    shapes: dict[int, list[list]] = {}
    for length in range(window - 1, 0, -1):
        count = int(left[length])
        for room in range(length, window):
            stack = shapes.get(room, [])
            while count and stack:
                repeats, lengths = stack.pop()
                each = min(room // length, count)
                take = min(repeats, count // each)
                if repeats > take:
                    stack.append([repeats - take, lengths])
                shapes.setdefault(room - each * length, []).append([take, lengths + [length] * each])
                count -= take * each
        each = window // length
        if count >= each:
            shapes.setdefault(window - each * length, []).append([count // each, [length] * each])
        if count % each:
            shapes.setdefault(window - count % each * length, []).append([1, [length] * (count % each)])
    return [(repeats, tuple(lengths)) for stack in shapes.values() for repeats, lengths in stack]


def slots(chosen: list[tuple[int, tuple[int, ...]]]) -> tuple[list[tuple], int]:
    """(length, from rank, to rank, sequence of the first, offset) for each place, and the number of sequences."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for repeats, lengths in chosen:
        offset = 0
        for x in lengths:
            rank = taken.get(x, 0)
            out.append((x, rank, rank + repeats, sequence, offset))
            taken[x] = rank + repeats
            offset += x
        sequence += repeats
    return out, sequence


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of all docs with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text and an id 0 at the end; each stands in
    exactly one piece, no piece is longer than the window, and the pieces of a sequence
    lie one after another from offset 0.

    - null and empty texts give one piece, the id 0 alone;
    - repeated rows and null ids are packed like any other row;
    - an empty table gives an empty result; other columns of docs are not looked at;
    - which pieces of equal length share a sequence follows the order of the input files.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.table(cut_pieces(docs, path or tokenizer_path(), window), "pieces")
    short = pieces.where(F.col("length") < window)
    counts = scratch.table(short.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(window, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # fewer rows than the window
        histogram[row["length"]] = row["n"]
    places, sequences = slots(plan(histogram, window))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranks = scratch.table(counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")), "ranks")
    schema = "slot_length long, low long, high long, first long, offset long"
    table = F.broadcast(spark.createDataFrame(places, schema))  # a few thousand rows: bounded by the window
    rank = F.col("nth") + F.col("earlier")
    packed = (
        short.join(ranks, ["length", "part"])
        .withColumn("rank", rank)
        .join(table, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("low"))
    )
    whole = pieces.where(F.col("length") == window).withColumns(
        {"sequence_id": F.lit(sequences) + F.col("part") * F.lit(2**31) + F.col("nth"), "offset": F.lit(0).cast(T.LongType())}
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return packed.select(columns).unionByName(whole.select(columns))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
