"""A hidden Markov language model: Baum-Welch counts summed across partitions, exact likelihood by scaled forward recursion.

Tokens are words (ASCII lower case, split at ASCII white space) and one end token.
Word counts cover all training texts. The most frequent words are emitted by the
states themselves; every other word belongs to a bucket by its hash, states emit the
bucket, and the bucket emits the word by its smoothed count. Vocabulary of any size is
thus scored exactly, while the states' tables stay bounded. Words outside the bounded
dictionary that tasks hold meet their counts in a join.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fold, load, text_or_empty

LOG10 = float(np.log(10))


@dataclasses.dataclass(frozen=True)
class Settings:
    states: int = 8
    head: int = 4095  # words with emissions of their own
    dictionary: int = 131072  # words whose counts every task holds
    buckets: int = 512
    rounds: int = 4  # over all training documents, at most
    tolerance: float = 1e-4  # training ends when a round adds less than this share to the log likelihood
    cells: int = 400_000  # positions of which a task holds the states' probabilities at once
    width: int = 1024  # sequences of a padded batch
    seed: int = 7

    @property
    def symbols(self) -> int:
        """0 is the end token, then the head words, then the buckets."""
        return 1 + self.head + self.buckets


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits


def count_words(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """(word, count) over all texts; the empty word stands for the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "count"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
                if len(seen) > flush:
                    yield out()
                    seen.clear()
            seen[b""] += batch.num_rows
        if seen:
            yield out()

    partial = docs.select("text").mapInArrow(run, "word binary, count long")
    return partial.groupBy("word").agg(F.sum("count").alias("count"))


class Lexicon:
    """The dictionary as tasks use it: id by word, symbol by id, and the log terms that need no join."""

    def __init__(self, s: Settings, words: list[bytes], counts: list[int], total: int, distinct: int, bucket_mass, bucket_kinds):
        self.s, self.words = s, words
        ids = np.arange(len(words) + 1)
        count = np.array([counts[0], *counts[1:]], float) if words else np.zeros(0)
        n = len(words)
        self.symbol = np.zeros(n, np.int32)
        self.symbol[:] = ids[:n]
        rare = ids[:n] > s.head
        bucket = np.array([zlib.crc32(w) % s.buckets for w in words], np.int64) if n else np.zeros(0, np.int64)
        self.symbol[rare] = 1 + s.head + bucket[rare]
        self.known = count > 0
        self.base = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))
        self.inside = np.where(rare, np.log10((count + 0.5) / (bucket_mass + 0.5 * (bucket_kinds + 1))[bucket]) if n else 0.0, 0.0)

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


def most_frequent(words: DataFrame, most: int) -> list:
    """The most frequent words, of equal counts the first ones: most of them, or all there are; by descending count, then word.

    Only a histogram of counts by magnitude and the chosen words reach the driver, however many partitions there are.
    """
    size = F.floor(F.log2(F.col("count")) * 16)
    left, chosen = most, []
    for row in sorted(words.groupBy(size.alias("size")).count().collect(), reverse=True):  # 16 rows for each doubling
        if row["count"] > left:  # of the counts that are too many the largest, by no more than the sort of what is left
            chosen += words.where(size == row["size"]).orderBy(F.desc("count"), "word").limit(left).collect() if left else []
            break
        left -= row["count"]
        least = row["size"]
    if left < most:
        chosen += words.where(size >= least).collect()
    return sorted(chosen, key=lambda r: (-r["count"], bytes(r["word"])))


def encode(docs: DataFrame, lexicon, s: Settings) -> DataFrame:
    """One row per document: its symbols, the sums over dictionary words, and the words outside it."""
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, symbols binary, tail array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = lexicon.value
        get, row = lex.index().get, TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, out = batch.slice(at, 1000), []
                for doc_id, held, text in zip(*part.columns, strict=True):
                    words = words_of(text.as_py())
                    ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
                    ids = np.append(ids, np.int32(0))
                    unknown = np.flatnonzero(ids < 0)
                    tail = [words[i] for i in unknown]
                    inner = ids[ids >= 0]
                    symbols = lex.symbol[ids]
                    if tail:
                        symbols[unknown] = [1 + s.head + zlib.crc32(w) % s.buckets for w in tail]
                    out.append(
                        (row, doc_id.as_py(), held.as_py(), len(ids), int(lex.known[inner].sum()), float(lex.base[inner].sum()), float(lex.inside[inner].sum()), symbols.astype("<u2").tobytes(), tail)
                    )
                    row += 1
                types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def padded(sequences: list[np.ndarray], cells: int, width: int = 1024) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Batches of similar length: positions, symbols (batch x time), lengths in descending order."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        take = order[at : at + max(1, min(width, cells // longest))]
        lengths = np.array([len(sequences[i]) for i in take])
        grid = np.zeros((len(take), longest), np.int32)
        for k, i in enumerate(take):
            grid[k, : lengths[k]] = sequences[i]
        yield take, grid, lengths
        at += len(take)


def reaching(lengths: np.ndarray, longest: int) -> np.ndarray:
    """How many of the sequences, longest first, have a symbol at each time."""
    return np.searchsorted(-lengths, -np.arange(longest), side="left")


def steps(model, grid, live, begin: int, stop: int, alpha):
    """Scaled forward recursion from time begin to before stop; alpha: that of the time before. Alphas and scales by time."""
    start, move, emit = model
    n = live[begin]
    alphas, scales = np.zeros((stop - begin, n, len(start))), np.ones((stop - begin, n))
    for t in range(begin, stop):
        n = live[t]
        alpha = start * emit[grid[:n, t]] if t == 0 else (alpha[:n] @ move) * emit[grid[:n, t]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        alphas[t - begin, :n], scales[t - begin, :n] = alpha, scale
    return alphas, scales


def forward(model, grid, lengths) -> np.ndarray:
    """Natural-log likelihoods of the sequences of a padded batch."""
    start, move, emit = model
    batch, longest = grid.shape
    loglik, live, alpha = np.zeros(batch), reaching(lengths, longest), None
    for t in range(longest):
        n = live[t]
        alpha = start * emit[grid[:n, t]] if t == 0 else (alpha[:n] @ move) * emit[grid[:n, t]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        loglik[:n] += np.log(scale)
    return loglik


def expected_counts(model, sequences, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of some sequences: starts, moves, emissions (symbols x states), log likelihood.

    A batch longer than s.cells allows is held a stretch of time at once: a first run keeps the alphas before each stretch,
    from which those inside are computed again on the way back.
    """
    start, move, emit = model
    k = len(start)
    starts, moves, emissions, total = np.zeros(k), np.zeros((k, k)), np.zeros((s.symbols, k)), 0.0
    for _, grid, lengths in padded(sequences, s.cells, s.width):
        batch, longest = grid.shape
        live = reaching(lengths, longest)
        stretch = max(1, s.cells // batch)
        cuts = list(range(0, longest, stretch))
        before, held = [None], None
        for begin in cuts:
            held = steps(model, grid, live, begin, min(longest, begin + stretch), before[-1])
            total += np.log(held[1]).sum()
            before.append(held[0][-1])
        beta, ahead_scale = np.ones((batch, k)), None
        for at in range(len(cuts) - 1, -1, -1):
            begin, stop = cuts[at], min(longest, cuts[at] + stretch)
            alphas, scales = held if at == len(cuts) - 1 else steps(model, grid, live, begin, stop, before[at])
            gamma = np.zeros((stop - begin, live[begin], k))
            for t in range(stop - 1, begin - 1, -1):
                n = live[t]
                if t + 1 < longest and (m := live[t + 1]):
                    ahead = emit[grid[:m, t + 1]] * beta[:m] / ahead_scale[:m, None]
                    moves += alphas[t - begin, :m].T @ ahead
                    beta[:m] = ahead @ move.T
                gamma[t - begin, :n] = alphas[t - begin, :n] * beta[:n]
                ahead_scale = scales[t - begin]
            if begin == 0:
                starts += gamma[0].sum(0)
            flat = grid[: live[begin], begin:stop].T.ravel()  # padding has gamma 0
            for j in range(k):
                emissions[:, j] += np.bincount(flat, gamma[:, :, j].ravel(), s.symbols)
    return starts, moves * move, emissions, total


def round_of_training(encoded: DataFrame, model, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Counts of all rows of encoded, summed by Spark: one row per symbol and task, merged before they reach the driver."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(model)
    k, size = s.states, s.symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            sequences = [np.frombuffer(x.as_py(), "<u2") for x in batch.column(0)]
            if sequences:
                got = expected_counts(shared.value, sequences, s)
                sums = got if sums is None else tuple(a + b for a, b in zip(sums, got, strict=True))
        if sums is not None:
            starts, moves, emissions, total = sums
            table = np.concatenate([emissions, moves, starts[None], np.full((1, k), total)])
            used = np.flatnonzero(table.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(table[used, j]) for j in range(k))], names=["at", *(f"c{j}" for j in range(k))])

    rows = (
        encoded.select("symbols")
        .mapInArrow(run, "at long, " + ", ".join(f"c{j} double" for j in range(k)))
        .groupBy("at")
        .agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(k)))
        .collect()  # symbols + states + 2 rows at most
    )
    table = np.zeros((size + k + 2, k))
    for row in rows:
        table[row["at"]] = row[1:]
    shared.unpersist()
    return table[size + k], table[size : size + k], table[:size], float(table[-1, 0])


def maximised(counts, unigram: np.ndarray, prior: float = 20.0):
    starts, moves, emissions, _ = counts
    start, move = starts + 1, moves + 1
    emit = emissions + prior * unigram[:, None]
    return start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)


def initial(unigram: np.ndarray, s: Settings):
    rng = np.random.default_rng(s.seed)
    move = np.full((s.states, s.states), 0.1 / max(1, s.states - 1))
    np.fill_diagonal(move, 0.9)
    emit = unigram[:, None] * np.exp(rng.normal(0, 1, (len(unigram), s.states)))
    return np.full(s.states, 1 / s.states), move / move.sum(1, keepdims=True), emit / emit.sum(0)


def fitted_model(training: DataFrame, unigram: np.ndarray, s: Settings):
    """The model after rounds of training over all of training; without tokens there the first one."""
    model, was = initial(unigram, s), None
    for _ in range(s.rounds):
        counts = round_of_training(training, model, s)
        if not counts[2].any():
            break
        model = maximised(counts, unigram)
        if was is not None and counts[3] - was < s.tolerance * abs(was):
            break
        was = counts[3]
    return model


def score_texts(docs: DataFrame, settings: Settings = Settings(), held_fold: int = 1, folds: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those whose crc32(doc_id as text) mod folds is not held_fold.
    score is log10 of the model's probability of the whole token sequence, end token included.

    - null and empty texts are the end token alone;
    - null ids are never held out; repeated rows count as often as they occur, in training too;
    - without training texts the word counts are all 0 and scores stay finite;
    - an empty table gives an empty result; other columns of docs are not looked at.
    """
    s, spark = settings, docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold("doc_id", folds) == held_fold).alias("held_out"),
        text_or_empty().alias("text"),
    )
    words = scratch.table(count_words(rows.where(~F.col("held_out"))), "words")
    in_bucket = F.crc32("word") % s.buckets
    total, distinct = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    real = words.where(F.length("word") > 0)
    top = most_frequent(real, s.dictionary)
    ends = words.where(F.length("word") == 0).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    least = top[min(s.head, len(top)) - 1] if top else None
    mass, kinds = np.zeros(s.buckets), np.zeros(s.buckets)
    after = F.lit(True)  # words after the head, in the order of the dictionary
    if least:
        after = (F.col("count") < least["count"]) | ((F.col("count") == least["count"]) & (F.col("word") > F.lit(least["word"])))
    for row in real.where(after).groupBy(in_bucket.alias("b")).agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect():
        mass[row["b"]], kinds[row["b"]] = row["n"], row["v"]
    lexicon = Lexicon(s, [b"", *(bytes(r["word"]) for r in top)], [ends, *(r["count"] for r in top)], total, distinct, mass, kinds)
    shared = spark.sparkContext.broadcast(lexicon)
    encoded = scratch.table(encode(rows, shared, s), "encoded")

    unigram = np.full(s.symbols, 0.5)
    for i, n in enumerate([ends, *(r["count"] for r in top[: s.head])]):
        unigram[i] += n
    unigram[1 + s.head :] += mass
    unigram /= unigram.sum()
    model = fitted_model(encoded.where(~F.col("held_out")), unigram, s)

    fitted = spark.sparkContext.broadcast(model)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = [np.frombuffer(x.as_py(), "<u2") for x in batch.column(1)]
            out = np.zeros(len(sequences))
            for take, grid, lengths in padded(sequences, s.cells, s.width):
                out[take] = forward(fitted.value, grid, lengths) / LOG10
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["row", "path"])

    columns = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside"]

    def with_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = next(likelihood(iter([batch.select(["row", "symbols"])])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), path.column(1)], names=[*columns, "path"])

    whole = encoded.select(*columns, "symbols").mapInArrow(
        with_path, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, path double"
    )
    bucket_total = F.array(*(F.lit(float(x)) for x in mass + 0.5 * (kinds + 1)))
    tails = (
        encoded.select("row", F.explode("tail").alias("word"))
        .join(words, "word", "left")
        .select("row", F.coalesce("count", F.lit(0)).alias("c"), F.get(bucket_total, in_bucket.cast("int")).alias("bucket_total"))
        .groupBy("row")
        .agg(
            F.sum((F.col("c") > 0).cast("long")).alias("tail_known"),
            F.sum(F.log10((F.col("c") + 0.5) / F.lit(total + 0.5 * (distinct + 1)))).alias("tail_base"),
            F.sum(F.log10((F.col("c") + 0.5) / F.col("bucket_total"))).alias("tail_inside"),
        )
    )
    none = F.lit(0.0)
    return whole.join(tails, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", none)).alias("base_score"),
        (F.col("path") + F.col("inside") + F.coalesce("tail_inside", none)).alias("score"),
    )


def op2_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(load(spark, sf_dir, "documents"))
