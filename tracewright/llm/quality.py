"""A quality classifier by positive-unlabelled learning.

Features are shares of bytes and of transitions between byte classes, and a few
measures of words and lines, so they see a whole text at the price of one pass. A linear
function g of them minimises the non-negative unbiased risk

    prior * E_p[loss(g, 1)] + max(0, E_u[loss(g, -1)] - prior * E_p[loss(g, -1)])

over trusted positives p (labelled 1) and unlabelled web text u, which is every training
row; labels 0 are not used. The loss is (g - sign)^2 / 4, so the risk depends on the
rows by their first and second moments alone: Spark sums these over all rows in
one pass, and the driver, which sees only the sums, finds the minimum exactly. Where the unbiased
minimum has a negative second part, the solution lies where that part is 0.

The class prior is estimated from positives and unlabelled rows too: among the rows above
a threshold the share of the unlabelled is at least prior times that of the positives, for
any threshold, so it is at most the smallest such quotient. The score is a logistic function of g
centred where the share of unlabelled rows above is the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, fold, load, text_or_empty

CLASSES = 10
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    positives: int = 12_000  # labelled positives that the fit sees at most; unlabelled rows have no bound
    ridge: float = 0.1
    ridge_positives: float = 20.0  # over the number of positives, added to ridge
    slope: float = 6.0
    bins: int = 4000  # of the histogram of margins from -RANGE to RANGE
    seed: int = 3


RANGE = 4.0


def _byte_classes() -> np.ndarray:
    out = np.full(256, 8, np.intp)  # other ASCII signs
    for k, chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:'", b'"()-', b"!?"]):
        out[list(chars)] = k
    out[128:] = 9
    return out


_CLASS = _byte_classes()
WIDTH = 256 + CLASSES * CLASSES + 8


def features(text: str) -> np.ndarray:
    """WIDTH numbers of a whole text; the empty text gives zeros."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(WIDTH, np.float32)
    n = len(raw)
    if not n:
        return out
    out[:256] = np.sqrt(np.bincount(raw, minlength=256) / n)
    kinds = _CLASS[raw]
    out[256 : 256 + CLASSES * CLASSES] = np.sqrt(np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES) / n)
    words, lines = text.split(), text.split("\n")
    distinct = len(set(words))
    w = max(1, len(words))
    out[-8:] = [np.log1p(n), np.log1p(len(words)), n / w / 10, distinct / w, np.log1p(w) - np.log1p(distinct), len(set(lines)) / len(lines), np.log1p(len(lines)), n / len(lines) / 1000]
    return out


@dataclass(frozen=True)
class Model:
    """Standardised features and a constant, their weights, and the margin at which the score is one half."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    centre: float
    slope: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights[:-1] + self.weights[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.margin(x) - self.centre), -30, 30)))


@dataclass(frozen=True)
class Moments:
    """Means of the standardised features with a constant, and of their products."""

    first: np.ndarray
    second: np.ndarray

    def loss(self, w: np.ndarray, sign: int) -> float:
        """The mean of (g - sign)^2 / 4 with g = features @ w."""
        return float(w @ self.second @ w - 2 * sign * (w @ self.first) + 1) / 4

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        return Moments(x.mean(0), x.T @ x / len(x))


def positive_part(w: np.ndarray, p: Moments, prior: float) -> float:
    return prior * p.loss(w, 1)


def negative_part(w: np.ndarray, p: Moments, u: Moments, prior: float) -> float:
    return u.loss(w, -1) - prior * p.loss(w, -1)


def minimise(p: Moments, u: Moments, prior: float, ridge: float) -> np.ndarray:
    """w of the least positive part + max(0, negative part) + ridge * |w but its constant|^2 / 4.

    With a weight t of 0 to 1 on the negative part the sum is convex, and its minimum a linear system. The solution is that of t = 1 or,
    if the negative part is below 0 there, that of the t at which it is 0.
    """
    penalty = np.diag(np.append(np.full(len(p.first) - 1, ridge), 1e-9))

    def at(t: float) -> np.ndarray:
        return np.linalg.solve(prior * (1 - t) * p.second + t * u.second + penalty, prior * (1 + t) * p.first - t * u.first)

    low, high = 0.0, 1.0
    if negative_part(at(1.0), p, u, prior) < 0:
        for _ in range(50):
            middle = (low + high) / 2
            if negative_part(at(middle), p, u, prior) < 0:
                high = middle
            else:
                low = middle
    return at(high)


def density_ratio(p: Moments, u: Moments, ridge: float) -> np.ndarray:
    """w of the least-squares fit of features @ w to the density of positives over that of unlabelled rows."""
    return np.linalg.solve(u.second + np.diag(np.append(np.full(len(p.first) - 1, ridge), 1e-9)), p.first)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The smallest quotient of shares of unlabelled rows and positives above a threshold that half of the positives pass; histograms of a margin by bins."""
    above = [np.cumsum(x[::-1])[::-1] / max(1, x.sum()) for x in (positive, unlabelled)]
    enough = above[0] >= 0.5
    return float(np.clip((above[1][enough] / above[0][enough]).min(), 0.02, 0.98))


def bins_of(margin: np.ndarray, bins: int) -> np.ndarray:
    return np.clip(((margin + RANGE) * bins / (2 * RANGE)).astype(np.int64), 0, bins - 1)


def summed(vectors: DataFrame, size: int, of) -> np.ndarray:
    """The sum of of(rows of features) over all vectors: size numbers a task, added up by Spark before they reach the driver."""
    width = 1024

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-size // width) * width)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.column(0).slice(at, 2000).to_pylist()
                total[:size] += of(np.frombuffer(b"".join(part), np.float16).reshape(len(part), WIDTH).astype(np.float32))
        rows = total.reshape(-1, width)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(rows[used]), pa.list_(pa.float64()))], names=["at", "part"])

    out = np.zeros((-(-size // width), width))
    parts = vectors.mapInArrow(run, "at long, part array<double>").select("at", array_to_vector("part").alias("part"))
    for row in parts.groupBy("at").agg(Summarizer.sum(F.col("part")).alias("part")).collect():  # size / width rows
        out[row["at"]] = row["part"].toArray()
    return out.ravel()[:size]


def train(docs: DataFrame, labels: DataFrame, training: Column, settings: Settings = Settings()) -> Model | None:
    """A model from rows of docs for which training holds; None if no training row is labelled 1.

    labels: doc_id, quality (1: good); of repeated labels the largest counts, null ones don't. Of rows that share a labelled id the least text is learnt from.
    """
    s, spark = settings, docs.sparkSession
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1")
    chosen = bounded_sample(known.where(training), "doc_id", s.positives, s.seed)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    trusted = rows.join(F.broadcast(chosen.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # one text an id: bounded by settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                x = [features(t.as_py()).astype(np.float16).tobytes() for t in batch.column(0).slice(at, 2000)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary())], names=["x"])

    got = sorted(bytes(r["x"]) for r in trusted.select("text").mapInArrow(run, "x binary").collect())
    if not got:
        return None
    x = np.frombuffer(b"".join(got), np.float16).reshape(len(got), WIDTH).astype(float)
    unlabelled = rows.where(training & F.col("doc_id").isNotNull()).select("text")
    scratch = Scratch(spark)
    vectors = scratch.table(unlabelled.mapInArrow(run, "x binary"), "features")

    def products(f: np.ndarray) -> np.ndarray:
        f = np.append(f, np.ones((len(f), 1), np.float32), 1)
        return (f.T @ f).ravel()

    total = summed(vectors, (WIDTH + 1) ** 2, products).reshape(WIDTH + 1, WIDTH + 1)
    total /= total[-1, -1]
    mean = total[-1, :-1]
    spread = np.sqrt(np.maximum(0, np.diag(total)[:-1] - mean**2)) + 0.02  # rare bytes must not dominate
    scale = np.diag(np.append(1 / spread, 1.0))
    scale[-1, :-1] = -mean / spread
    u = Moments((total @ scale)[-1], scale.T @ total @ scale)

    def standardised(f: np.ndarray) -> np.ndarray:
        return np.append((f - mean) / spread, np.ones((len(f), 1)), 1)

    def histograms(*weights: np.ndarray) -> np.ndarray:
        def of(f: np.ndarray) -> np.ndarray:
            return np.concatenate([np.bincount(bins_of(standardised(f) @ w, s.bins), minlength=s.bins) for w in weights]).astype(float)

        return summed(vectors, len(weights) * s.bins, of).reshape(-1, s.bins)

    z = standardised(x)
    ridge = s.ridge + s.ridge_positives / len(z)
    half = np.arange(len(z)) % 2 == 0  # a ratio fitted on one half of the positives is measured on the other
    halves = (half, ~half) if len(z) > 1 else (half, half)
    ratios = [density_ratio(Moments.of(z[h]), u, ridge) for h in halves]
    held = [np.bincount(bins_of(z[h] @ w, s.bins), minlength=s.bins) for h, w in zip(halves[::-1], ratios, strict=True)]
    prior = float(np.mean([class_prior(a, b) for a, b in zip(held, histograms(*ratios), strict=True)]))
    weights = minimise(Moments.of(z), u, prior, ridge)
    below = np.cumsum(histograms(weights)[0])
    centre = (np.searchsorted(below, (1 - prior) * below[-1]) + 1) * 2 * RANGE / s.bins - RANGE
    scratch.drop("features")
    return Model(mean, spread, weights, float(centre), s.slope, prior)


def score_column(spark: SparkSession, model: Model | None) -> Column:
    """The score of column text: 0 to 1, higher where label 1 is likelier; 0.5 without a model."""
    if model is None:
        return F.lit(0.5)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for at in range(0, len(texts), 1000):
            part = texts.iloc[at : at + 1000]
            out[at : at + len(part)] = shared.value.probability(np.stack([features(t) for t in part]))
        return pd.Series(out)

    return score(text_or_empty())


def classify(docs: DataFrame, labels: DataFrame, held_fold: int = 0, folds: int = 5, threshold: float = THRESHOLD, settings: Settings = Settings()) -> DataFrame:
    """All rows and columns of docs, with the columns quality_held_out, quality_score and quality_predicted added.

    - null texts count as empty and get the empty text's score; null ids are never learned from;
    - repeated rows get equal scores; of repeated labels the largest counts;
    - without labelled training positives every score is 0.5; an empty table gives an empty result;
    - columns of docs with the added names are replaced; others are kept and not looked at.
    """
    in_held = fold("doc_id", folds) == held_fold
    model = train(docs, labels, ~in_held, settings)
    scored = docs.withColumn("quality_score", score_column(docs.sparkSession, model))
    return scored.withColumns({"quality_held_out": in_held, "quality_predicted": (F.col("quality_score") >= threshold).cast("int")})


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", F.col("quality_held_out").alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted")
    )
