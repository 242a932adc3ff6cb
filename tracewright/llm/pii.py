"""Personal data by weak supervision.

Fixed patterns give the base spans, which always stay. Looser patterns, and matches of the
fixed ones that fail their checks, propose further candidates. Regex, gazetteer and context labelers vote on every span of either sort;
expectation-maximisation over the vote patterns, whose counts Spark sums over all
documents, estimates each labeler's reliability by kind (how often a check of digits fails on
a real number, or passes on another, is known and not estimated). The final classifier, Spark's logistic regression, is
trained on all spans of the corpus with the posteriors as soft labels. It sees what the labelers
don't: the words on both sides, the span's shape, its first digits or its ending, hashed into
FEATURES marks; of the votes it sees that of the check alone. Candidates that it accepts and that touch no base span are added.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, text_or_empty

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "surroundings", "shape")
ABSTAIN, NO, YES = 0, 1, 2

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # within a run of digits only its start can match
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SPELT = re.compile(r"\b[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\}|<at>)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|<dot>)\s?[A-Za-z0-9-]{1,63})+")
LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")

#: Gazetteers: endings of mail domains, ranges of first digits of card issuers, country calling codes.
ENDINGS = frozenset(
    "ai app at au be biz bg br ca cat ch cl cloud cn co com cz de dev dk edu ee es eu fi fr gov gr hk hr hu ie il in info int io ir is it jp ke kr lt lu lv ma me mil "
    "mx my name net ng nl no nz online org pe ph pk pl pro pt ro rs ru sa se sg shop si site sk store tech th tn tr tv tw ua uk us uy vn xyz za".split()
)
ISSUERS = (("2221", "2720"), ("300", "305"), ("34", "34"), ("3528", "3589"), ("36", "39"), ("4", "4"), ("50", "69"))
CALLING = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "211 212 213 216 218 220 221 225 227 233 234 237 243 244 250 251 254 255 256 260 263 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 "
    "382 385 386 387 389 420 421 423 502 503 504 505 506 507 509 591 593 595 598 852 853 855 880 886 960 961 962 963 964 965 966 967 968 971 972 973 974 977 994 995 998".split()
)
#: Of the check of digits: how often it fails on a real span (a slip of the pen), how often it passes on another.
CHECK = {"email": (0.02, 0.5), "ip": (0.002, 0.3), "card": (0.002, 0.1), "phone": (0.02, 0.5)}
FEATURES = 512
#: Words near a span that speak for a kind, and ones that speak against any.
NEAR = {
    "email": frozenset("mail email contact write reach address correo courriel kontakt".split()),
    "ip": frozenset("ip host server address login from client".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte tarjeta carte".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell whatsapp telefon telefono".split()),
}
AGAINST = frozenset("version isbn release chapter order invoice id ref".split())
NEAR_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[::-1]]
    return (sum(doubled[::2]) + sum(d * 2 - 9 * (d > 4) for d in doubled[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; found from their @ so that long runs of letters cost one look."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


def scanned(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(start, kind, end) of the fixed patterns by start and then kind as listed: those that pass their checks, and near misses."""
    out, missed = [(s, 0, e) for s, e in emails(text)] if "@" in text else [], []
    if NUMBER.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
            elif len(m[0]) <= 23:
                missed.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                (out if luhn(digits) else missed).append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            n = sum(c.isdigit() for c in m[0])
            if 9 <= n <= 15:
                out.append((m.start(), 3, m.end()))
            elif 6 <= n <= 18:
                missed.append((m.start(), 3, m.end()))
    return tuple([(s, KINDS[k], e) for s, k, e in sorted(found)] for found in (out, missed))


NUMBER = re.compile(r"[0-9]")


def candidates(text: str, base: list[tuple[int, str, int]], missed: list[tuple[int, str, int]]) -> list[tuple[int, str, int, int]]:
    """Looser matches (ABSTAIN) and near misses (NO) that touch no base span and no other candidate."""
    found = [(*span, NO) for span in missed]
    if "at" in text and re.search(r"[(\[{<]at[)\]}>]", text):
        found += [(m.start(), "email", m.end(), ABSTAIN) for m in SPELT.finditer(text)]
    if NUMBER.search(text):
        found += [(m.start(), "phone", m.end(), ABSTAIN) for m in LOCAL_PHONE.finditer(text)]
    ends = np.maximum.accumulate([0, *(e for _, _, e in base)])  # of the base spans before each, the furthest end
    starts, out = [s for s, _, _ in base], []
    for s, kind, e, check in sorted(found):
        if ends[bisect_left(starts, e)] <= s and (not out or s >= out[-1][2]):
            out.append((s, kind, e, check))
    return out


def votes(text: str, span: tuple[int, str, int], check: int) -> tuple[int, ...]:
    """What each of LABELERS says of a span; check: whether it passes the checks of a fixed pattern, if one matches."""
    start, kind, end = span
    body = text[start:end]
    digits = "".join(c for c in body if c.isdigit())
    near = set(NEAR_WORD.findall(text[max(0, start - 30) : start].lower()))
    if kind == "email":
        gazetteer = YES if re.split(r"[^A-Za-z]+", body.lower())[-1] in ENDINGS else NO
        shape = YES if len(body) <= 80 else NO
    elif kind == "ip":
        gazetteer = NO if body.split(".")[0].lstrip("0") in ("", "255") else YES
        shape = NO if body.startswith("0") else YES
    elif kind == "card":
        gazetteer = YES if any(a <= digits[: len(a)] <= b for a, b in ISSUERS) else NO
        shape = YES if len(digits) in (13, 14, 15, 16, 19) and len(set(digits)) > 3 else NO
    else:
        gazetteer = (NO if CALLING.isdisjoint((digits[:1], digits[:2], digits[:3])) else YES) if body.startswith("+") else ABSTAIN
        shape = YES if 9 <= len(digits) <= 13 else NO
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    return (
        check,
        gazetteer,
        NO if near & AGAINST else YES if near & NEAR[kind] else ABSTAIN,
        NO if any(c.isalnum() or c in "#$@_" for c in around) else YES,
        shape,
    )


def marks(text: str, span: tuple[int, str, int], check: int) -> list[int]:
    """What the classifier sees of a span, each hashed by kind and sort into FEATURES: check, words on both sides, shape, first digits or ending, length."""
    start, kind, end = span
    body = text[start : min(end, start + 200)]
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", body)))[:20]
    first = re.split(r"[^A-Za-z]+", text[max(start, end - 20) : end].lower())[-1] if kind == "email" else "".join(c for c in body if c.isdigit())[:2]
    before, after = (NEAR_WORD.findall(t.lower()) for t in (text[max(0, start - 30) : start], text[end : end + 20]))
    seen = ["", f"check {check}", f"shape {shape}", f"first {first}", f"size {min(20, (end - start) // 3)}", f"sides {text[max(0, start - 1) : start].isalnum()} {text[end : end + 1].isalnum()}"]
    seen += [f"before {w}" for w in before[-3:]] + [f"after {w}" for w in after[:2]]
    return sorted({zlib.crc32(f"{kind} {m}".encode()) % FEATURES for m in seen})


def look(docs: DataFrame) -> DataFrame:
    """doc_id and its spans: start, end, kind, votes, whether base, and its marks."""
    span = "struct<start:long,kind:int,end:long,base:boolean,votes:int,marks:array<int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_type = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.int32()), ("marks", pa.list_(pa.int32()))])
        for batch in batches:
            spans = []
            for text in batch.column(1):
                t, rows = text.as_py(), []
                base, missed = scanned(t)
                for *s, check in [*((*s, YES) for s in base), *candidates(t, base, missed)]:
                    code = sum(v * 3**i for i, v in enumerate(votes(t, s, check)))
                    rows.append({"start": s[0], "kind": KINDS.index(s[1]), "end": s[2], "base": check == YES, "votes": code, "marks": marks(t, s, check)})
                spans.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind_type))], names=["doc_id", "spans"])

    return docs.mapInArrow(run, f"doc_id long, spans array<{span}>")


def unpacked(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3**i % 3 for i in range(len(LABELERS))], 1)


def reliabilities(table: np.ndarray, counts: np.ndarray, check: tuple[float, float] | None = None, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior, P(vote | class) by labeler, and the posterior of each vote pattern: two-class expectation-maximisation.

    Posteriors start from the majority of votes; smoothing keeps labelers that rarely speak near chance. check: how often the first
    labeler says no of a real span and yes of another, where that is known.
    """
    n = table.shape[1]
    posterior = np.clip(0.5 + 0.2 * ((table == YES).sum(1) - (table == NO).sum(1)), 0.05, 0.95)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        given = np.stack([[[(weight[c] * (table[:, j] == v)).sum() + (2.0 if v == (NO, YES)[c] else 1.0) for v in range(3)] for j in range(n)] for c in range(2)])
        given /= given.sum(2, keepdims=True)
        if check:
            given[:, 0, NO], given[:, 0, YES] = (1 - check[1], check[0]), (check[1], 1 - check[0])
        spoken = table != ABSTAIN
        log = [np.log(p) + sum(np.where(spoken[:, j], np.log(given[c, j][table[:, j]]), 0.0) for j in range(n)) for c, p in ((0, 1 - prior), (1, prior))]
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return prior, given, posterior


def fit_spans(spans: DataFrame, target, ridge: float = 0.0003) -> list[float]:
    """Weight of each of FEATURES marks and the intercept, by Spark's logistic regression: a span counts for both classes, by the posterior of its votes (target)."""
    known = spans.select("marks", target.alias("p"))
    both = known.select(F.transform("marks", lambda m: m.cast("string")).alias("marks"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("c"))
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(FEATURES)], inputCol="marks", outputCol="features")
    model = LogisticRegression(maxIter=60, regParam=ridge, weightCol="weight", standardization=False).fit(vectors.transform(both.select("marks", "c.*")).select("features", "label", "weight"))
    return [*model.coefficients.toArray().tolist(), float(model.intercept)]


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id and spans, array of (start, kind, end, base, probability) by start and kind.

    Offsets are code points of the whole text, ends exclusive.

    - null and empty texts have no spans; null ids are passed on; repeated rows give repeated results;
    - base spans of different kinds may overlap; added ones touch no other span;
    - without any span in the corpus nothing is trained; an empty table gives an empty result;
    - columns of docs other than doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    seen = scratch.table(look(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))), "spans")
    spans = seen.select(F.explode("spans").alias("s")).select("s.*")
    patterns = spans.groupBy("kind", "votes").count().toPandas()  # kinds x 3^labelers rows at most
    weights = [0.0] * (FEATURES + 1)
    if len(patterns):
        kind, code, count = (patterns[c].to_numpy() for c in ("kind", "votes", "count"))
        soft = np.zeros(len(patterns))
        for k in np.unique(kind):
            soft[kind == k] = reliabilities(unpacked(code[kind == k]), count[kind == k].astype(float), CHECK[KINDS[k]])[2]
        keys = (kind * 3 ** len(LABELERS) + code).tolist()
        known = F.create_map(*(F.lit(v) for pair in zip(keys, soft.tolist(), strict=True) for v in pair))
        weights = fit_spans(spans, F.element_at(known, F.col("kind") * 3 ** len(LABELERS) + F.col("votes")))
    names, table = F.array(*(F.lit(k) for k in KINDS)), F.array(*(F.lit(w) for w in weights))
    named = lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("order"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end"), s["base"].alias("base"),
        (1 / (1 + F.exp(-F.aggregate(s["marks"], F.lit(weights[-1]), lambda total, m: total + F.get(table, m))))).alias("probability"),
    )
    kept = F.filter(F.transform("spans", named), lambda s: s["base"] | (s["probability"] >= threshold))
    return seen.select("doc_id", F.array_sort(kept).alias("spans"))


def written(spans) -> object:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(load(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(number(k) for k in KINDS),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
