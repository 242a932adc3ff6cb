"""Mixing sources to target weights by iterative proportional fitting (DataFrame and SQL functions only).

Tokens are summed over cells of (source, language, topic). Raking multiplies the cells'
weights in turn so that each margin meets its target shares; a document is then kept
with the probability its cell's weight per token calls for, by a hash of its id, so the
kept tokens have the target mix in expectation. All steps after the first run over
cells, whose number does not depend on the number of documents.

Without a share to keep, the scale is that of the registered SQL: the cell of the
largest weight per token is kept whole, so one rare cell decides how much of the rest
is. With a share, so many tokens are kept: raking goes on with each cell bounded by the
tokens it has, and the cells left are scaled up until the kept tokens add to the share.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, load, text_or_empty

MARGINS = ("source", "lang", "topic")
#: Targets of a margin are its shares of tokens to these powers: 1 keeps the mix, 0 makes it even.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.9}
ROUNDS = 10
UNMET = 0.01
TOLERANCE = 1e-8
ONE_TASK = 100_000  # cells, not documents, that one task rakes
SEED = "mix-1"


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column) -> Column:
    """A stand-in topic where the corpus has none: the register of a text, by its signs."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda sign: (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))) / size
    return (
        F.when(share("|") >= 0.01, "table")
        .when(share("!") >= 0.02, "shout")
        .when(share("@") > 0, "contact")
        .when(F.length(text) < 1000, "note")
        .otherwise("prose")
    )


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, rounds: int = ROUNDS, share: float | None = None, tolerance: float = TOLERANCE, most: int = 8
) -> DataFrame:
    """cells (the margins' columns, tokens) with weight: in proportion to tokens, each margin as in targets (margin, target share).

    Margins are met in turn. After every so many rounds the weights are written, until the last round has changed none by more than
    tolerance of their sum, or as many tables as most are written. Shares of values that no cell has are left out. A warning tells where a margin
    ends more than UNMET off its target, as the cells or the tokens there are cannot meet it.
    With share, weights are tokens to keep, that share of all, and no cell's is more than it has.
    """
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    budget = None if share is None else share * (cells.agg(F.sum("tokens")).first()[0] or 0)
    for margin, target in targets.items():
        out = out.join(target.select(margin, F.col("target").alias(f"target_{margin}")), margin)
    few = cells.count() <= ONE_TASK  # these need no shuffle; more are dealt by each margin in turn
    for k in range(most):
        out = out.coalesce(1) if few else out
        for _ in range(rounds):
            out = out.withColumn("was", F.col("weight"))
            for margin in targets:
                total = F.sum("weight").over(W.partitionBy(margin))
                met = F.col("weight") * F.col(f"target_{margin}") / total
                if budget is not None:
                    met = F.least(met * F.lit(float(budget)), F.col("tokens").cast("double"))
                out = out.withColumn("weight", F.when(total > 0, met).otherwise(0.0))
        out = scratch.table(out, f"raked_{k}")
        moved, whole = out.agg(F.max(F.abs(F.col("weight") - F.col("was"))), F.sum("weight")).first()
        if not whole or moved <= tolerance * whole:
            break
    for margin in targets if whole else ():
        sums = out.groupBy(margin).agg(F.sum("weight").alias("weight"), F.first(f"target_{margin}").alias("target"))
        wanted = sums.agg(F.sum("target")).first()[0]
        off = sums.agg(F.max(F.abs(F.col("weight") / F.lit(whole) - F.col("target") / F.lit(wanted)))).first()[0] if wanted else 0.0
        if off > UNMET:
            warnings.warn(f"{margin}: the cells cannot meet all targets at once; a share is {off:.3f} off its target", stacklevel=2)
    return out.drop("was", *(f"target_{m}" for m in targets))


def filled(weighed: DataFrame, share: float) -> DataFrame:
    """weighed (margins, tokens, weight, ratio) with probability = min(1, c * ratio), c such that tokens * probability add to share of all tokens.

    c is what the cells below 1 need once those at 1 are kept whole; as c grows, more of them reach 1, until none does.
    """
    tokens = lambda where: F.coalesce(F.sum(F.when(where, F.col("tokens"))), F.lit(0))
    all_tokens = weighed.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    c = 0.0
    while True:
        whole = (F.col("ratio") > 0) & (F.lit(c) * F.col("ratio") >= 1)
        scaled, above = weighed.agg(F.coalesce(F.sum(F.when((F.col("ratio") > 0) & ~whole, F.col("weight"))), F.lit(0.0)), tokens(whole)).first()
        needed = (share * all_tokens - above) / scaled if scaled > 0 else float("inf")
        if scaled == 0 or needed <= c * (1 + 1e-12):
            c = max(c, needed)
            break
        c = needed
    probability = F.when(F.col("ratio") > 0, F.least(F.lit(1.0), F.lit(c) * F.col("ratio"))).otherwise(0.0)
    return weighed.select(*MARGINS, probability.alias("probability"))


def to_top(weighed: DataFrame) -> DataFrame:
    """weighed with probability = ratio over the largest ratio, to six places."""
    top = weighed.agg(F.max("ratio")).first()[0]
    return weighed.select(*MARGINS, F.round(F.col("ratio") / F.lit(top) if top else F.lit(0.0), 6).alias("probability"))


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares of a margin: its token shares to a power, summing to 1."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("n"))
    wanted = sums.select(margin, F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(power))).otherwise(0.0).alias("wanted"))
    whole = wanted.agg(F.sum("wanted")).first()[0]
    return wanted.select(margin, (F.col("wanted") / F.lit(whole) if whole else F.lit(0.0)).alias("target"))


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, seed: str = SEED, share: float | None = None
) -> DataFrame:
    """One row per row of docs: doc_id, source, lang, topic, n_tokens, probability, sampled.

    probability is in proportion to weight per token of the document's cell, the largest being 1;
    with share (over 0, 1 at most) such that share of all tokens is kept in expectation, cells that would
    need more than they have being kept whole.

    - null source, language: "unknown"; null texts count as empty; documents without tokens
      have no part in the mix: probability 0 unless their cell has tokens;
    - null ids share one hash and are kept or not together, as are repeated rows;
    - an empty table gives an empty result; columns of docs other than doc_id, text, source, lang are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    text = text_or_empty()
    rows = scratch.table(docs.select("doc_id", unknown("source"), unknown("lang"), topic(text).alias("topic"), tokens(text).alias("n_tokens")), "rows")
    cells = scratch.table(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    targets = targets or {m: tempered(cells, m, powers[m]) for m in MARGINS}
    weighed = scratch.table(rake(cells, targets, scratch, rounds, share), "weights").withColumn("ratio", F.coalesce(F.try_divide("weight", "tokens"), F.lit(0.0)))
    calibrated = scratch.table(to_top(weighed) if share is None else filled(weighed, share), "calibrated")
    return rows.join(calibrated, list(MARGINS)).select("doc_id", *MARGINS, "n_tokens", "probability", (draw(seed) < F.col("probability")).alias("sampled"))


def draw(seed: str) -> Column:
    """A number in [0, 1) from the seed and the id: the first 32 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


def mix_sql(powers: dict[str, float] = POWERS, rounds: int = ROUNDS, seed: str = SEED) -> str:
    share = lambda sign: f"(length(t) - length(replace(t, '{sign}', ''))) / greatest(length(t), 1)::DOUBLE"
    parts = [
        "texts AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, coalesce(text, '') AS t FROM documents)",
        f"""rows_ AS (SELECT doc_id, source, lang,
            CASE WHEN {share("|")} >= 0.01 THEN 'table' WHEN {share("!")} >= 0.02 THEN 'shout' WHEN {share("@")} > 0 THEN 'contact'
                 WHEN length(t) < 1000 THEN 'note' ELSE 'prose' END AS topic,
            len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM texts)""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM rows_ GROUP BY ALL)",
    ]
    for m in MARGINS:
        parts.append(f"n_{m} AS (SELECT {m}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens)::DOUBLE, {powers[m]}) ELSE 0 END AS w FROM cells GROUP BY {m})")
        parts.append(f"t_{m} AS (SELECT {m}, w / sum(w) OVER () AS target_{m} FROM n_{m})")
    parts.append("k0 AS (SELECT *, tokens::DOUBLE AS weight FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    k = 0
    for _ in range(rounds):
        for m in MARGINS:
            total = f"sum(weight) OVER (PARTITION BY {m})"
            parts.append(f"k{k + 1} AS (SELECT * EXCLUDE (weight), CASE WHEN {total} > 0 THEN weight * target_{m} / {total} ELSE 0 END AS weight FROM k{k})")
            k += 1
    parts.append(f"r AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS ratio FROM k{k})")
    parts.append("p AS (SELECT source, lang, topic, round(ratio / (SELECT max(ratio) FROM r), 6) AS probability FROM r)")
    hashed = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0"
    return f"WITH {', '.join(parts)} SELECT doc_id, source, lang, topic, n_tokens, probability, {hashed} < probability AS sampled FROM rows_ JOIN p USING (source, lang, topic)"
