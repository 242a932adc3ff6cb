"""Repair in tiers of functions: a tier's candidates are made and validated only for bugs that no earlier tier has solved.

The loop runs over tiers, not bugs: each round is one Spark job over all bugs that are still open, and writes what it found. Tiers hold one
function a bug at first and then twice as many each time, so the number of rounds grows with the logarithm of the longest list of functions.
A job that is started again over the same folder goes on behind the last table that was written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import Stages
from . import repair

#: Functions that are a tier of their own, before tiers grow.
SINGLE = 4


def tier_of(order: Column, single: int = SINGLE) -> Column:
    """1, 2, ... for the first functions; behind them tiers of one, two, four, ... functions."""
    return F.when(order <= single, order).otherwise(single + 1 + F.floor(F.log2(order - single + 0.0))).cast("int")


def repaired_in_tiers(
    engine: str, scores: DataFrame, sources: DataFrame, bugs: DataFrame, make: Callable[[DataFrame], DataFrame], validator: repair.Validator,
    folder: str | None = None, single: int = SINGLE,
) -> DataFrame:
    """RESULT and n_validated (candidates that reached the validator), row by row what result_rows() gives for all candidates at once.

    make turns targets into candidates, as prompted() and mutated() do. Under folder each tier leaves its candidates and its attempts;
    without one they go to the session's shared folder. Bugs are not null; a bug without functions to try is in no tier.
    """
    stages = Stages(scores.sparkSession, folder)
    found = repair.targets(scores, sources).withColumn("tier", tier_of(F.col("method_order"), single))
    targets = stages.write(found.drop("text"), "targets")
    tiers = sorted(r["tier"] for r in targets.select("tier").distinct().collect())  # a logarithm of a bug's functions
    tried: list[DataFrame] = []
    for tier in tiers:
        open_ = targets.where(F.col("tier") == tier).drop("tier")
        for before in tried:
            open_ = open_.join(before.where("reached = 'success'"), "bug_id", "left_anti")
        if open_.isEmpty():
            continue
        candidates = stages.write(make(open_.join(sources.select("bug_id", "text"), "bug_id")), f"candidates-{tier}")
        if candidates.isEmpty():
            continue
        counts = candidates.groupBy("bug_id").agg(F.count("*").alias("n_validated"))
        tried.append(stages.write(repair.attempts(candidates, validator(candidates)).join(counts, "bug_id").withColumn("tier", F.lit(tier)), f"tier-{tier}"))
    if not tried:
        return repair.finished(engine, scores, sources, bugs, targets, _no_attempts(scores)).withColumn("n_validated", F.lit(0).cast("long"))
    every = tried[0]
    for more in tried[1:]:
        every = every.unionByName(more)
    last = every.groupBy("bug_id").agg(F.max("tier").alias("tier"), F.sum("n_validated").alias("n_validated"))  # a solved bug has no later tier
    best = every.drop("n_validated").join(last.drop("n_validated"), ["bug_id", "tier"]).drop("tier")
    rows = repair.finished(engine, scores, sources, bugs, targets, best)
    return rows.join(last.drop("tier"), "bug_id", "left").withColumn("n_validated", F.coalesce("n_validated", F.lit(0)))


def _no_attempts(scores: DataFrame) -> DataFrame:
    texts = ("reached", "method", "patched_function", "patched_file", "mutation_strategy")
    lists = ("post_passed_tests", "post_failed_tests")
    fields = [F.lit(None).cast("string").alias(c) for c in texts] + [F.lit(None).cast("array<string>").alias(c) for c in lists]
    return scores.select("bug_id", *fields).where("false")


def by_replies_in_tiers(scores: DataFrame, sources: DataFrame, bugs: DataFrame, provider: repair.Provider, validator: repair.Validator, folder: str | None = None) -> DataFrame:
    """repaired_by_replies() in tiers: bugs solved by an earlier reply send no further prompt."""
    return repaired_in_tiers("llm", scores, sources, bugs, lambda targeted: repair.prompted(targeted, bugs, provider), validator, folder)


def by_mutants_in_tiers(scores: DataFrame, sources: DataFrame, bugs: DataFrame, validator: repair.Validator, most: int | None = None, folder: str | None = None) -> DataFrame:
    """repaired_by_mutants() in tiers; most caps a bug's candidates in each tier."""
    return repaired_in_tiers("mutation", scores, sources, bugs, lambda targeted: repair.mutated(targeted, most), validator, folder)
