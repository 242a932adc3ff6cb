"""Repair results: resuming, upserting, uniting engines, choosing candidates, classifying and summing up fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LABELS = ("CleanFix", "NoiseFix", "NoneFix", "NegFix")
NOT_ATTEMPTED = ("skipped", "llm_failed")


def pending(scores: DataFrame, prior: DataFrame, redo: tuple[str, ...] = ("skipped",)) -> DataFrame:
    """scores of bugs that prior results have not settled; a missing status counts as settled."""
    return scores.join(prior.where(~F.coalesce("status", F.lit("")).isin(*redo)), "bug_id", "left_anti")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new, and those of old that new has no row for, by bug_id."""
    return old.join(new, "bug_id", "left_anti").unionByName(new, allowMissingColumns=True)


def united(engines: dict[str, DataFrame]) -> DataFrame:
    parts = [df.withColumn("engine", F.lit(name)) for name, df in engines.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def attempted(status: Column) -> Column:
    return ~F.coalesce(status, F.lit("skipped")).isin(*NOT_ATTEMPTED)


def fix_class(before: Column, after: Column) -> Column:
    """Label by the tests that failed before and those that fail after."""
    fixed, broken = F.size(F.array_except(before, after)) > 0, F.size(F.array_except(after, before)) > 0
    return F.when(fixed & ~broken, "CleanFix").when(fixed, "NoiseFix").when(broken, "NegFix").otherwise("NoneFix")


def plausible(before: Column, after: Column) -> Column:
    """Some test failed before, all those pass, none else fails; a null id is an id like any other."""
    return (F.size(before) > 0) & (F.size(F.array_intersect(before, after)) == 0) & (F.size(F.array_except(after, before)) == 0)


def tallies(status: Column, init_passed: Column, init_failed: Column, post_passed: Column, post_failed: Column) -> Column:
    """struct(passed, failed, observed) after repair; a success that lists no tests passes all of them."""
    silent = (status == "success") & (F.size(post_passed) == 0)
    return F.struct(
        F.when(silent, F.size(init_passed) + F.size(init_failed)).otherwise(F.size(post_passed)).alias("passed"),
        F.when(silent, 0).otherwise(F.size(post_failed)).alias("failed"),
        (F.size(post_passed) + F.size(post_failed) > 0).alias("observed"),
    )


def fix_summary(classified: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each label, zero-filled, with rates over attempted rows; classified(by..., label, is_plausible)."""
    n = F.count("*")
    counts = {label: F.count_if(F.col("label") == label) for label in LABELS}
    rate = lambda c: F.try_divide(100.0 * c, n)
    return classified.groupBy(*by).agg(
        n.alias("attempted"),
        *(c.alias(label) for label, c in counts.items()),
        F.count_if("is_plausible").alias("plausible"),
        rate(counts["CleanFix"] + counts["NoiseFix"]).alias("any_fix_percent"),
        rate(counts["NoiseFix"] + counts["NegFix"]).alias("regression_percent"),
    )


def status_counts(results: DataFrame, by: list[str], groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows by status group (one column each), their total, and the share of the first group."""
    n = F.count("*")
    counts = {name: F.count_if(F.col("status").isin(*statuses)) for name, statuses in groups.items()}
    first = next(iter(counts.values()))
    return results.groupBy(*by).agg(n.alias("total"), *(c.alias(name) for name, c in counts.items()), F.try_divide(100.0 * first, n).alias("fix_percent"))


def upper_medians(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """by and median: the value at place n // 2 (from 0) of each group's n whole numbers in order; nulls are left out.

    Two passes over counts: by the numbers' upper bits, then by the lower 16 bits of those that share the median's upper ones. Of a
    group at most 65,536 counts meet in one task, however many rows or distinct numbers it has.
    """
    value = F.col(column).cast("long")
    parts = rows.where(value.isNotNull()).select(*by, F.shiftright(value, 16).alias("_high"), value.bitwiseAND(F.lit(65535)).alias("_low"))
    order = lambda c: W.partitionBy(*by).orderBy(c)
    highs = parts.groupBy(*by, "_high").agg(F.count("*").alias("_n"))
    highs = highs.withColumns({"_upto": F.sum("_n").over(order("_high")), "_all": F.sum("_n").over(W.partitionBy(*by))})
    place = F.floor(F.col("_all") / 2)
    found = highs.where((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place)).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_high").alias("_median_high"), (place - F.col("_upto") + F.col("_n")).alias("_rest"))
    same = F.col("_high") == F.col("_median_high")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    lows = parts.join(found, same).groupBy(*by, "_high", "_low", "_rest").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(order("_low")))
    lows = lows.where((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_n") <= F.col("_rest")))
    return lows.select(*by, (F.col("_high") * 65536 + F.col("_low")).alias("median"))


def distance_stats(distances: DataFrame, by: list[str], column: str = "distance") -> DataFrame:
    """n, mean, upper median, min and max of distances of 0 or more."""
    kept = distances.where(F.col(column) >= 0)
    medians = upper_medians(kept, by, column).select(*(F.col(c).alias(f"_{c}") for c in by), "median")
    rest = kept.groupBy(*by).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.min(column).alias("least"), F.max(column).alias("most"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rest.join(medians, same).select(*by, "n", "mean", "median", "least", "most")


def validated(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """candidates (candidate_id, compiled, ...) with passed and failed test counts and valid: at least one passed, none failed."""
    counts = runs.groupBy("candidate_id").agg(F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"))
    out = candidates.join(counts, "candidate_id", "left").withColumns({c: F.when(F.col("compiled"), F.coalesce(c, F.lit(0))).otherwise(0) for c in ("n_passed", "n_failed")})
    return out.withColumn("valid", (F.col("n_passed") > 0) & (F.col("n_failed") == 0))


def chosen(candidates: DataFrame) -> DataFrame:
    """bug_id, status, candidate_id: the first valid candidate in order; else the best effort of the last function tried.

    candidates(bug_id, method_order, ord, candidate_id, n_passed, valid). Best effort is the
    earliest maximum of passed tests; both are max aggregates, so they combine on the map side.
    """
    order = F.struct(-F.col("method_order"), -F.col("ord"))
    first = F.max_by("candidate_id", F.when(F.col("valid"), order))
    effort = F.max_by("candidate_id", F.struct("method_order", "n_passed", (-F.col("ord")).alias("o")))
    fixed = F.max("valid")
    return candidates.groupBy("bug_id").agg(F.when(fixed, "success").otherwise("failed").alias("status"), F.when(fixed, first).otherwise(effort).alias("candidate_id"))
