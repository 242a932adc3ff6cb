"""From test outcomes and coverage to suspiciousness scores, worst-case ranks and their accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import FAILED, PASSED


#: Steps of score from 0 to 1 by which ranks are summed.
STEPS = 1024


def outcome_class(outcome: Column) -> Column:
    """True: failed, false: passed, in any case of letters; null: neither, and the test is left out."""
    upper = F.upper(F.coalesce(outcome, F.lit("")))
    return F.when(upper.isin(*FAILED), True).when(upper.isin(*PASSED), False)


def exploded(bugs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tests (bug_id, test, failed) and coverage (bug_id, method, failed; a bag) of bugs(bug_id, tests)."""
    tests = bugs.select("bug_id", F.posexplode("tests").alias("test", "t")).select(
        "bug_id", "test", outcome_class(F.col("t.outcome")).alias("failed"), F.col("t.covered_methods").alias("methods")
    )
    tests = tests.where("failed IS NOT NULL")
    return tests.select("bug_id", "test", "failed"), tests.select("bug_id", F.explode("methods").alias("method"), "failed")


def suspiciousness(tests: DataFrame, coverage: DataFrame) -> DataFrame:
    """Tarantula scores: bug_id, method, failed, passed, total_failed, total_passed, score.

    tests(bug_id, failed) has a row per test; coverage(bug_id, method, failed) a row per
    covered method and test, where repeats count. Both are pre-aggregated before they meet;
    totals are one row per bug.
    """
    totals = tests.groupBy("bug_id").agg(F.count_if("failed").alias("total_failed"), F.count_if(~F.col("failed")).alias("total_passed"))
    counts = coverage.groupBy("bug_id", "method").agg(F.count_if("failed").alias("failed"), F.count_if(~F.col("failed")).alias("passed"))
    fail_share, pass_share = F.try_divide("failed", "total_failed"), F.try_divide("passed", "total_passed")
    score = (
        F.when(F.col("total_failed") == 0, 0.0)
        .when(F.col("total_passed") == 0, F.when(F.col("failed") > 0, 1.0).otherwise(0.0))
        .otherwise(F.coalesce(F.try_divide(fail_share, fail_share + pass_share), F.lit(0.0)))
    )
    return counts.join(totals, "bug_id").withColumn("score", score)


def localize(bugs: DataFrame) -> DataFrame:
    """bug_id, scores (a map from method), ground_truth of every bug of bugs(bug_id, tests, ground_truth); no coverage: an empty map."""
    scored = suspiciousness(*exploded(bugs)).groupBy("bug_id").agg(F.map_from_entries(F.collect_list(F.struct("method", "score"))).alias("scores"))  # a bug's own methods
    none = F.create_map().cast("map<string,double>")
    return bugs.select("bug_id", "ground_truth").join(scored, "bug_id", "left").select("bug_id", F.coalesce("scores", none).alias("scores"), "ground_truth")


def worst_case_rank(scores: DataFrame) -> DataFrame:
    """scores with rank, the last position of each tie, and n_methods of the bug; null scores come last.

    Ranks are running sums over the counts of distinct scores, first by steps of score and then within a step, so the methods of one bug
    are never in one window: a step's distinct scores are, and a bug's steps.
    """
    step = F.floor(F.least(F.greatest(F.col("score"), F.lit(-1e6)), F.lit(1e6)) * STEPS)
    counts = scores.groupBy("bug_id", "score").agg(F.count("*").alias("_n")).withColumn("_step", step)
    before = W.partitionBy("bug_id").orderBy(F.desc("_step")).rowsBetween(W.unboundedPreceding, -1)
    steps = counts.groupBy("bug_id", "_step").agg(F.sum("_n").alias("_m"))
    steps = steps.select("bug_id", "_step", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_ahead"), F.sum("_m").over(W.partitionBy("bug_id")).alias("n_methods"))
    within = counts.withColumn("_place", F.sum("_n").over(W.partitionBy("bug_id", "_step").orderBy(F.desc("score"))))
    ranks = _joined(within, steps, "bug_id", "_step").select("bug_id", "score", (F.col("_ahead") + F.col("_place")).alias("rank"), "n_methods")
    return _joined(scores, ranks, "bug_id", "score")


def _joined(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """An inner join in which nulls are equal; the keys are left's."""
    right = right.select(*(F.col(k).alias(f"_right_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(right, same).drop(*(f"_right_{k}" for k in keys))


def by_bug(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """bug_id, first_rank, avg_rank, exam: truth(bug_id, method) against ranks; a method without a score ranks behind all."""
    sizes = ranked.groupBy("bug_id").agg(F.first("n_methods").alias("n_methods"))
    placed = truth.join(sizes, "bug_id").join(ranked.select("bug_id", "method", "rank"), ["bug_id", "method"], "left")
    rank = F.coalesce("rank", F.col("n_methods") + 1)
    out = placed.groupBy("bug_id").agg(F.min(rank).alias("first_rank"), F.avg(rank).alias("avg_rank"), F.first("n_methods").alias("n_methods"))
    return out.withColumn("exam", F.col("first_rank") / F.col("n_methods"))


def accuracy(bugs: DataFrame) -> DataFrame:
    """One row: evaluated, top1, top3, top5 (counts), their percentages, mfr, mar, exam."""
    n = F.count("*")
    tops = {f"top{k}": F.count_if(F.col("first_rank") <= k) for k in (1, 3, 5)}
    return bugs.agg(
        n.alias("evaluated"),
        *(c.alias(name) for name, c in tops.items()),
        *(F.try_divide(100 * c, n).alias(f"{name}_percent") for name, c in tops.items()),
        F.avg("first_rank").alias("mfr"), F.avg("avg_rank").alias("mar"), F.avg("exam").alias("exam"),
    )


def evaluability(results: DataFrame) -> DataFrame:
    """results(bug_id, scores map, ground_truth array) with bucket: evaluated, skipped_no_scores or skipped_no_gt."""
    no_truth = F.coalesce(F.size("ground_truth"), F.lit(0)) <= 0
    bucket = F.when(F.col("scores").isNull(), "skipped_no_scores").when(no_truth, "skipped_no_gt").when(F.size("scores") <= 0, "skipped_no_scores").otherwise("evaluated")
    return results.withColumn("bucket", bucket)


def evaluation(results: DataFrame) -> DataFrame:
    """accuracy() over results(bug_id, scores map, ground_truth array) that can be evaluated, with total and the counts of those that cannot, by reason."""
    sorted_out = evaluability(results)
    counts = sorted_out.agg(
        F.count("*").alias("total"), *(F.count_if(F.col("bucket") == b).alias(b) for b in ("skipped_no_gt", "skipped_no_scores"))
    )
    usable = sorted_out.where("bucket = 'evaluated'")
    ranked = worst_case_rank(usable.select("bug_id", F.explode("scores").alias("method", "score")))
    return accuracy(by_bug(ranked, usable.select("bug_id", F.explode("ground_truth").alias("method")))).crossJoin(F.broadcast(counts))  # one row each
