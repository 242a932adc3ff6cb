"""Exact results by cheaper ways: distances within bounds, medians from histograms, ranks from counts of scores."""

import random
import time

from pyspark.sql import functions as F

from tracewright.functions import codetext, distance
from tracewright.operators import results, spectrum

rng = random.Random(6)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(3)] = rng.choice(["", "x", "é", "ab", "日"])
    return "".join(out)


def test_distances_equal_the_plain_ones(spark):
    pairs = [("", ""), ("", "abc"), ("a" * 200, "a" * 199), ("ab" * 100, "ba" * 100), (None, "a"), ("a", None), ("😀" * 70, "😀" * 69 + "é")]
    for _ in range(150):
        a = "".join(rng.choice("abé日 ") for _ in range(rng.randrange(160)))
        pairs.append((a, edited(a, rng.randrange(60)) if rng.random() < 0.8 else "".join(rng.choice("abé日 ") for _ in range(rng.randrange(160)))))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", codetext.text_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r["d"] for r in got] == [None if r["a"] is None or r["b"] is None else plain_distance(r["a"], r["b"]) for r in got]


def test_near_files_take_little_time(spark):
    text = "".join(rng.choice("abcdefgh(){};") for _ in range(20_000))
    near = text[:9_000] + "x" + text[9_002:9_400] + "yy" + text[9_400:]
    df = spark.createDataFrame([(text, near)] * 3, "a string, b string").repartition(1).cache()
    df.count()

    def timed(column):
        began = time.time()
        found = {r["d"] for r in df.select(column.alias("d")).collect()}
        return found, time.time() - began

    timed(codetext.text_distance(F.col("a"), F.col("b")))
    got, took = timed(codetext.text_distance(F.col("a"), F.col("b")))
    want, whole = timed(F.levenshtein("a", "b"))
    assert got == want == {4} and took < whole / 5, (took, whole)


def test_each_way_to_a_distance_is_exact():
    for turn in range(300):
        letters = "ab" if turn % 2 else "abé日😀"
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 50)))
        b = edited(a, rng.randrange(30)) if turn % 3 else "".join(c for c in a if rng.random() < 0.8)
        want = plain_distance(a, b)
        assert distance.distance(a, b) == distance.distance(b, a) == want
        if a and b and a != b:
            x, y = (distance._codes(t) for t in (a, b))
            assert distance.by_bits(x, y) == distance.by_diagonals(x, y, want) == want and (want == 1 or distance.by_diagonals(x, y, want - 1) is None)


def test_edits_spread_over_whole_texts_take_little_time(spark):
    text = "".join(rng.choice("abcdefgh(){};") for _ in range(10_000))
    pairs = [(text, text.replace("a", "")), (text, text.replace("b", "\u0001")), (text, "".join(rng.choice("xyz") if rng.random() < 0.02 else c for c in text))]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(1).cache()
    df.count()

    def timed(column):
        began = time.time()
        found = sorted({r["d"] for r in df.select(column.alias("d")).collect()})
        return found, time.time() - began

    timed(codetext.text_distance(F.col("a"), F.col("b")))
    got, took = timed(codetext.text_distance(F.col("a"), F.col("b")))
    want, whole = timed(F.levenshtein("a", "b"))
    assert got == want and took < whole / 5, (took, whole)


def test_medians_equal_sorted_lists(spark):
    groups = {f"g{k}": [rng.randrange(1 << rng.choice([3, 15, 20, 30])) for _ in range(rng.randrange(1, 60))] for k in range(40)}
    groups |= {None: [7, 1, 5], "low": [-5, -70_000, 3], "one": [65_536], "ties": [4] * 9 + [65_540] * 9}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("g1", None), ("only null", None)]
    df = spark.createDataFrame(rows, "engine string, distance int").repartition(3)
    got = {r["engine"]: r["median"] for r in results.upper_medians(df, ["engine"], "distance").collect()}
    assert got == {g: sorted(values)[len(values) // 2] for g, values in groups.items()}
    stats = {r["engine"]: r for r in results.distance_stats(df, ["engine"]).collect()}
    assert stats["low"]["median"] == 3 and (stats[None]["n"], stats[None]["median"], stats[None]["least"]) == (3, 5, 1)
    by_two = results.upper_medians(df.withColumn("x", F.lit(None).cast("int")), ["engine", "x"], "distance")
    assert {r["engine"]: r["median"] for r in by_two.collect()} == got


def test_ranks_equal_sorting(spark):
    values = [0.0, -0.0, 1.0, 0.5, 0.25, 1 / 3, 1 / 3 + 1e-12, 1e9, -1e9, 2e9, float("inf"), None]
    rows = [(b, f"m{k}", rng.choice(values) if rng.random() < 0.5 else rng.random()) for b in ("x", "y", "z", None) for k in range(60)]
    got = spectrum.worst_case_rank(spark.createDataFrame(rows, "bug_id string, method string, score double").repartition(3)).collect()
    lower = lambda s: float("-inf") if s is None else s
    assert len(got) == len(rows)
    for r in got:
        own = [s for b, _, s in rows if b == r["bug_id"]]
        ahead = [s for s in own if r["score"] is None or s is not None and lower(s) >= lower(r["score"])]
        assert (r["rank"], r["n_methods"]) == (len(ahead), 60)


def test_no_window_holds_the_methods_of_a_bug(spark):
    scores = spark.range(50_000).select(F.lit("x").alias("bug_id"), F.col("id").cast("string").alias("method"), ((F.col("id") % 10) / 10).alias("score"))
    ranked = spectrum.worst_case_rank(scores)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString().split("\n")
    for k, line in enumerate(plan):  # below each window the rows are counts
        if "Window [" in line:
            assert any("Aggregate" in x for x in plan[k + 1 : k + 6])
    assert ranked.groupBy("rank").count().count() == 10 and ranked.agg(F.max("rank")).first()[0] == 50_000
