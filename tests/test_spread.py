"""Work that takes far longer than moving its rows is dealt over the cores, and done once a row."""

import pytest
from pyspark.sql import functions as F
from test_exact import rng

from tracewright.functions import codetext
from tracewright.operators import mutants, repair
from tracewright.plans import tables

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["mutants", "extracted_functions", "changed_functions", "normalised_code", "code_mutants", "normalised_pages"])
def test_one_small_file_goes_to_all_cores(spark, query):
    spread = tables.code_text(spark, SMALL) if "pages" not in query and query != "code_mutants" else tables.QUERIES["normalised_pages"](spark, SMALL)
    assert spread.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "RoundRobinPartitioning" in tables.QUERIES[query](spark, SMALL)._jdf.queryExecution().toString()


def test_places_are_those_of_the_plain_pattern(spark):
    texts = ["".join(rng.choice(["<", ">", "=", "!", "+", "-", "1", "a", "é", " ", "\u3000", "\n", "(", "_"]) for _ in range(rng.randrange(60))) for _ in range(200)] + ["", "a<b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for sign, (pattern, puts) in zip(mutants.SIGNS, mutants.RULES):
        plain = pattern
        for short, full in mutants.CLASSES.items():
            plain = plain.replace(short, full)
        rows = df.select("t", mutants._changes(F.col("t"), sign, pattern, puts).alias("x"), F.split("t", plain, -1).alias("between"), F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("hits")).collect()
        for r in rows:
            want, at = [], 0
            for gap, hit in zip(r["between"] or [], r["hits"] or []):
                want += [(at + len(gap), len(hit), hit, put) for put in puts]
                at += len(gap) + len(hit)
            assert [tuple(x) for x in r["x"]] == want


def test_a_span_is_told_from_one_look_at_the_source(spark):
    span = codetext.function_span(F.col("t"), F.lit("f"))
    plan = spark.createDataFrame([("int f() { }",)], "t string").select(span.alias("s")).select("s.start", "s.end", "s.code")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_instr") == 1


def test_targets_are_found_once_on_all_cores(spark):
    scores = spark.createDataFrame([("1", "x.c::f", 0.5), ("1", "x.c::g", 0.4), ("1", "x.c::h", 0.0)], "bug_id string, method string, score double")
    sources = spark.createDataFrame([("1", "int f() { return 1; }")], "bug_id string, text string")
    out = repair.targets(scores, sources)
    assert [(r["method"], r["method_order"], r["span"]["code"]) for r in out.collect()] == [("x.c::f", 1, "int f() { return 1; }")]
    plan = out._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("regexp_instr") == 1 and "RoundRobinPartitioning" in plan.toString()
