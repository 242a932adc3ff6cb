"""The domain's relations read off the test tables, and the registered queries with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codetext, logs, names
from ..operators import mutants as m
from ..operators import providers, repair, results, spectrum, tiers
from ..sources import buckets, keyed
from ..sources.stages import Stages


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """rows over some tasks for each core, for work that takes far longer than moving a row: small files of many rows are one task each."""
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(tasks, rows.rdd.getNumPartitions()))


def spectra(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """tests and coverage: segments are bugs, orders tests, brands of their lines methods."""
    customer = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("bug_id"))
    outcome = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", "PASS").otherwise("SKIP")
    tests = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", spectrum.outcome_class(outcome).alias("failed")).where("failed IS NOT NULL")
    tests = tests.join(customer, "o_custkey").select("bug_id", "o_orderkey", "failed")
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    part = load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("method"))
    return tests, lines.join(part, "p_partkey").join(tests, "o_orderkey").select("bug_id", "method", "failed")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.worst_case_rank(spectrum.suspiciousness(*spectra(spark, sf_dir)))


def suspiciousness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(spark, sf_dir)
    return out.select("bug_id", "method", "failed", "passed", "total_failed", "total_passed", F.round("score", 9).alias("score"), "rank")


SPECTRA_SQL = """
tests AS (SELECT c_mktsegment AS bug_id, o_orderkey, o_orderstatus = 'F' AS failed
          FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O')),
totals AS (SELECT bug_id, count(*) FILTER (failed) AS total_failed, count(*) FILTER (NOT failed) AS total_passed FROM tests GROUP BY bug_id),
counts AS (SELECT t.bug_id, p_brand AS method, count(*) FILTER (failed) AS failed, count(*) FILTER (NOT failed) AS passed
           FROM lineitem JOIN part ON l_partkey = p_partkey JOIN tests t ON l_orderkey = o_orderkey GROUP BY 1, 2),
shares AS (SELECT *, failed::DOUBLE / nullif(total_failed, 0) AS f, passed::DOUBLE / nullif(total_passed, 0) AS p FROM counts JOIN totals USING (bug_id)),
scored AS (SELECT *, CASE WHEN total_failed = 0 THEN 0.0 WHEN total_passed = 0 THEN CASE WHEN failed > 0 THEN 1.0 ELSE 0.0 END
                     WHEN f + p = 0 THEN 0.0 ELSE f / (f + p) END AS score FROM shares),
ranked AS (SELECT *, count(*) OVER (PARTITION BY bug_id ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank,
                  count(*) OVER (PARTITION BY bug_id) AS n_methods FROM scored)"""
SUSPICIOUSNESS_SQL = f"WITH {SPECTRA_SQL} SELECT bug_id, method, failed, passed, total_failed, total_passed, round(score, 9) AS score, rank FROM ranked"


def truth(ranked: DataFrame) -> DataFrame:
    """Ground truth of each bug: the method on most failing lines (ties: the first by name), and one that has no score."""
    best = ranked.groupBy("bug_id").agg(F.min_by("method", F.struct(-F.col("failed"), "method")).alias("method"))
    return best.select("bug_id", "method").union(best.select("bug_id", F.lit("Brand#0")))


TRUTH_SQL = """
best AS (SELECT bug_id, min(method) AS method FROM counts c WHERE failed = (SELECT max(failed) FROM counts d WHERE d.bug_id = c.bug_id) GROUP BY bug_id),
truth AS (SELECT bug_id, method FROM best UNION ALL SELECT bug_id, 'Brand#0' FROM best),
placed AS (SELECT t.bug_id, s.n_methods, coalesce(r.rank, s.n_methods + 1) AS rank FROM truth t
           JOIN (SELECT DISTINCT bug_id, n_methods FROM ranked) s USING (bug_id) LEFT JOIN ranked r ON r.bug_id = t.bug_id AND r.method = t.method),
bugs AS (SELECT bug_id, min(rank) AS first_rank, avg(rank) AS avg_rank, any_value(n_methods) AS n_methods, min(rank) / any_value(n_methods)::DOUBLE AS exam FROM placed GROUP BY bug_id)"""


def localized(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = scores(spark, sf_dir).cache()  # a row for each bug and method, read several times, made from all lines once
    return spectrum.by_bug(ranked, truth(ranked))


def localization_by_bug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return localized(spark, sf_dir).select("bug_id", "first_rank", F.round("avg_rank", 6).alias("avg_rank"), "n_methods", F.round("exam", 6).alias("exam"))


def localization_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectrum.accuracy(localized(spark, sf_dir))
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes))


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part the returned line numbers before (F) and after (O) as failing tests."""
    lines = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    side = lambda s: F.coalesce(F.array_sort(F.collect_set(F.when(F.col("l_linestatus") == s, F.col("l_linenumber")))), F.array())
    rows = lines.groupBy("l_partkey").agg(side("F").alias("before"), side("O").alias("after"))
    return rows.select(
        "l_partkey", F.size("before").alias("n_before"), F.size("after").alias("n_after"),
        results.fix_class(F.col("before"), F.col("after")).alias("label"), results.plausible(F.col("before"), F.col("after")).alias("is_plausible"),
    )


FIXES_SQL = """
sets AS (SELECT l_partkey, coalesce(list(DISTINCT l_linenumber) FILTER (l_linestatus = 'F'), []) AS b,
                coalesce(list(DISTINCT l_linenumber) FILTER (l_linestatus = 'O'), []) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey),
flags AS (SELECT *, len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0 AS fixed, len(list_filter(a, lambda x: NOT list_contains(b, x))) > 0 AS broken FROM sets),
fixes AS (SELECT l_partkey, len(b)::INTEGER AS n_before, len(a)::INTEGER AS n_after,
                 CASE WHEN fixed AND NOT broken THEN 'CleanFix' WHEN fixed THEN 'NoiseFix' WHEN broken THEN 'NegFix' ELSE 'NoneFix' END AS label,
                 len(b) > 0 AND NOT broken AND NOT list_has_any(a, b) AS is_plausible FROM flags)"""


def fix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("engine"))
    out = results.fix_summary(fixes(spark, sf_dir).join(part, "l_partkey"), ["engine"])
    return out.withColumns({c: F.round(c, 6) for c in ("any_fix_percent", "regression_percent")})


def status() -> Column:
    return F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "click", "timeout_repaired").when(F.col("event_type") == "view", "no_repair").otherwise("skipped")


STATUS_SQL = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'click' THEN 'timeout_repaired' WHEN 'view' THEN 'no_repair' ELSE 'skipped' END"


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("engine"), status().alias("status"))
    groups = {"repaired": ("success", "timeout_repaired"), "unrepaired": ("no_repair", "timeout"), "set_aside": ("error", "build_failed", "skipped")}
    return results.status_counts(rows, ["engine"], groups).withColumn("fix_percent", F.round("fix_percent", 6))


def latest_results(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    """Results of users as bugs from events whose id has a parity: the status of the last event."""
    rows = load(spark, sf_dir, "events").where(F.col("event_id") % 2 == odd)
    return rows.groupBy(F.col("user_id").alias("bug_id")).agg(F.max_by(status(), "event_id").alias("status"), F.max("event_id").alias("event_id"))


LATEST_SQL = f"SELECT user_id AS bug_id, arg_max({STATUS_SQL}, event_id) AS status, max(event_id) AS event_id FROM events WHERE event_id %% 2 = %d GROUP BY user_id"


def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.pending(latest_results(spark, sf_dir, 1), latest_results(spark, sf_dir, 0))


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.upserted(latest_results(spark, sf_dir, 0), latest_results(spark, sf_dir, 1))


def bucketed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """upsert through a stored table: two writes, of which the second replaces rows only in the buckets it falls into."""
    table = Stages(spark).path("results")
    for odd in (0, 1):
        buckets.upsert(latest_results(spark, sf_dir, odd), table)
    return buckets.stored(spark, table)


def engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = results.united({"even": latest_results(spark, sf_dir, 0), "odd": latest_results(spark, sf_dir, 1)})
    return both.groupBy("engine").agg(F.count("*").alias("n"), F.count_if(results.attempted(F.col("status"))).alias("n_attempted"))


def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = names.qualify(F.concat(F.lit("/src/"), F.col("p_type")), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("ns::"), F.col("p_name"))).otherwise(F.col("p_name")))
    rows = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(q).alias("q"))
    return rows.select("p_partkey", names.source_of(F.col("q")).alias("source_file"), names.bare_name(F.col("q")).alias("func_name"))


def version_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    bug = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("bug"), F.col("o_orderkey"))).otherwise(F.concat_ws("-", F.lit("9"), F.col("o_orderstatus"), F.lit("bug"), F.col("o_orderkey"), F.col("o_custkey")))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", bug.alias("b"))
    return rows.select("o_orderkey", names.buggy_file(F.col("b")).alias("buggy_file"), names.accepted_file(F.col("b")).alias("accepted_file"), names.source_path(F.lit("/data"), F.col("b")).alias("source_path"))


def test_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer, tests by outcome in order of their keys, and the first failing one's context length."""
    outcome = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", "PASS").otherwise("pass")
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", outcome.alias("outcome"))
    of = lambda outcomes, value: F.when(F.col("outcome").isin(*outcomes), value)
    key = F.struct("o_orderkey", "o_orderpriority")
    rows = rows.groupBy("o_custkey").agg(  # keys alone are gathered: outputs are long
        F.array_sort(F.collect_list(of(names.PASSED, F.col("o_orderkey")))).alias("passed"),
        F.array_sort(F.collect_list(of(names.FAILED, F.col("o_orderkey")))).alias("failed"),
        F.min(of(names.FAILED, key)).alias("first"),
    )
    test = F.struct(
        F.col("first.o_orderkey").cast("string").alias("test_id"), F.when(F.col("first").isNotNull(), "FAIL").alias("outcome"),
        F.col("first.o_orderpriority").alias("expected_output"), F.repeat("first.o_orderpriority", F.lit(60)).alias("actual_output"), F.lit(None).cast("string").alias("fail_reason"),
    )
    return rows.select(
        "o_custkey",
        F.array_join(F.col("passed").cast("array<string>"), ",").alias("init_passed"),
        F.array_join(F.col("failed").cast("array<string>"), ",").alias("init_failed"),
        F.contains(names.failed_context(F.array(test)), F.lit("...[truncated]")).alias("truncated"),
    )


def code_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-like source of each part, with comments and literals that hold braces."""
    return dealt(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")).select(
        "p_partkey", "p_size", F.col("p_name").alias("name"),
        F.format_string(
            '/* %s } */\nint helper(int a) { return a + 1; }\nint solve(int n) {\n  char *s = "{ %s \\" }";\n  if (n < %d) { return n - 1; } // }\n  return n * 2;\n}\n',
            F.col("p_name"), F.col("p_type"), F.col("p_size"),
        ).alias("code"),
    )


CODE_SQL = """code AS (SELECT p_partkey, p_name, '/* ' || p_name || ' } */' || chr(10) || 'int helper(int a) { return a + 1; }' || chr(10) || 'int solve(int n) {' || chr(10)
  || '  char *s = "{ ' || p_type || ' \\" }";' || chr(10) || '  if (n < ' || p_size || ') { return n - 1; } // }' || chr(10) || '  return n * 2;' || chr(10) || '}' || chr(10) AS code FROM part)"""
NORM_SQL = """regexp_replace(code, '("(?:[^"\\\\]|\\\\[\\s\\S])*"|''(?:[^''\\\\]|\\\\[\\s\\S])*'')|//[^\\n]*|/\\*[\\s\\S]*?\\*/|\\s+', '\\1', 'g')"""


PAGES_SQL = r"""regexp_replace(coalesce(html, ''), '("(?:[^"\\]|\\[\s\S])*(?:"|\\?\z)|''(?:[^''\\]|\\[\s\S])*(?:''|\\?\z))|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '\1', 'g')"""


def normalised_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_text(spark, sf_dir).select("p_partkey", codetext.normalised(F.col("code")).alias("code"))


def normalised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages as code text: digests and lengths of what is left without comments and white space."""
    code = codetext.normalised(F.coalesce("html", F.lit("")))
    return dealt(load(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.sha2(code, 256).alias("code_sha256"), F.length(code).alias("n_chars"))


def code_mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages as code text: each one's mutants, by what they change."""
    made = m.mutants(dealt(load(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("code"))), "page_id")
    return made.groupBy("page_id", "description").agg(F.count("*").alias("n"), F.min("mutant_ordinal").alias("first_ordinal"))


def extracted_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = codetext.function_span(F.col("code"), F.lit("solve"))
    return code_text(spark, sf_dir).select("p_partkey", span.alias("s")).select("p_partkey", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), F.col("s.code").alias("code"))


def page_mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.mutants(code_text(spark, sf_dir).select("p_partkey", "code"), "p_partkey").select("p_partkey", "mutant_ordinal", F.sha2("code", 256).alias("code_sha256"), "description")


def distance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    pairs = part.join(after, "p_partkey").select("p_brand", codetext.edit_distance(F.col("p_name"), F.col("other")).alias("distance"))
    return results.distance_stats(pairs, ["p_brand"]).withColumns({"mean": F.round("mean", 6), "median": F.col("median").cast("int")})


def keyed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents written as one JSON object keyed by id, cut over files, and read back by byte ranges."""
    folder = Stages(spark).path("documents")
    keyed.write_object(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("bug_id"), "text", "lang"), folder)
    back = keyed.entries(spark, folder, "struct<text:string,lang:string>", together=True)
    return back.select(F.col("bug_id").cast("long").alias("doc_id"), F.sha2("value.text", 256).alias("text_sha256"), F.col("value.lang").alias("lang"))


def text_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents against themselves without a letter, and with that letter replaced by a sign that no text has: each edit counts once."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return dealt(rows).select(
        "doc_id",
        codetext.text_distance(F.col("t"), F.replace("t", F.lit("z"), F.lit(""))).alias("dropped"),
        codetext.text_distance(F.col("t"), F.replace("t", F.lit("q"), F.lit("\u0001"))).alias("replaced"),
    )


def comparable_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    loose = F.concat(F.replace("t", F.lit("\n"), F.lit(" \t\n")), F.lit("  \n\n"))
    return rows.select("conv_id", "turn", codetext.same_output(loose, F.col("t")).alias("same"), codetext.same_output(F.concat(F.lit(" "), F.col("t")), F.col("t")).alias("same_indented"))


def candidate_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as bugs, orders as candidates, their lines as test runs."""
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("bug_id"), (F.col("o_orderkey") % 3).alias("method_order"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("candidate_id"), (F.col("o_orderstatus") != "P").alias("compiled")
    )
    runs = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), (F.col("l_returnflag") != "R").alias("passed"))
    return repair.repaired(orders, runs)


CHOICE_SQL = """
WITH r AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS p, count(*) FILTER (l_returnflag = 'R') AS f FROM lineitem GROUP BY 1),
c AS (SELECT o_custkey AS bug_id, o_orderkey % 3 AS mo, o_orderkey AS k, CASE WHEN o_orderstatus <> 'P' THEN coalesce(p, 0) ELSE 0 END AS p,
             CASE WHEN o_orderstatus <> 'P' THEN coalesce(f, 0) ELSE 0 END AS f FROM orders LEFT JOIN r ON l_orderkey = o_orderkey),
v AS (SELECT *, p > 0 AND f = 0 AS ok FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY bug_id ORDER BY ok DESC, CASE WHEN ok THEN mo ELSE -mo END, CASE WHEN ok THEN 0 ELSE -p END, k) AS n FROM v)
SELECT bug_id, CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, k AS candidate_id FROM o WHERE n = 1"""


def repair_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """scores, sources, bugs, replies and facts: customers as bugs in one source each, replies for some of its two functions, orders as tests before and as runs of the patches.

    Functions without a reply have a null or an empty one.
    """
    customer = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bug_id"), F.col("c_nationkey").alias("n"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bug_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("test_id"), F.col("o_orderstatus").alias("s"))
    text = F.format_string("int helper(int a) { return a + %d; }\nint solve(int n) { return n * 2; }\n", F.col("n"))
    sources = customer.select("bug_id", text.alias("text"))
    weight = F.when(F.col("bug_id") % 7 == 0, 0.0)
    methods = F.array(F.struct(F.lit("x.c::helper").alias("method"), F.lit(0.9).alias("score")), F.struct(F.lit("x.c::solve").alias("method"), F.lit(0.5).alias("score")))
    scores = customer.select("bug_id", F.explode(methods).alias("m")).select("bug_id", "m.method", F.coalesce(weight, "m.score").alias("score"))
    outcome = F.when(F.col("s") == "F", "FAIL").when(F.col("s") == "O", "PASS").otherwise("SKIP")
    tests = F.array_sort(F.collect_list(F.struct("test_id", outcome.alias("outcome"), *(F.lit("").alias(c) for c in ("expected_output", "actual_output", "fail_reason")))))
    bugs = orders.groupBy("bug_id").agg(tests.alias("tests"))
    reply = F.when((F.col("method") == "x.c::helper") & (F.col("bug_id") % 2 == 0), F.format_string("```c\nint helper(int a) { return %d; }\n```", F.col("bug_id")))
    reply = F.coalesce(reply, F.when((F.col("method") == "x.c::solve") & (F.col("bug_id") % 3 == 0), F.lit("int solve(int n) { return 0; }")))
    replies = scores.select("bug_id", "method", F.coalesce(reply, F.when(F.col("bug_id") % 5 < 2, "")).alias("reply"))
    passed = F.when(F.col("method") == "x.c::helper", F.col("s") == "O").otherwise(F.col("s") != "F")
    facts = orders.crossJoin(F.broadcast(spark.createDataFrame([("x.c::helper",), ("x.c::solve",)], "method string")))  # two rows
    facts = facts.select("bug_id", "method", F.lit(1).alias("ord"), "test_id", passed.alias("passed"))
    return scores, sources, bugs, replies, facts


def repair_columns() -> list[str | Column]:
    lists = (F.concat_ws(",", c).alias(c) for c in repair.RESULT[-4:])
    return ["bug_id", "status", "selected_function", "patched_function", F.sha2("patched_file", 256).alias("file_sha256"), "patch_file", *lists]


def repair_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, sources, bugs, replies, facts = repair_inputs(spark, sf_dir)
    return repair.repaired_by_replies(scores, sources, bugs, repair.replay(replies), repair.recorded(facts)).select(*repair_columns())


def answer(prompt: str) -> str | None:
    """What the replies of repair_inputs() say, as a service would: from the prompt alone, with nothing or a failure where there is no reply."""
    function, bug = re.match(r"Repair the C function (\w+) of (\d+)\.", prompt).groups()
    bug = int(bug)
    if function == "helper" and bug % 2 == 0:
        return f"```c\nint helper(int a) {{ return {bug}; }}\n```"
    if function == "solve" and bug % 3 == 0:
        return "int solve(int n) { return 0; }"
    if bug % 4 == 1:
        raise TimeoutError
    return "" if bug % 4 == 3 else None


def tiered_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repair_results function by function: a service answers, and solved bugs send and validate nothing more."""
    scores, sources, bugs, _, facts = repair_inputs(spark, sf_dir)
    stages = Stages(spark)
    provider = providers.asking(answer, stages.path("replies"), wait=0.0)
    out = tiers.by_replies_in_tiers(scores, sources, bugs, provider, repair.recorded(facts), stages.path("tiers"))
    return out.select(*repair_columns(), "n_validated")


REPAIRS_SQL = """
WITH o AS (SELECT o_custkey AS b, lpad(o_orderkey::VARCHAR, 12, '0') AS t, o_orderstatus AS s FROM orders),
l AS (SELECT b, list(t ORDER BY t) FILTER (s = 'O') AS o, list(t ORDER BY t) FILTER (s = 'F') AS f, list(t ORDER BY t) FILTER (s <> 'O') AS no, list(t ORDER BY t) FILTER (s <> 'F') AS nf FROM o GROUP BY b),
c AS (SELECT c_custkey AS b, c_nationkey AS n, c_custkey % 7 = 0 AS none, c_custkey % 2 = 0 AS h, c_custkey % 3 = 0 AS v,
             len(o) > 0 AND no IS NULL AS h_ok, len(nf) > 0 AND f IS NULL AS v_ok, o, f, no, nf FROM customer LEFT JOIN l ON b = c_custkey),
d AS (SELECT *, CASE WHEN none THEN 'skipped' WHEN NOT h AND NOT v THEN 'llm_failed' WHEN h AND coalesce(h_ok, false) OR v AND coalesce(v_ok, false) THEN 'success' ELSE 'failed' END AS status,
             CASE WHEN none OR NOT h AND NOT v THEN NULL WHEN h AND coalesce(h_ok, false) OR NOT v THEN 'helper' ELSE 'solve' END AS p FROM c),
e AS (SELECT *, CASE p WHEN 'helper' THEN 'int helper(int a) { return ' || b || '; }' WHEN 'solve' THEN 'int solve(int n) { return 0; }' END AS code,
             'int helper(int a) { return a + ' || n || '; }' AS h0, 'int solve(int n) { return n * 2; }' AS s0 FROM d)
SELECT b AS bug_id, status, CASE WHEN none THEN NULL WHEN status = 'success' THEN 'x.c::' || p ELSE 'x.c::solve' END AS selected_function, code AS patched_function,
  sha256(CASE p WHEN 'helper' THEN code || chr(10) || s0 || chr(10) WHEN 'solve' THEN h0 || chr(10) || code || chr(10) END) AS file_sha256,
  CASE WHEN status = 'success' THEN b || '_patch.c' END AS patch_file,
  coalesce(array_to_string(o, ','), '') AS init_passed_tests, coalesce(array_to_string(f, ','), '') AS init_failed_tests,
  coalesce(CASE p WHEN 'helper' THEN array_to_string(o, ',') WHEN 'solve' THEN array_to_string(nf, ',') END, '') AS post_passed_tests,
  coalesce(CASE p WHEN 'helper' THEN array_to_string(no, ',') WHEN 'solve' THEN array_to_string(f, ',') END, '') AS post_failed_tests FROM e"""


def repair_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as bugs, brands as engines; names make the patched and the accepted code. Some rows have no status."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("bug_id"), F.col("p_brand").alias("engine"), "p_name", "p_size")
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("bug_id"), "l_linestatus", (F.col("l_returnflag") == "R").alias("failed"), F.col("l_linenumber").cast("string").alias("t"))
    side = lambda s, failed: F.array_sort(F.collect_set(F.when((F.col("l_linestatus") == s) & (F.col("failed") == failed), F.col("t"))))
    sets = lines.groupBy("bug_id").agg(side("F", False).alias("init_passed_tests"), side("F", True).alias("init_failed_tests"), side("O", False).alias("post_passed_tests"), side("O", True).alias("post_failed_tests"))
    kind = F.col("p_size") % 10
    status = F.when(kind == 0, F.when(F.col("p_size") < 30, "skipped")).when(kind == 1, "llm_failed").when(kind < 5, "success").otherwise("failed")
    code = lambda c: F.concat(F.lit("int f(int a) { return "), c, F.lit("; }"))
    repairs = part.join(sets, "bug_id").select(
        "bug_id", "engine", status.alias("status"), code(F.col("p_name")).alias("patched_function"), F.concat(F.lit("static "), code(F.col("p_name"))).alias("patched_file"), F.lit("x.c::f").alias("selected_function"),
        *repair.RESULT[-4:],
    )
    accepted = part.select((F.col("bug_id") - 1).alias("bug_id"), code(F.col("p_name")).alias("text"))
    out = repair.evaluation(repair.evaluated(repairs, accepted), ["engine"])
    whole = ("median", "least", "most")
    return out.select(*(F.col(c).cast("long").alias(c) if c.endswith(whole) else F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes))


EVALUATION_SQL = """
WITH s AS (SELECT l_partkey AS b, coalesce(list(DISTINCT l_linenumber) FILTER (l_linestatus = 'F' AND l_returnflag <> 'R'), []) AS ip, coalesce(list(DISTINCT l_linenumber) FILTER (l_linestatus = 'F' AND l_returnflag = 'R'), []) AS i,
             coalesce(list(DISTINCT l_linenumber) FILTER (l_linestatus = 'O' AND l_returnflag <> 'R'), []) AS pp, coalesce(list(DISTINCT l_linenumber) FILTER (l_linestatus = 'O' AND l_returnflag = 'R'), []) AS p FROM lineitem GROUP BY 1),
n AS (SELECT p_partkey - 1 AS b, 'intf(inta){return' || replace(p_name, ' ', '') || ';}' AS other FROM part),
r AS (SELECT p_brand AS engine, s.*, p_size, p_size %% 10 AS k, len(list_filter(i, lambda x: NOT list_contains(p, x))) > 0 AS fixed, len(list_filter(p, lambda x: NOT list_contains(i, x))) > 0 AS broken,
             levenshtein('intf(inta){return' || replace(p_name, ' ', '') || ';}', other) AS fd, levenshtein('staticintf(inta){return' || replace(p_name, ' ', '') || ';}', other) AS ld
      FROM part JOIN s ON s.b = p_partkey LEFT JOIN n ON n.b = p_partkey),
t AS (SELECT *, k > 1 AS tried, k BETWEEN 2 AND 4 AND len(pp) = 0 AS silent, CASE WHEN fixed AND NOT broken THEN 'CleanFix' WHEN fixed THEN 'NoiseFix' WHEN broken THEN 'NegFix' ELSE 'NoneFix' END AS label FROM r)
SELECT engine, count(*) AS total, count(*) FILTER (k = 1) AS n_llm_failed, count(*) FILTER (k = 0 AND p_size < 30) AS n_skipped,
  coalesce(sum(CASE WHEN silent THEN len(ip) + len(i) ELSE len(pp) END) FILTER (tried), 0)::BIGINT AS post_passed, coalesce(sum(CASE WHEN silent THEN 0 ELSE len(p) END) FILTER (tried), 0)::BIGINT AS post_failed,
  count(*) FILTER (tried) AS attempted, %s,
  count(*) FILTER (tried AND len(i) > 0 AND NOT broken AND NOT list_has_any(i, p)) AS plausible,
  round(100.0 * count(*) FILTER (tried AND label IN ('CleanFix', 'NoiseFix')) / nullif(count(*) FILTER (tried), 0), 6)::DOUBLE AS any_fix_percent,
  round(100.0 * count(*) FILTER (tried AND label IN ('NoiseFix', 'NegFix')) / nullif(count(*) FILTER (tried), 0), 6)::DOUBLE AS regression_percent, %s FROM t GROUP BY engine"""
EVALUATION_SQL %= (
    ", ".join(f"count(*) FILTER (tried AND label = '{x}') AS {x}" for x in results.LABELS),
    ", ".join(
        f"count({d}) FILTER (tried) AS {c}_n, round(avg({d}) FILTER (tried), 6) AS {c}_mean, list_sort(list({d}) FILTER (tried AND {d} IS NOT NULL))[count({d}) FILTER (tried) // 2 + 1]::BIGINT AS {c}_median, "
        f"min({d}) FILTER (tried)::BIGINT AS {c}_least, max({d}) FILTER (tried)::BIGINT AS {c}_most"
        for d, c in (("fd", "func_distance"), ("ld", "file_distance"))
    ),
)


def localization_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as bugs, order priorities as methods scored by their share of failed orders; some bugs lack scores or truth."""
    orders = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("bug_id"), F.col("o_orderpriority").alias("method")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("score"))
    scores = orders.groupBy("bug_id").agg(F.map_from_entries(F.collect_list(F.struct("method", "score"))).alias("scores"))  # five methods at most
    truth = F.when(F.col("bug_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("1-URGENT"), F.lit("5-LOW")))
    bugs = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bug_id")).withColumn("ground_truth", truth)
    out = spectrum.evaluation(bugs.join(scores, "bug_id", "left"))
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes))


LOCALIZATION_SQL = """
WITH s AS (SELECT o_custkey AS b, o_orderpriority AS m, avg((o_orderstatus = 'F')::INTEGER::DOUBLE) AS score FROM orders GROUP BY 1, 2),
r AS (SELECT *, count(*) OVER (PARTITION BY b ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank, count(*) OVER (PARTITION BY b) AS n FROM s WHERE b %% 4 <> 0),
p AS (SELECT u.b, u.n, coalesce(r.rank, u.n + 1) AS rank FROM (SELECT b, n, '1-URGENT' AS m FROM r GROUP BY 1, 2 UNION ALL SELECT b, n, '5-LOW' FROM r GROUP BY 1, 2) u
      LEFT JOIN r ON r.b = u.b AND r.m = u.m),
g AS (SELECT b, min(rank) AS first_rank, avg(rank) AS avg_rank, min(rank) / any_value(n)::DOUBLE AS exam FROM p GROUP BY b)
SELECT count(*) AS evaluated, %s, round(avg(first_rank), 6) AS mfr, round(avg(avg_rank), 6) AS mar, round(avg(exam), 6) AS exam,
  (SELECT count(*) FROM customer) AS total,
  (SELECT count(*) FROM customer WHERE c_custkey %% 4 = 0 AND c_custkey IN (SELECT b FROM s)) AS skipped_no_gt, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT b FROM s)) AS skipped_no_scores FROM g"""
LOCALIZATION_SQL %= ", ".join(f"count(*) FILTER (first_rank <= {k}) AS top{k}, round(100.0 * count(*) FILTER (first_rank <= {k}) / count(*), 6)::DOUBLE AS top{k}_percent" for k in (1, 3, 5))


def changed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each part against one in which the helper, the main function or nothing was changed, by the part's size."""
    rows = code_text(spark, sf_dir)
    kind = F.col("p_size") % 3
    changed = F.when(kind == 0, F.replace("code", F.lit("a + 1"), F.lit("a + 2"))).when(kind == 1, F.replace("code", F.lit("n * 2"), F.lit("n * 3"))).otherwise(F.col("code"))
    out = repair.changed_function(rows.select(F.col("p_partkey").alias("id"), F.col("code").alias("original"), changed.alias("repaired")))
    return out.select(F.col("id").alias("p_partkey"), "name", "code")


def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses, counts and lines of logs composed from events."""
    said = F.when(F.col("event_type") == "purchase", "Repair Found").when(F.col("event_type") == "click", "Timeout").otherwise("nothing")
    log = F.concat(F.lit("start\nbooo\n"), said, F.lit("\nPositive Cases: Tot "), (F.col("user_id") % 9).cast("string"), F.lit("\nDiff Cases: Tot "), (F.col("user_id") % 4).cast("string"))
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", log.alias("log"))
    counts = logs.revlog_counts(F.col("log"), F.lit(7), F.lit(3))
    status = logs.final_status(logs.run_status(F.col("log")), F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0, F.col("user_id") % 5)
    return rows.select(
        "event_id", counts["pos"].alias("pos"), counts["neg"].alias("neg"), status.alias("status"), F.size(logs.last_lines(F.col("log"), 3)).alias("n_last"),
        F.length(logs.without_lines(F.col("log"), "booo")).alias("n_kept"), F.length(logs.settings_with(F.col("log"), {"start": "1"})).alias("n_set"),
    )


LOGS_SQL = """
WITH e AS (SELECT event_id, user_id u, CASE event_type WHEN 'purchase' THEN 'Repair Found' WHEN 'click' THEN 'Timeout' ELSE 'nothing' END AS said FROM events),
s AS (SELECT *, CASE said WHEN 'Timeout' THEN 'timeout' WHEN 'Repair Found' THEN 'repair_found' ELSE 'no_repair' END AS run,
             length('start' || chr(10) || 'booo' || chr(10) || said || chr(10) || 'Positive Cases: Tot ' || (u % 9) || chr(10) || 'Diff Cases: Tot ' || (u % 4)) AS n FROM e)
SELECT event_id, (CASE WHEN u % 9 = 0 AND u % 4 = 0 THEN 7 ELSE u % 9 END)::INTEGER AS pos, (CASE WHEN u % 9 = 0 AND u % 4 = 0 THEN 3 ELSE u % 4 END)::INTEGER AS neg,
  CASE WHEN run = 'timeout' AND u % 2 <> 0 THEN 'timeout'
       WHEN run IN ('timeout', 'repair_found') AND u % 3 = 0 AND u % 5 = 0 THEN CASE run WHEN 'timeout' THEN 'timeout_repaired' ELSE 'success' END
       WHEN run IN ('timeout', 'repair_found') AND u % 3 = 0 THEN CASE run WHEN 'timeout' THEN 'timeout_plausible' ELSE 'plausible_only' END
       WHEN run IN ('timeout', 'repair_found') THEN 'repair_found_no_file' ELSE run END AS status,
  3 AS n_last, (n - 5)::INTEGER AS n_kept, (n - 6 + 8)::INTEGER AS n_set FROM s"""

#: Lines without trailing blanks, and no blank lines at the end.
COMPARABLE_SQL = "regexp_replace(regexp_replace(%s, '[ \\t\\r\\f\\v]+(\\n|$)', '\\1', 'g'), '\\n+$', '')"

QUERIES = {
    "suspiciousness": suspiciousness,
    "localization_by_bug": localization_by_bug,
    "localization_accuracy": localization_accuracy,
    "fix_classes": fixes,
    "fix_summary": fix_summary,
    "status_counts": status_counts,
    "resume": resume,
    "upsert": upsert,
    "bucketed_upsert": bucketed_upsert,
    "engines": engines,
    "qualified_names": qualified_names,
    "version_files": version_files,
    "test_lists": test_lists,
    "normalised_code": normalised_code,
    "normalised_pages": normalised_pages,
    "code_mutants": code_mutants,
    "extracted_functions": extracted_functions,
    "mutants": page_mutants,
    "distance_stats": distance_stats,
    "keyed_documents": keyed_documents,
    "text_distances": text_distances,
    "comparable_outputs": comparable_outputs,
    "candidate_choice": candidate_choice,
    "run_logs": run_logs,
    "repair_results": repair_results,
    "tiered_repairs": tiered_repairs,
    "repair_evaluation": repair_evaluation,
    "localization_evaluation": localization_evaluation,
    "changed_functions": changed_functions,
}

SQL = {
    "suspiciousness": SUSPICIOUSNESS_SQL,
    "localization_by_bug": f"WITH {SPECTRA_SQL}, {TRUTH_SQL} SELECT bug_id, first_rank, round(avg_rank, 6) AS avg_rank, n_methods, round(exam, 6) AS exam FROM bugs",
    "localization_accuracy": f"""WITH {SPECTRA_SQL}, {TRUTH_SQL} SELECT count(*) AS evaluated,
        {', '.join(f"count(*) FILTER (first_rank <= {k}) AS top{k}, round(100.0 * count(*) FILTER (first_rank <= {k}) / count(*), 6)::DOUBLE AS top{k}_percent" for k in (1, 3, 5))},
        round(avg(first_rank), 6) AS mfr, round(avg(avg_rank), 6) AS mar, round(avg(exam), 6) AS exam FROM bugs""",
    "fix_classes": f"WITH {FIXES_SQL} SELECT * FROM fixes",
    "fix_summary": f"""WITH {FIXES_SQL} SELECT p_brand AS engine, count(*) AS attempted,
        {', '.join(f"count(*) FILTER (label = '{x}') AS {x}" for x in results.LABELS)}, count(*) FILTER (is_plausible) AS plausible,
        round(100.0 * count(*) FILTER (label IN ('CleanFix', 'NoiseFix')) / count(*), 6)::DOUBLE AS any_fix_percent,
        round(100.0 * count(*) FILTER (label IN ('NegFix', 'NoiseFix')) / count(*), 6)::DOUBLE AS regression_percent
        FROM fixes JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
    "status_counts": f"""WITH s AS (SELECT user_id % 10 AS engine, {STATUS_SQL} AS status FROM events)
        SELECT engine, count(*) AS total, count(*) FILTER (status IN ('success', 'timeout_repaired')) AS repaired, count(*) FILTER (status = 'no_repair') AS unrepaired,
        count(*) FILTER (status = 'skipped') AS set_aside, round(100.0 * count(*) FILTER (status IN ('success', 'timeout_repaired')) / count(*), 6)::DOUBLE AS fix_percent FROM s GROUP BY engine""",
    "resume": f"WITH o AS ({LATEST_SQL % 1}), p AS ({LATEST_SQL % 0}) SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.bug_id = o.bug_id AND p.status <> 'skipped')",
    "upsert": f"WITH o AS ({LATEST_SQL % 1}), p AS ({LATEST_SQL % 0}) SELECT * FROM o UNION ALL SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE p.bug_id = o.bug_id)",
    "bucketed_upsert": f"WITH o AS ({LATEST_SQL % 1}), p AS ({LATEST_SQL % 0}) SELECT * FROM o UNION ALL SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE p.bug_id = o.bug_id)",
    "keyed_documents": "SELECT doc_id, sha256(text) AS text_sha256, lang FROM documents",
    "text_distances": """SELECT doc_id, (length(t) - length(replace(t, 'z', '')))::INTEGER AS dropped, (length(t) - length(replace(t, 'q', '')))::INTEGER AS replaced
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "engines": f"""WITH u AS (SELECT 'odd' AS engine, * FROM ({LATEST_SQL % 1}) UNION ALL SELECT 'even', * FROM ({LATEST_SQL % 0}))
        SELECT engine, count(*) AS n, count(*) FILTER (status <> 'skipped') AS n_attempted FROM u GROUP BY engine""",
    "qualified_names": """WITH q AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name ELSE '/src/' || p_type || '::' || CASE WHEN p_size % 2 = 0 THEN 'ns::' ELSE '' END || p_name END AS q FROM part)
        SELECT p_partkey, CASE WHEN contains(q, '::') THEN left(q, length(q) - length(string_split(q, '::')[-1]) - 2) ELSE '' END AS source_file, string_split(q, '::')[-1] AS func_name FROM q""",
    "version_files": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '9-' || o_orderstatus || '-' || o_orderkey || '.c' END AS buggy_file,
        CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '9-' || o_orderstatus || '-' || o_custkey || '.c' END AS accepted_file,
        CASE WHEN o_orderkey % 7 = 0 THEN '/data/bug' || o_orderkey ELSE '/data/9-' || o_orderstatus || '-bug-' || o_orderkey || '-' || o_custkey || '/9-' || o_orderstatus || '-' || o_orderkey || '.c' END AS source_path FROM orders""",
    "test_lists": """SELECT o_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (o_orderstatus = 'O'), '') AS init_passed,
        coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (o_orderstatus = 'F'), '') AS init_failed,
        coalesce(60 * length(arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F')) > 500, false) AS truncated FROM orders GROUP BY o_custkey""",
    "normalised_code": f"WITH {CODE_SQL} SELECT p_partkey, {NORM_SQL} AS code FROM code",
    "normalised_pages": f"""WITH c AS (SELECT page_id, {PAGES_SQL} AS code FROM pages)
        SELECT page_id, sha256(code) AS code_sha256, length(code)::INTEGER AS n_chars FROM c""",
    "extracted_functions": f"""WITH {CODE_SQL}, s AS (SELECT p_partkey, code, instr(code, 'int solve') AS a FROM code)
        SELECT p_partkey, (a - 1)::INTEGER AS start_at, (length(code) - 1)::INTEGER AS end_at, substr(code, a, length(code) - a) AS code FROM s""",
    "distance_stats": """WITH d AS (SELECT a.p_brand, levenshtein(replace(a.p_name, ' ', ''), replace(b.p_name, ' ', '')) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
        SELECT p_brand, count(*) AS n, round(avg(distance), 6) AS mean, (list_sort(list(distance))[(count(*) // 2 + 1)::INTEGER])::INTEGER AS median,
        min(distance)::INTEGER AS least, max(distance)::INTEGER AS most FROM d GROUP BY p_brand""",
    "candidate_choice": CHOICE_SQL,
    "run_logs": LOGS_SQL,
    "repair_results": REPAIRS_SQL,
    "tiered_repairs": REPAIRS_SQL.replace(" FROM e", """,
  CASE WHEN none THEN 0 ELSE (h::INTEGER + (v AND NOT (h AND coalesce(h_ok, false)))::INTEGER) END::BIGINT AS n_validated FROM e"""),
    "repair_evaluation": EVALUATION_SQL,
    "localization_evaluation": LOCALIZATION_SQL,
    "changed_functions": f"""WITH {CODE_SQL}, c AS (SELECT code.*, p_size % 3 AS k FROM code JOIN part USING (p_partkey))
        SELECT p_partkey, CASE k WHEN 0 THEN 'helper' WHEN 1 THEN 'solve' END AS name,
        CASE k WHEN 0 THEN 'int helper(int a) {{ return a + 2; }}' WHEN 1 THEN replace(substr(code, instr(code, 'int solve'), length(code) - instr(code, 'int solve')), 'n * 2', 'n * 3') END AS code FROM c""",
    "mutants": f"""WITH {CODE_SQL}, m AS (SELECT * FROM (VALUES {', '.join(f"({i + 1}, '(n < ', '(n {t} ', '<', '{t}')" for i, t in enumerate(("<=", ">", ">=", "==", "!=")))},
          (6, 'a + 1', 'a - 1', '+', '-'), (7, 'n - 1', 'n + 1', '-', '+'), (8, 'a + 1', 'a ', '+ 1', ''), (9, 'n - 1', 'n ', '- 1', '')) AS v(mutant_ordinal, was, put, said, by_))
        SELECT p_partkey, mutant_ordinal, sha256(replace(code, was, put)) AS code_sha256, {" || ".join(f"'{x}'" if i % 2 == 0 else x for i, x in enumerate([m.DESCRIPTION.split("%s")[0].replace("'", "''"), "said", m.DESCRIPTION.split("%s")[1].replace("'", "''"), "by_", m.DESCRIPTION.split("%s")[2].replace("'", "''")]))} AS description FROM code, m""",
    "comparable_outputs": f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations),
        c AS (SELECT conv_id, turn, {', '.join(COMPARABLE_SQL % x + f' AS {n}' for x, n in (("t", "plain"), ("replace(t, chr(10), ' ' || chr(9) || chr(10)) || '  ' || chr(10) || chr(10)", "loose"), ("' ' || t", "indented")))} FROM t)
        SELECT conv_id, turn, loose = plain AS same, indented = plain AS same_indented FROM c""",
}
