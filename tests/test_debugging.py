"""Hand fixtures and fuzz for spectra, ranks, code text, mutants, results and readers."""

import json
import random
import re

from pyspark.sql import functions as F

from tracewright.functions import codetext, logs, names
from tracewright.operators import mutants, repair, results, spectrum
from tracewright.plans import tables
from tracewright.sources import bugs as sources


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_scores_follow_the_rules(spark):
    schema = "bug_id string, tests array<struct<test_id:string,outcome:string,covered_methods:array<string>>>"
    rows = [
        ("a", [("1", "PASS", ["a"]), ("2", "fail", ["a", "b"]), ("3", "PASS", ["a"]), ("4", "SKIP", ["z"])]),
        ("p", [("1", "PASS", ["a"])]),
        ("f", [("1", "FAILED", ["a"])]),
        ("d", [("1", "FAIL", ["a", "a"]), ("2", "PASSED", ["a"])]),
    ]
    got = spectrum.suspiciousness(*spectrum.exploded(spark.createDataFrame(rows, schema))).collect()
    score = {(r["bug_id"], r["method"]): r["score"] for r in got}
    assert score == {("a", "a"): 0.5, ("a", "b"): 1.0, ("p", "a"): 0.0, ("f", "a"): 1.0, ("d", "a"): 2 / 3}


def test_localization_from_files_to_accuracy(spark, tmp_path):
    test = lambda i, outcome, methods: {"test_id": str(i), "outcome": outcome, "covered_methods": methods}
    bugs = {
        "1-A-bug-1-2": ([test(1, "PASS", ["f"]), test(2, "FAIL", ["f", "g"])], ["g"]), "2-A-bug-1-2": ([test(1, "FAIL", ["f", "g"])], ["f"]),
        "3-A-bug-1-2": ([test(1, "FAIL", [])], ["f"]), "4-A-bug-1-2": ([test(1, "FAIL", ["f"])], []),
    }
    for bug, (tests, truth) in bugs.items():
        (tmp_path / f"{bug}.json").write_text(json.dumps({"tests": tests, "ground_truth_functions": truth}))
    found = spectrum.localize(sources.bugs(spark, str(tmp_path)))
    scores = {r["bug_id"]: {k.split("::")[-1]: v for k, v in r["scores"].items()} for r in found.collect()}
    assert scores == {"1-A-bug-1-2": {"f": 0.5, "g": 1.0}, "2-A-bug-1-2": {"f": 1.0, "g": 1.0}, "3-A-bug-1-2": {}, "4-A-bug-1-2": {"f": 1.0}}
    row = spectrum.evaluation(found).first()
    assert (row["total"], row["evaluated"], row["skipped_no_gt"], row["skipped_no_scores"], row["top1"], row["mfr"], row["exam"]) == (4, 2, 1, 1, 1, 1.5, 0.75)


def test_ties_rank_last_and_missing_truth_ranks_behind(spark):
    scores = spark.createDataFrame([("x", "A", 0.8), ("x", "B", 0.8), ("x", "C", 0.5)], "bug_id string, method string, score double")
    ranked = spectrum.worst_case_rank(scores)
    assert {r["method"]: r["rank"] for r in ranked.collect()} == {"A": 2, "B": 2, "C": 3}
    row = spectrum.by_bug(ranked, spark.createDataFrame([("x", "gone")], "bug_id string, method string")).first()
    assert (row["first_rank"], row["exam"]) == (4, 4 / 3)


def test_fix_classes(spark):
    cases = [(["n1"], [], "CleanFix", True), (["n1"], ["p1"], "NoiseFix", False), (["n1"], ["n1"], "NoneFix", False), (["n1"], ["n1", "p1"], "NegFix", False), ([], [], "NoneFix", False)]
    df = spark.createDataFrame([(b, a) for b, a, _, _ in cases], "b array<string>, a array<string>")
    got = df.select(results.fix_class(F.col("b"), F.col("a")), results.plausible(F.col("b"), F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(label, ok) for _, _, label, ok in cases]


def test_names_and_logs(spark):
    q, b = F.col("q"), F.col("b")
    assert one(spark, names.buggy_file(b), b="476-A-bug-16608008-16608059") == "476-A-16608008.c"
    assert one(spark, names.accepted_file(b), b="476-A-bug-16608008-16608059") == "476-A-16608059.c"
    assert one(spark, names.buggy_file(b), b="abc") == ""
    assert one(spark, F.concat_ws("|", names.source_of(q), names.bare_name(q)), q="/path/to/file.c::solve") == "/path/to/file.c|solve"
    assert one(spark, F.concat_ws("|", names.source_of(q), names.bare_name(q)), q="main") == "|main"
    assert one(spark, logs.logged_count(q, "Positive Cases"), q="Diff Cases: Tot 1\nPositive Cases: Tot 2") == 2
    assert one(spark, logs.run_status(q), q="Timeout ... Repair Found") == "timeout"
    assert one(spark, names.unfenced(q), q="so:\n```c\nint a;\n```\nend") == "int a;"


def test_median_is_the_upper_one(spark):
    df = spark.createDataFrame([("e", x) for x in (1, 5, 7, 9, -1)], "engine string, distance int")
    row = results.distance_stats(df, ["engine"]).first()
    assert (row["n"], row["mean"], int(row["median"]), row["least"], row["most"]) == (4, 5.5, 7, 1, 9)


def brace_oracle(text):
    depth, i, n = 0, 0, len(text)
    while i < n:
        c = text[i]
        if text.startswith("//", i):
            i = text.find("\n", i)
            if i < 0:
                return -1
        elif text.startswith("/*", i):
            i = text.find("*/", i + 2)
            if i < 0:
                return -1
            i += 1
        elif c in "\"'":
            i += 1
            while i < n and text[i] != c:
                i += 2 if text[i] == "\\" else 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    return -1


def test_braces_against_a_scanner(spark):
    rng = random.Random(1)
    texts = ["{" + "".join(rng.choice(['{', '}', '"', "'", "\\", "a", " ", "\n", "//", "/*", "*/"]) for _ in range(rng.randrange(25))) for _ in range(800)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(codetext.matching_brace(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [brace_oracle(t) for t in texts]


def test_code_text(spark):
    assert one(spark, codetext.normalised(F.col("s")), s='int a = 1; // x\ns = "a b";') == 'inta=1;s="a b";'
    assert one(spark, codetext.function_span(F.col("s"), F.lit("solve"))["start"], s="bool solve(int n){ }") == 4
    assert one(spark, codetext.same_output(F.col("a"), F.col("b")), a="1 2 \n\n", b="1 2") is True
    assert one(spark, codetext.same_output(F.col("a"), F.col("b")), a=" 1", b="1") is False


def mutant_oracle(code):
    out = []
    for pattern, replacements in mutants.RULES:
        for m in re.finditer(pattern, code):
            for r in replacements:
                if m[0].strip() != r.strip() and (t := code[: m.start()] + r + code[m.end() :]) not in out:
                    out.append(t)
    return out


def test_mutants_against_python(spark):
    rng = random.Random(2)
    codes = ["a+1", "a + 1"] + ["".join(rng.choice(["a", "b1", " ", "<", ">", "=", "!=", "+", "-", "1", "<=", "== "]) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    got = mutants.mutants(spark.createDataFrame(list(enumerate(codes)), "id int, code string")).orderBy("id", "mutant_ordinal").collect()
    found = {i: [] for i in range(len(codes))}
    for r in got:
        found[r["id"]].append(r["code"])
    assert found == {i: mutant_oracle(c) for i, c in enumerate(codes)}


def test_choice_of_candidates(spark):
    schema = "bug_id string, method_order int, ord int, candidate_id long, n_passed long, valid boolean"
    rows = [("a", 1, 1, 1, 0, False), ("a", 1, 2, 2, 3, True), ("a", 2, 1, 3, 3, True), ("b", 1, 1, 4, 9, False), ("b", 2, 1, 5, 2, False), ("b", 2, 2, 6, 2, False)]
    got = {r["bug_id"]: (r["status"], r["candidate_id"]) for r in results.chosen(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("success", 2), "b": ("failed", 5)}


def test_repair_by_replay_and_by_mutants(spark):
    source = "int f(int a) {\n  return a + 1;\n}\n"
    scores = spark.createDataFrame([("x", "p.c::f", 1.0), ("x", "p.c::g", 0.0)], "bug_id string, method string, score double")
    targets = repair.targets(scores, spark.createDataFrame([("x", source)], "bug_id string, text string"))
    bugs = spark.createDataFrame([("x", [])], f"bug_id string, tests array<{sources.TEST}>")
    replies = spark.createDataFrame([("x", "p.c::f", "```c\nint f(int a) { return a; }\n```")], "bug_id string, method string, reply string")
    assert repair.prompted(targets, bugs, repair.replay(replies)).first()["patched_file"] == "int f(int a) { return a; }\n"
    assert {r["patched_file"] for r in repair.mutated(targets).collect()} == {source.replace(" + 1", x) for x in (" - 1", " ")}
    pair = spark.createDataFrame([("x", source, source.replace("+", "-"))], "id string, original string, repaired string")
    assert repair.changed_function(pair).first()["name"] == "f"


def test_readers(spark, tmp_path):
    (tmp_path / "9-A-bug-1-2.json").write_text(json.dumps({"tests": [{"test_id": "t", "outcome": "FAIL", "covered_methods": ["f"]}], "ground_truth_functions": ["f", "/x.c::g"]}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "note.txt").write_text("{}")
    got = sources.bugs(spark, str(tmp_path), "/src").collect()
    assert [(r["bug_id"], r["ground_truth"]) for r in got] == [("9-A-bug-1-2", ["/src/9-A-bug-1-2/9-A-1.c::f", "/x.c::g"])]
    assert sources.bug(spark, str(tmp_path), "none").count() == 0
    path = tmp_path / "scores"
    path.write_text(json.dumps({"b": {"scores": {"f": 0.5}, "ground_truth": ["f"]}}))
    assert [tuple(r) for r in sources.recorded_scores(spark, str(path)).collect()] == [("b", {"f": 0.5}, ["f"])]


def test_upsert(spark, tmp_path, monkeypatch):
    table, schema = str(tmp_path / "t"), "bug_id string, status string"
    read = lambda: {tuple(r) for r in sources.stored(spark, table, schema).collect()}
    assert read() == set()
    for rows in ([("a", "failed"), ("b", "skipped")], [("b", "success"), ("c", None)]):
        sources.write_upserted(spark.createDataFrame(rows, schema), table)
    want = {("a", "failed"), ("b", "success"), ("c", None)}
    assert read() == want
    broken = spark.createDataFrame([("a", "x")], schema).withColumn("status", F.raise_error(F.lit("lost")).cast("string"))
    for _ in range(2):
        try:
            sources.write_upserted(broken, table)
            raise AssertionError("the write should fail")
        except Exception as e:
            assert "lost" in str(e)
        assert read() == want
    sources.write_upserted(spark.createDataFrame([("d", "failed")], schema), table)
    assert read() == want | {("d", "failed")} and len(list((tmp_path / "t").glob("version-*"))) == 2
    scores = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "bug_id string")
    prior = spark.createDataFrame([("a", "skipped"), ("b", "failed"), ("c", None)], "bug_id string, status string")
    assert {r["bug_id"] for r in results.pending(scores, prior).collect()} == {"a", "d"}


def test_patches_and_scores_are_written_and_read(spark, tmp_path):
    rows = [("a_patch.c", SOURCE), ("b_genprog_patch.c", "int x;\n\n"), (None, "lost"), ("c_patch.c", None)]
    sources.write_patches(spark.createDataFrame(rows, "patch_file string, patched_file string"), str(tmp_path / "p"))
    assert {tuple(r) for r in sources.patches(spark, str(tmp_path / "p")).collect()} == set(rows[:2])
    scores = spark.createDataFrame([("x", "f", 1.0), ("x", "g", 0.5), ("y", "f", 0.0)], "bug_id string, method string, score double")
    value = sources.scores_document(scores, spark.createDataFrame([("x", "f")], "bug_id string, method string")).first()["value"]
    (tmp_path / "s.json").write_text(value)
    got = {r["bug_id"]: (r["scores"], r["ground_truth"]) for r in sources.recorded_scores(spark, str(tmp_path / "s.json")).collect()}
    assert got == {"x": ({"f": 1.0, "g": 0.5}, ["f"]), "y": ({"f": 0.0}, [])}
    (tmp_path / "r.json").write_text(json.dumps({"x": {"status": "failed", "post_failed_tests": ["t"]}}))
    assert [(r["bug_id"], r["status"], r["post_failed_tests"]) for r in sources.recorded_results(spark, str(tmp_path / "r.json")).collect()] == [("x", "failed", ["t"])]


def test_missing_files_have_no_rows(spark, tmp_path):
    gone = str(tmp_path / "gone")
    found = [sources.bugs(spark, gone), sources.bug(spark, gone, "x"), sources.metadata(spark, gone), sources.recorded_scores(spark, gone), sources.recorded_results(spark, gone), sources.cases(spark, gone), sources.source_texts(spark, gone)]
    assert [df.count() for df in found] == [0] * len(found) and found[0].columns[:2] == ["bug_id", "dataset"]


def test_cases_in_order(spark, tmp_path):
    for bug in ("1-A-bug-1-2", "2-B-bug-3-4"):
        folder = tmp_path / bug
        folder.mkdir()
        for name in ("pos10", "pos2", "neg1", "heldout-neg1", "heldout-pos3", "pos7"):
            (folder / f"input-{name}").write_text("1")
            if name != "pos7":
                (folder / f"output-{name}").write_text("1")
    got = sources.cases(spark, [str(tmp_path / b) for b in ("1-A-bug-1-2", "2-B-bug-3-4")]).orderBy("bug_id", "place").collect()
    assert [r["test_id"] for r in got] == ["pos10", "pos2", "neg1", "heldout-pos3", "heldout-neg1"] * 2 and {r["bug_id"] for r in got} == {"1-A-bug-1-2", "2-B-bug-3-4"}


SOURCE = "int f(int a) {\n  return a + 1;\n}\nint g(int a) {\n  return 7;\n}\n"
TESTS = [("t1", "PASS", [], "1", "1", None), ("t2", "FAIL", [], "2", "3", "wrong"), ("t3", "pass", [], "", "", None)]


def repair_inputs(spark):
    scores = [("x", "p.c::g", 0.9), ("x", "p.c::f", 0.8), ("y", "p.c::f", 0.8), ("y", "p.c::g", 0.5), ("z", "p.c::f", 0.0), ("v", "p.c::g", 1.0), ("w", "p.c::f", 1.0)]
    ids = [b for b in "xyzv"]
    return (
        spark.createDataFrame(scores, "bug_id string, method string, score double"),
        spark.createDataFrame([(b, SOURCE) for b in ids], "bug_id string, text string"),
        spark.createDataFrame([(b, TESTS) for b in ids if b != "v"], f"bug_id string, tests array<{sources.TEST}>"),
    )


def test_result_rows_of_mutants(spark):
    facts = [("x", "p.c::f", 1, "t2", False), ("x", "p.c::f", 1, "t1", True), ("x", "p.c::f", 2, "t2", True), ("x", "p.c::f", 2, "t1", True), ("y", "p.c::f", 2, "t1", True), ("y", "p.c::f", 2, "t2", False)]
    facts = spark.createDataFrame(facts, "bug_id string, method string, ord int, test_id string, passed boolean")
    got = {r["bug_id"]: r for r in repair.repaired_by_mutants(*repair_inputs(spark), repair.recorded(facts)).collect()}
    assert set(got) == {"x", "y", "z", "v"}
    x, y = got["x"], got["y"]
    assert (x["status"], x["selected_function"], x["patch_file"]) == ("success", "p.c::f", "x_mutation_patch.c") and x["patched_file"] == SOURCE.replace(" + 1", " ")
    assert (x["init_passed_tests"], x["init_failed_tests"], x["post_passed_tests"], x["post_failed_tests"]) == (["t1"], ["t2"], ["t1", "t2"], []) and x["mutation_strategy"] == mutants.DESCRIPTION % ("+ 1", "")
    assert (y["status"], y["selected_function"], y["patch_file"]) == ("failed", "p.c::g", "y_mutation_best_effort.c")  # the last function tried, though it has no mutant
    assert y["patched_file"] == SOURCE.replace(" + 1", " ") and (y["post_passed_tests"], y["post_failed_tests"]) == (["t1"], ["t2"])
    assert (got["z"]["status"], got["z"]["selected_function"], got["z"]["patched_file"]) == ("skipped", None, None)
    assert (got["v"]["status"], got["v"]["selected_function"], got["v"]["init_passed_tests"]) == ("skipped", "p.c::g", [])


def test_result_rows_of_replies(spark):
    scores, files, bugs = repair_inputs(spark)
    note = f"```c\n{names.NOTE}\nint f(int a) {{ return a; }}\n```"
    replies = spark.createDataFrame([("x", "p.c::f", note), ("y", "p.c::f", "int f(int a) { return 0; }")], "bug_id string, method string, reply string")
    facts = spark.createDataFrame([("x", "p.c::f", 1, "t2", True), ("y", "p.c::f", 1, "t2", False)], "bug_id string, method string, ord int, test_id string, passed boolean")
    prompts = []
    provider = lambda asked: prompts.append(asked) or repair.replay(replies)(asked)
    got = {r["bug_id"]: r for r in repair.repaired_by_replies(scores, files, bugs, provider, repair.recorded(facts)).collect()}
    state = {b: (r["status"], r["selected_function"], r["patched_function"], r["patch_file"]) for b, r in got.items()}
    assert state == {
        "x": ("success", "p.c::f", "int f(int a) { return a; }", "x_patch.c"),
        "y": ("failed", "p.c::g", "int f(int a) { return 0; }", None),
        "z": ("skipped", None, None, None),
        "v": ("llm_failed", "p.c::g", None, None),
    }
    said = prompts[0].where("bug_id = 'x' AND method = 'p.c::f'").first()["prompt"]
    assert SOURCE in said and "wrong" in said


def test_result_rows_of_a_search(spark):
    scores = spark.createDataFrame([(b,) for b in ("1-A-bug-1-2", "2-A-bug-1-2", "3-A-bug-1-2", "4-A-bug-1-2", "5-A-bug-1-2", "gone", "odd")], "bug_id string")
    known = ["1-A-bug-1-2", "2-A-bug-1-2", "3-A-bug-1-2", "4-A-bug-1-2", "5-A-bug-1-2", "odd"]
    bugs = spark.createDataFrame([(b, "p.c", TESTS) for b in known], f"bug_id string, source_file string, tests array<{sources.TEST}>")
    fixed = SOURCE.replace("7", "8")
    schema = "bug_id string, revlog string, output string, log_path string, original string, repaired string, built boolean"
    searches = [
        ("1-A-bug-1-2", "Positive Cases: Tot 4", "Repair Found", "l", SOURCE, fixed, True), ("2-A-bug-1-2", None, "Repair Found", "l", SOURCE, fixed, False), ("3-A-bug-1-2", None, "Timeout", "l", SOURCE, None, None),
        ("4-A-bug-1-2", None, "Timeout", "l", SOURCE, fixed, True), ("odd", None, "Repair Found", "l", SOURCE, fixed, True),
    ]
    runs = spark.createDataFrame([("1-A-bug-1-2", "t1", True), ("1-A-bug-1-2", "t2", False), ("2-A-bug-1-2", "t1", True)], "bug_id string, test_id string, passed boolean")
    got = {r["bug_id"]: r for r in repair.repaired_by_search(scores, bugs, spark.createDataFrame(searches, schema), runs).collect()}
    assert {b: r["status"] for b, r in got.items()} == {
        "1-A-bug-1-2": "plausible_only", "2-A-bug-1-2": "plausible_only", "3-A-bug-1-2": "timeout", "4-A-bug-1-2": "timeout_repaired", "5-A-bug-1-2": "error", "gone": "skipped", "odd": "error",
    }
    first, second, gone = (got[b] for b in ("1-A-bug-1-2", "2-A-bug-1-2", "gone"))
    assert (first["selected_function"], first["post_passed_tests"], first["post_failed_tests"], first["pos_tests_revlog"]) == ("p.c::g", ["t1"], ["t2"], 4) and "return 8" in first["patched_function"]
    assert (second["post_passed_tests"], second["post_failed_tests"], second["pos_tests_revlog"], second["neg_tests_revlog"]) == ([], [repair.UNBUILT], 1, 1)
    assert (gone["init_passed_tests"], gone["patched_file"], gone["genprog_log"]) == ([], None, None)


def test_changed_functions(spark):
    pairs = [
        ("optional type", "bool solve(int a) { return a < 1; }\nint main() { }", "bool solve(int a) { return a <= 1; }\nint main() { }"), ("none", SOURCE, SOURCE),
        ("new", SOURCE, SOURCE + "int h() { }"), ("main", "int main() { return 0; }", "int main() { return 0; }"), ("word", "int f() { if (1) { } }", "int f() { if (2) { } }"),
    ]
    got = {r["id"]: r["name"] for r in repair.changed_function(spark.createDataFrame(pairs, "id string, original string, repaired string")).collect()}
    assert got == {"optional type": "solve", "none": None, "new": "h", "main": "main", "word": "f"}


def test_evaluation_of_repairs(spark):
    row = lambda bug, status, post, patched, selected="p.c::f": (bug, "e", status, patched, None if patched is None else f"{patched} x", selected, ["t1"], ["t2"], *post)
    rows = [
        row("a", "success", ([], []), "int f(int a) { return a; }"), row("b", "failed", (["t1"], ["t2", None]), "int f(int a) { return 10; }"), row("c", "skipped", ([], []), None),
        row("d", "llm_failed", ([], []), None), row("e", None, ([], []), None), row("f", "failed", ([], ["t2"]), " ", ""),
    ]
    schema = "bug_id string, engine string, status string, patched_function string, patched_file string, selected_function string, " + ", ".join(f"{c} array<string>" for c in repair.RESULT[-4:])
    accepted = spark.createDataFrame([(b, "int f(int a) { return a; }") for b in "abcdef"], "bug_id string, text string")
    each = repair.evaluated(spark.createDataFrame(rows, schema), accepted)
    got = {r["bug_id"]: (r["attempted"], r["label"], r["is_plausible"], r["post"] and tuple(r["post"])[:2], r["func_distance"], r["file_distance"]) for r in each.collect()}
    assert got == {
        "a": (True, "CleanFix", True, (2, 0), 0, 1), "b": (True, "NegFix", False, (1, 2), 2, 3), "c": (False, None, None, None, -1, -1),
        "d": (False, None, None, None, -1, -1), "e": (False, None, None, None, -1, -1), "f": (True, "NoneFix", False, (0, 1), -1, 20),
    }
    summary = repair.evaluation(each, ["engine"]).first().asDict()
    want = {"total": 6, "attempted": 3, "n_llm_failed": 1, "n_skipped": 1, "CleanFix": 1, "NoiseFix": 0, "NoneFix": 1, "NegFix": 1, "plausible": 1, "post_passed": 3, "post_failed": 3, "func_distance_n": 2, "func_distance_median": 2}
    assert {k: summary[k] for k in want} == want


def test_evaluation_counts_what_it_leaves_out(spark):
    rows = [("a", {"f": 1.0, "g": 0.5}, ["f"]), ("b", {"f": 1.0, "g": 1.0}, ["f", "h"]), ("c", {}, ["f"]), ("d", None, ["f"]), ("e", {"f": 1.0}, []), ("f", {"f": 1.0}, None)]
    row = spectrum.evaluation(spark.createDataFrame(rows, "bug_id string, scores map<string,double>, ground_truth array<string>")).first()
    assert (row["total"], row["evaluated"], row["skipped_no_gt"], row["skipped_no_scores"], row["top1"], row["mfr"], row["mar"], row["exam"]) == (6, 2, 2, 2, 1, 1.5, 1.75, 0.75)


def test_test_lists_gather_no_outputs(spark, tmp_path):
    rows = [(2, 1, "F", "1-URGENT"), (1, 1, "F", "5-LOW"), (10, 1, "O", "x"), (9, 1, "O", "x"), (3, 2, "P", "x"), (4, 3, "F", None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = tables.test_lists(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, "9,10", "1,2", False), (2, "", "", False), (3, "", "4", False)]
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Aggregate" in x and ("repeat(" in x or "actual_output" in x) for x in plan)
