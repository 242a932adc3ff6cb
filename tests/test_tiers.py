"""Repair in tiers and replies from a service: equal to all at once, nothing sent or validated in vain, failures kept apart."""

import random
import threading

import pytest
from pyspark.sql import functions as F
from test_debugging import SOURCE, TESTS, repair_inputs

from tracewright.operators import providers, repair, tiers
from tracewright.sources import bugs as sources

FACTS = "bug_id string, method string, ord int, test_id string, passed boolean"
ABC = "".join(f"int f{k}(int a) {{\n  return a + {k} - 1;\n}}\n" for k in range(7))


def many(spark, n=12, seed=3):
    """n bugs with up to 7 functions of falling score, and runs of which few pass whole."""
    rng = random.Random(seed)
    names = {f"b{i}": [f"p.c::f{k}" for k in rng.sample(range(7), rng.randrange(1, 8))] for i in range(n)}
    scores = spark.createDataFrame([(b, m, 1.0 - k / 50 if rng.random() < 0.9 else 0.0) for b, ms in names.items() for k, m in enumerate(ms)], "bug_id string, method string, score double")
    files = spark.createDataFrame([(b, ABC) for b in names], "bug_id string, text string")
    bugs = spark.createDataFrame([(b, TESTS) for b in names], f"bug_id string, tests array<{sources.TEST}>")
    facts = [(b, m, o, t, rng.random() < 0.42) for b, ms in names.items() for m in ms for o in range(1, 6) for t in ("t1", "t2", "t3") if rng.random() < 0.8]
    return scores, files, bugs, spark.createDataFrame(facts, FACTS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_tiers_grow():
    import math

    width = {}
    for order in range(1, 200):
        tier = order if order <= 4 else 5 + math.floor(math.log2(order - 4))
        width[tier] = width.get(tier, 0) + 1
    assert [width[t] for t in range(1, 11)] == [1, 1, 1, 1, 1, 2, 4, 8, 16, 32]


def test_tier_numbers(spark):
    got = [r["t"] for r in spark.range(1, 13).select(tiers.tier_of(F.col("id")).alias("t")).collect()]
    assert got == [1, 2, 3, 4, 5, 6, 6, 7, 7, 7, 7, 8]


def test_mutants_in_tiers_equal_all_at_once(spark, tmp_path, single=2):
    scores, files, bugs, facts = many(spark)
    whole = repair.repaired_by_mutants(scores, files, bugs, repair.recorded(facts))
    seen = []

    def validator(candidates):
        seen.append({(r["bug_id"], r["method_order"]) for r in candidates.collect()})
        return repair.recorded(facts)(candidates)

    make = lambda targeted: repair.mutated(targeted)
    got = tiers.repaired_in_tiers("mutation", scores, files, bugs, make, validator, str(tmp_path / "t"), single)
    assert rows(got.select(*repair.RESULT)) == rows(whole.select(*repair.RESULT))
    solved = {}  # the tier that solves a bug; no later one of it reaches the validator
    order = {(r["bug_id"], r["method"]): r["method_order"] for r in repair.targets(scores, files).collect()}
    tier = lambda k: k if k <= single else single + 1 + (k - single).bit_length() - 1
    for r in got.where("status = 'success'").collect():
        solved[r["bug_id"]] = tier(order[r["bug_id"], r["selected_function"]])
    assert len(seen) > 2 and 0 < len(solved) < 12
    for one in seen:
        assert len({tier(k) for _, k in one}) <= 1
        assert all(tier(k) <= solved.get(b, 99) for b, k in one)
    assert sum(r["n_validated"] for r in got.collect()) == repair.mutated(repair.targets(scores, files)).where(
        " OR ".join(f"(bug_id = '{b}' AND method_order IN ({','.join(str(k) for k in range(1, 13) if tier(k) <= solved.get(b, 99))}))" for b in {r["bug_id"] for r in files.collect()})
    ).count()


def test_a_job_goes_on_behind_its_last_table(spark, tmp_path):
    scores, files, bugs, facts = many(spark, seed=8)
    provider = repair.replay(scores.select("bug_id", "method", F.concat(F.lit("int x = "), F.length("method"), F.lit(";")).alias("reply")))
    calls = []

    def failing(candidates):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return repair.recorded(facts)(candidates)

    run = lambda: tiers.by_replies_in_tiers(scores, files, bugs, provider, failing, str(tmp_path / "t"))
    with pytest.raises(RuntimeError):
        run()
    written = {p: p.stat().st_mtime for p in (tmp_path / "t").glob("*/part-*")}
    got = run()
    assert rows(got.select(*repair.RESULT)) == rows(repair.repaired_by_replies(scores, files, bugs, provider, repair.recorded(facts)).select(*repair.RESULT))
    assert written and all(p.stat().st_mtime == at for p, at in written.items())  # tables that were there were not written again


def test_nothing_to_try(spark, tmp_path):
    scores, files, bugs = repair_inputs(spark)
    none = tiers.by_mutants_in_tiers(scores.where("bug_id = 'z'"), files, bugs, repair.recorded(spark.createDataFrame([], FACTS)), folder=str(tmp_path / "t"))
    assert [(r["bug_id"], r["status"], r["n_validated"]) for r in none.collect()] == [("z", "skipped", 0)]
    empty = tiers.by_mutants_in_tiers(scores.where("false"), files, bugs, repair.recorded(spark.createDataFrame([], FACTS)), folder=str(tmp_path / "e"))
    assert empty.count() == 0


def test_null_and_empty_replies_are_no_candidates(spark):
    scores, files, bugs = repair_inputs(spark)
    replies = spark.createDataFrame([("x", "p.c::f", None), ("x", "p.c::g", ""), ("y", "p.c::f", "int f(int a) { return 0; }"), ("y", "p.c::g", "")], "bug_id string, method string, reply string")
    got = {r["bug_id"]: r for r in repair.repaired_by_replies(scores, files, bugs, repair.replay(replies), repair.recorded(spark.createDataFrame([], FACTS))).collect()}
    assert (got["x"]["status"], got["x"]["patched_file"], got["x"]["selected_function"]) == ("llm_failed", None, "p.c::f")
    assert (got["y"]["status"], got["y"]["patched_function"], got["y"]["selected_function"]) == ("failed", "int f(int a) { return 0; }", "p.c::g")


def log_of(folder):
    return [p.read_text() for p in folder.iterdir()]


def test_a_service_that_fails(spark, tmp_path):
    """Each prompt is sent once over two runs, equal ones together; calls that keep failing give null, others are tried again."""
    log = tmp_path / "log"
    log.mkdir()
    where = str(log)

    def call(prompt):
        import hashlib
        import os
        import uuid

        attempts = len([f for f in os.listdir(where) if f.startswith(hashlib.md5(prompt.encode()).hexdigest())])
        with open(f"{where}/{hashlib.md5(prompt.encode()).hexdigest()}-{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        number = int(prompt.split()[-1])
        if number % 3 == 0 or number % 3 == 1 and attempts == 0:
            raise ConnectionError
        return None if number == 5 else f"reply {number}"

    prompts = [(f"b{k}", "f", f"prompt {k % 30}") for k in range(40)]
    df = spark.createDataFrame(prompts, "bug_id string, method string, prompt string").repartition(4)
    provider = providers.asking(call, str(tmp_path / "kept"), at_once=3, tries=2, wait=0.0)
    want = {(b, m, None if int(p.split()[1]) % 3 == 0 or p == "prompt 5" else f"reply {p.split()[1]}") for b, m, p in prompts}
    assert {(r["bug_id"], r["method"], r["reply"]) for r in provider(df).collect()} == want
    sent = log_of(log)
    assert {p: sent.count(p) for p in set(sent)} == {f"prompt {k}": 1 if k % 3 == 2 else 2 for k in range(30)}
    assert {(r["bug_id"], r["method"], r["reply"]) for r in provider(df).collect()} == want and len(log_of(log)) == len(sent)
    more = df.union(spark.createDataFrame([("new", "f", "prompt 101")], df.schema))
    assert providers.asking(call, str(tmp_path / "kept"), wait=0.0)(more).where("bug_id = 'new'").first()["reply"] == "reply 101"
    assert len(log_of(log)) == len(sent) + 1
    assert providers.asking(call, str(tmp_path / "kept"), tries=1, again=True)(df).count() == 40 and len(log_of(log)) == len(sent) + 1 + 11


def test_requests_under_way_are_bounded(spark, tmp_path):
    where = str(tmp_path)

    def call(prompt):
        import os
        import time

        mine = f"{where}/{os.getpid()}-{threading.get_ident()}.now"
        open(mine, "w").close()
        time.sleep(0.02)
        now = len([f for f in os.listdir(where) if f.endswith(".now")])
        os.remove(mine)
        return str(now)

    df = spark.createDataFrame([("b", "f", f"p {k}") for k in range(60)], "bug_id string, method string, prompt string")
    got = [int(r["reply"]) for r in providers.asking(call, f"{where}/kept", at_once=3, tasks=2)(df).collect()]
    assert len(got) == 60 and 1 < max(got) <= 6


def test_failures_become_llm_failed(spark, tmp_path):
    scores, files, bugs = repair_inputs(spark)

    def call(prompt):
        if " of x." in prompt:
            raise ConnectionError
        return "int f(int a) { return 0; }" if "function f of y" in prompt else ""

    provider = providers.asking(call, str(tmp_path / "kept"), wait=0.0)
    facts = spark.createDataFrame([("y", "p.c::f", 1, "t2", True)], FACTS)
    got = tiers.by_replies_in_tiers(scores, files, bugs, provider, repair.recorded(facts), str(tmp_path / "t"))
    assert {r["bug_id"]: (r["status"], r["n_validated"]) for r in got.collect()} == {"x": ("llm_failed", 0), "y": ("success", 1), "z": ("skipped", 0), "v": ("llm_failed", 0)}
    assert SOURCE in files.first()["text"]
