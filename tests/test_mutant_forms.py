"""Changes have one normal form exactly if they give one text."""

import random
import re
import time

from pyspark.sql import functions as F
from test_debugging import mutant_oracle

from tracewright.operators import mutants

rng = random.Random(5)


def test_normal_forms_agree_exactly_if_texts_do(spark):
    texts = ["".join(rng.choice("ab+1 ") for _ in range(rng.randrange(14))) for _ in range(60)] + ["+1" * 600, " " * 3000, "aé" * 40, "日+1" * 30]
    rows = []
    for k, text in enumerate(texts):
        for _ in range(40):
            start = rng.randrange(len(text) + 1)
            hit = text[start : start + rng.randrange(6)]
            rows.append((k, text, start, len(hit), hit, rng.choice(["", " ", "+1", "1+", hit[::-1], hit + hit, hit[1:], "é", "ab", " - "])))
    df = spark.createDataFrame(rows, "k int, text string, start int, size int, hit string, put string")
    got = df.select("k", "text", "start", "hit", "put", mutants._normal(F.col("text"), F.struct("start", "size", "hit", "put")).alias("n")).collect()
    forms, results = {}, {}
    for r in got:
        made = r["text"][: r["start"]] + r["put"] + r["text"][r["start"] + len(r["hit"]) :]
        form = tuple(r["n"])
        assert forms.setdefault((r["k"], made), form) == form
        assert results.setdefault((r["k"], form), made) == made
    assert len(forms) < len(got)


def test_runs_of_equal_operations(spark):
    codes = ["a" + "+1" * 50, "a" + " + 1" * 40, "x-1-1-1", "a+1+ 1+1 +1", "a<b<c", "a  <=  b", "i<n+1+1>=2"]
    got = {k: [] for k in range(len(codes))}
    for r in mutants.mutants(spark.createDataFrame(list(enumerate(codes)), "id int, code string")).orderBy("id", "mutant_ordinal").collect():
        got[r["id"]].append(r["code"])
    assert got == {k: mutant_oracle(c) for k, c in enumerate(codes)}


def test_pages_against_python(spark):
    from collections import Counter

    from tracewright.plans import tables

    where = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{where}/pages.parquet").select("page_id", "html").collect()
    got = {(r["page_id"], r["description"]): (r["n"], r["first_ordinal"]) for r in tables.code_mutants(spark, where).collect()}
    want = {}
    for r in pages:
        said = [d for _, d in described_oracle(r["html"] or "")]
        count = Counter(said)
        want |= {(r["page_id"], d): (n, said.index(d) + 1) for d, n in count.items()}
    assert got == want and len(want) > 10


def described_oracle(code):
    out = {}
    for pattern, replacements in mutants.RULES:
        for m in re.finditer(pattern, code):
            for r in replacements:
                text = code[: m.start()] + r + code[m.end() :]
                if m[0].strip() != r.strip() and text not in out:
                    out[text] = mutants.DESCRIPTION % (m[0].strip(), r.strip())
    return list(out.items())


def test_a_large_function_takes_seconds(spark):
    line = "x" * 320 + " = a + 1 - b;\n"
    code = "".join(f"{k}{line}" for k in range(3000))
    df = spark.createDataFrame([(1, code)], "id int, code string").cache()
    df.count()
    began = time.time()
    count = mutants.mutants(df).select("mutant_ordinal", "description").groupBy("description").count().orderBy("description").collect()
    took = time.time() - began  # "- 1" for "+ 1" gives the text that "-" for "+" has given
    assert len(code) > 1_000_000 and sum(r["count"] for r in count) == 3000 * 3 and took < 60, (took, count)
