"""A JSON object read by many tasks equals the same parsed whole, wherever its bytes are cut; exports are one JSON object."""

import json
import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.functions import jsonbytes as jb
from tracewright.sources import bugs, keyed, stages

rng = random.Random(9)
TRICKY = ['", {', "\\", '\\"', "}],", "a,b", "é日😀", "", "\n,\t", '"', "{[", "\\\\,", ": {"]


def random_object(n, indent):
    key = lambda: "".join(rng.choice([*TRICKY, "k", "m"]) for _ in range(rng.randrange(4)))
    out = {f"{key()}{k}": {"scores": {f"{key()}{i}": rng.randrange(9) / 8 for i in range(rng.randrange(5))}, "ground_truth": [key() for _ in range(rng.randrange(3))]} for k in range(n)}
    return out, json.dumps(out, indent=indent, ensure_ascii=rng.random() < 0.5)


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


VALUE = "struct<scores:map<string,double>,ground_truth:array<string>>"


def found(df):
    return {r["bug_id"]: (r["value"]["scores"], r["value"]["ground_truth"]) for r in df.collect()}


def test_objects_cut_anywhere(spark, tmp_path, small_ranges):
    want = {}
    for k, indent in enumerate((None, 4)):
        (tmp_path / str(k)).mkdir()
        want[k], text = random_object(60, indent)
        (tmp_path / str(k) / "o.json").write_text(text)
        path = str(tmp_path / str(k) / "o.json")
        got = keyed.entries(spark, path, VALUE)
        assert spark.read.text(path, lineSep=",").rdd.getNumPartitions() > 4
        assert found(got) == {b: (v["scores"], v["ground_truth"]) for b, v in want[k].items()}
        whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{VALUE}>")).alias("bug_id", "value"))
        assert found(whole) == found(got)


def test_unsound_objects_have_no_rows(spark, tmp_path, small_ranges):
    good = {f"b{k}": {"scores": {"f": k / 8}, "ground_truth": ["x"]} for k in range(30)}
    text = json.dumps(good)
    broken = {
        "cut": text[:-40], "unclosed": text[:-1], "twice": text + text, "behind": text + " x", "before": "x " + text, "list": f"[{text}]", "quote": text.replace('"b7"', '"b7', 1),
        "bracket": text.replace('["x"]', '["x"', 1), "value": text.replace("0.125", "zero", 1), "comma": text[:-1] + ",}", "member": text[:-1] + ', "z"}', "empty file": "", "blank": "  ",
    }
    for name, bad in broken.items():
        (tmp_path / f"{name}.json").write_text(bad)
    (tmp_path / "good.json").write_text(f"\n {text} \n")
    (tmp_path / "none.json").write_text(" { } ")
    assert found(keyed.entries(spark, str(tmp_path), VALUE)) == {b: (v["scores"], v["ground_truth"]) for b, v in good.items()}
    assert keyed.entries(spark, str(tmp_path / "gone"), VALUE).count() == 0
    results = keyed.entries(spark, str(tmp_path / "good.json"), bugs.RESULT)
    assert results.count() == 30


def test_an_export_is_one_object(spark, tmp_path, small_ranges):
    rows = [(f"{rng.choice(TRICKY)}{k}", rng.choice([None, "failed", *TRICKY]), [rng.choice(TRICKY)] * (k % 3)) for k in range(50)]
    df = spark.createDataFrame([*rows, (None, "lost", [])], "bug_id string, status string, tests array<string>").repartition(5)
    keyed.write_object(df, str(tmp_path / "o"))
    parts = sorted((tmp_path / "o").glob("part-*"))
    whole = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 1 and whole == {b: {"status": s, "tests": t} for b, s, t in rows}
    assert max(line.count('"status"') for p in parts for line in p.read_text().splitlines()) == 1
    back = keyed.entries(spark, str(tmp_path / "o"), "struct<status:string,tests:array<string>>", together=True)
    assert {(r["bug_id"], r["value"]["status"], tuple(r["value"]["tests"])) for r in back.collect()} == {(b, s, tuple(t)) for b, s, t in rows}
    keyed.write_object(df.where("false"), str(tmp_path / "e"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "e").glob("part-*")))) == {}
    assert keyed.entries(spark, str(tmp_path / "e"), "string", together=True).count() == 0


def shuffled(spark):
    """Bytes that the session's stages have written for shuffles."""
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    found = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(found.apply(k).shuffleWriteBytes() for k in range(found.size()))


def test_reading_writes_no_copy_of_the_object(spark, tmp_path):
    text = json.dumps({f"b{k}": {"text": ",".join(f"{rng.getrandbits(64):x}" for _ in range(60))} for k in range(4000)})
    (tmp_path / "o.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        folder = Path(stages.shared_folder(spark).removeprefix("file://"))
        before, moved = set(folder.rglob("*")), shuffled(spark)
        got = keyed.entries(spark, str(tmp_path / "o.json"), "struct<text:string>").agg(F.count("*"), F.sum(F.length("value.text"))).head()
        written = sum(p.stat().st_size for p in set(folder.rglob("*")) - before if p.is_file())
        assert tuple(got) == (4000, sum(len(v["text"]) for v in json.loads(text).values()))
        assert written + shuffled(spark) - moved < len(text) / 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_nothing_is_read_of_two_objects_in_one_file(spark, tmp_path):
    one, other = '{"a": {"scores": {"f": 0.5}, "ground_truth": []}, "b": {"scores": {}, "ground_truth": []}}', '{"c": {"scores": {}, "ground_truth": []}, "d": {"scores": {}, "ground_truth": []}}'
    (tmp_path / "two.json").write_text(one + other)
    (tmp_path / "string.json").write_text(one[:-1] + '} "x", {}')
    (tmp_path / "good.json").write_text(one)
    assert sorted(r["bug_id"] for r in keyed.entries(spark, str(tmp_path), VALUE).collect()) == ["a", "b"]


def batches_of(data, width, rows):
    """Pieces of data in ranges of width bytes, as Spark's text reader cuts them, in batches of few rows."""
    pieces, at = [], 0
    for piece in data.split(b","):
        pieces.append((max(0, -(-at // width) - 1) * width, piece))  # one that begins with a range is the last of the range before
        at += len(piece) + 1
    for k in range(0, len(pieces), rows):
        starts, texts = zip(*pieces[k : k + rows], strict=True)
        columns = {"part": pa.array([3] * len(starts), pa.int32()), "file": pa.array(["f"] * len(starts)), "start": pa.array(starts, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string())}
        yield pa.RecordBatch.from_pydict(columns)


@pytest.mark.parametrize("size", [40, 1 << 22])
def test_ranges_put_together_are_the_object(monkeypatch, size):
    monkeypatch.setattr(jb, "SLICE", size)
    for _ in range(100):
        want, text = random_object(rng.randrange(1, 40), rng.choice([None, 1]))
        data, width, rows = text.encode(), rng.choice([7, 60, 700, 10**6]), rng.choice([1, 3, 1000])
        ranges = [r for b in jb.effects(batches_of(data, width, rows)) for r in b.to_pylist()]
        flipped = level = 0
        for r in ranges:
            r |= {"flipped": flipped, "level": level, "final": r is ranges[-1], "first": r is ranges[0], "last": r is ranges[-1], "leads": r is ranges[0], "wanted": True}
            level, flipped = level + r["quoted" if flipped else "plain"], (flipped + r["quotes"]) % 2
        assert (level, flipped) == (0, 0)
        states = jb.States(pa.Table.from_pylist(ranges).select(jb.States.COLUMNS))
        found = [r for b in jb.members(batches_of(data, width, rows), states) for r in b.to_pylist()]
        assert jb.STRAY not in {r["kind"] for r in found}
        members = [r for r in found if r["kind"] == jb.WHOLE]
        for r in (r for r in found if r["kind"] != jb.WHOLE):  # in order
            if r["kind"] == jb.OPENS or r["first"]:
                parts = r
                members.append(parts)
            else:
                parts["text"] += r["text"]
                parts["last"] |= r["last"]
        bare = [(m["text"].rstrip().removesuffix("}") if m["last"] else m["text"]).removeprefix("{" if m["first"] else "") for m in members if m["text"]]
        got = [json.loads("{" + t + "}") for t in bare]
        assert {k: v for m in got for k, v in m.items()} == want and len(got) == len(want)


def test_an_export_is_sorted_in_more_tasks_where_it_is_large(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "TASK", 400)
    df = spark.createDataFrame([(f"b{k:03}", "x" * 50) for k in range(100)], "bug_id string, text string").repartition(3)
    keyed.write_object(df, str(tmp_path / "o"))
    parts = [p.read_text() for p in sorted((tmp_path / "o").glob("part-*"))]
    assert len(parts) > 8 and list(json.loads("".join(parts))) == [f"b{k:03}" for k in range(100)]
