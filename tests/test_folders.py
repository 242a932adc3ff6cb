"""Bug files as a data source: files are chosen before any is opened, tasks share them, streams take new ones once."""

import json
import time

import pytest

from tracewright.sources import bugs, folders

TEST = {"test_id": "t", "outcome": "FAIL", "covered_methods": ["f"]}


def write(folder, name, truth="f"):
    (folder / f"{name}.json").write_text(json.dumps({"tests": [TEST], "ground_truth_functions": [truth]}))


def test_a_lookup_opens_one_file(spark, tmp_path):
    for k in range(20):
        write(tmp_path, f"{k}-A-bug-1-2")
    for k in range(200):
        (tmp_path / f"bad{k}.json").write_bytes(b"\xff\xfe{")  # opening any of these fails
    (tmp_path / "note.txt").write_text("x")
    files = folders.bug_files(spark, str(tmp_path), files="16")
    with pytest.raises(Exception, match="decode|codec"):
        files.collect()
    one = files.where("bug_id = '7-A-bug-1-2'")
    assert [r["bug_id"] for r in one.collect()] == ["7-A-bug-1-2"] and one.rdd.getNumPartitions() == 1
    some = files.where("bug_id IN ('3-A-bug-1-2', '4-A-bug-1-2', 'gone') AND length(text) > 3")
    assert {r["bug_id"] for r in some.collect()} == {"3-A-bug-1-2", "4-A-bug-1-2"}
    assert files.where("bug_id = 'gone' OR bug_id IS NULL").where("bug_id = '../x'").count() == 0
    assert files.rdd.getNumPartitions() == 14  # 220 files, 16 a task


def test_records_equal_those_of_the_plain_reader(spark, tmp_path):
    for k in range(5):
        write(tmp_path, f"{k}-A-bug-1-2", "/x.c::g" if k % 2 else "f")
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "none.json").write_text("{}")
    want = bugs.bugs(spark, str(tmp_path), "/src")
    got = bugs.loader(" Codeflaws_Files ")(spark, str(tmp_path), source_dir="/src")
    assert got.columns == want.columns
    usable = {r["bug_id"]: r for r in want.where("size(tests) > 0 OR bug_id = 'none'").collect()}
    assert {r["bug_id"]: r for r in got.where("size(tests) > 0 OR bug_id = 'none'").collect()} == usable and len(usable) == 6
    assert got.where("bug_id = '2-A-bug-1-2'").first()["ground_truth"] == ["/src/2-A-bug-1-2/2-A-1.c::f"]
    assert folders.bug_files(spark, str(tmp_path / "gone")).count() == 0
    with pytest.raises(ValueError, match="unknown dataset"):
        bugs.loader("other")


def test_new_files_are_streamed_once(spark, tmp_path):
    arriving, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    arriving.mkdir()
    folders.register(spark)
    seen = []
    for names in (["1-A-bug-1-2", "2-A-bug-1-2"], ["3-A-bug-1-2"], []):
        for name in names:
            write(arriving, name)
        time.sleep(0.2)
        stream = spark.readStream.format("bug_files").option("settle", "0.1").load(str(arriving))
        folders.records(stream).select("bug_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted(r["bug_id"] for r in spark.read.schema("bug_id string").parquet(out).collect()))
    assert seen == [["1-A-bug-1-2", "2-A-bug-1-2"], ["1-A-bug-1-2", "2-A-bug-1-2", "3-A-bug-1-2"], ["1-A-bug-1-2", "2-A-bug-1-2", "3-A-bug-1-2"]]
