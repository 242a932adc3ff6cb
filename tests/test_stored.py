"""Bucketed tables: only touched buckets are written, failing and overtaken writers change nothing."""

import pytest
from pyspark.sql import functions as F

from tracewright.sources import buckets
from tracewright.streaming import resume

SCHEMA = "bug_id string, status string, n int"


def contents(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files_of(path):
    return {p: p.stat().st_mtime_ns for p in (path / "data").rglob("part-*")}


def test_an_upsert_writes_the_touched_buckets_only(spark, tmp_path):
    table = str(tmp_path / "t")
    assert buckets.stored(spark, table, SCHEMA).count() == 0
    many = spark.range(20_000).select(F.concat(F.lit("b"), "id").alias("bug_id"), F.lit("failed").alias("status"), F.col("id").cast("int").alias("n"))
    assert len(buckets.upsert(many, table, buckets=64)) == 64
    before, first = files_of(tmp_path / "t"), buckets.manifest(spark, table)
    new = spark.createDataFrame([(f"b{k}", "success", -1) for k in range(9)] + [("new", None, 5)], SCHEMA)
    touched = buckets.upsert(new, table)
    now = buckets.manifest(spark, table)
    assert len(touched) <= 10 and sum(now.folders[b] != first.folders[b] for b in first.folders) == len(touched)
    assert {p: at for p, at in files_of(tmp_path / "t").items() if p in before} == before and not list((tmp_path / "t" / "staging").iterdir())
    want = {f"b{k}": ("failed", k) for k in range(20_000)} | {f"b{k}": ("success", -1) for k in range(9)} | {"new": (None, 5)}
    assert {r["bug_id"]: (r["status"], r["n"]) for r in buckets.stored(spark, table).collect()} == want
    assert buckets.stored(spark, table, version=1).where("status = 'success'").count() == 0  # a reader of the version before
    asked = buckets.stored(spark, table, keys=["b3", "b19999", "none", None])
    assert contents(asked) == [("b19999", "failed", 19999), ("b3", "success", -1)] and len(asked.inputFiles()) <= 3
    assert buckets.vacuum(spark, table, keep=1) == len(touched) and buckets.manifest(spark, table) == now
    assert {r["bug_id"]: (r["status"], r["n"]) for r in buckets.stored(spark, table).collect()} == want


def test_failing_and_overtaken_writers(spark, tmp_path, monkeypatch):
    table, row = str(tmp_path / "t"), lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    buckets.upsert(row(("a", "failed", 1), ("b", "skipped", 2)), table, buckets=4)
    want = [("a", "failed", 1), ("b", "skipped", 2)]
    with pytest.raises(Exception, match="lost"):
        buckets.upsert(row(("a", "x", 0)).withColumn("status", F.raise_error(F.lit("lost")).cast("string")), table)
    assert contents(buckets.stored(spark, table)) == want
    real, stale = buckets.manifest, []

    def late(session, path, version=None):  # another writer commits after this one has looked
        found = real(session, path, version)
        if not stale:
            stale.append(found)
            buckets.upsert(row(("a", "success", 9), ("c", "failed", 3)), path)
        return found

    monkeypatch.setattr(buckets, "manifest", late)
    with pytest.raises(buckets.Conflict):
        buckets.upsert(row(("a", "llm_failed", 4)), table, tries=1)
    assert contents(buckets.stored(spark, table)) == [("a", "success", 9), ("b", "skipped", 2), ("c", "failed", 3)]
    stale.clear()
    buckets.upsert(row(("d", "failed", 4), ("c", "skipped", 7)), table, tries=2)  # merges again, over the other's rows
    assert contents(buckets.stored(spark, table)) == [("a", "success", 9), ("b", "skipped", 2), ("c", "skipped", 7), ("d", "failed", 4)]
    with pytest.raises(buckets.Conflict):
        buckets.commit(spark, table, stale[0])
    assert real(spark, table).version == 4


def test_columns_and_rows_without_a_key(spark, tmp_path):
    table = str(tmp_path / "t")
    buckets.upsert(spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "bug_id string, n int"), table, buckets=8)
    buckets.upsert(spark.createDataFrame([("b", "x"), ("a", "y"), (None, "z")], "bug_id string, status string"), table)
    assert contents(buckets.stored(spark, table).select("bug_id", "n", "status")) == sorted([("a", None, "y"), ("b", None, "x"), (None, 2, None), (None, 3, None), (None, None, "z")], key=repr)
    assert buckets.upsert(spark.createDataFrame([], "bug_id string, n int"), table) == [] and buckets.stored(spark, table).count() == 5
    many = spark.range(1000).select(F.lit(None).cast("string").alias("bug_id"), F.col("id").cast("int").alias("n"))
    assert len(buckets.upsert(many, table)) == 8  # spread, though they share the null key


def test_arriving_files_reach_a_bucketed_table(spark, tmp_path):
    arriving, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    for rows in ([("a", "failed", 1), ("b", "skipped", 2)], [("c", "failed", 5), ("b", "success", 4), ("c", "skipped", 3)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(arriving)
        resume.upsert_stream(spark, arriving, SCHEMA, table, checkpoint, "n", buckets.upsert).awaitTermination()
    assert contents(buckets.stored(spark, table)) == [("a", "failed", 1), ("b", "success", 4), ("c", "failed", 5)]
