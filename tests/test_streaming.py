"""New result files reach the stored table once, whatever the number of runs."""

from tracewright.sources.bugs import stored
from tracewright.streaming import resume

SCHEMA = "bug_id string, status string, at long"


def test_arriving_files_are_folded_in_once(spark, tmp_path):
    arriving, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    states = []
    for rows in ([("a", "failed", 1), ("b", "skipped", 2)], [("c", "failed", 5), ("b", "success", 4), ("c", "skipped", 3)], []):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(arriving)
        resume.upsert_stream(spark, arriving, SCHEMA, table, checkpoint, "at").awaitTermination()
        states.append(sorted((r["bug_id"], r["status"]) for r in stored(spark, table, SCHEMA).collect()))
    assert states[0] == [("a", "failed"), ("b", "skipped")]
    assert states[1] == states[2] == [("a", "failed"), ("b", "success"), ("c", "failed")]
