"""Resumable results as a stream: new result files are folded into the stored table, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.bugs import write_upserted


def upsert_stream(
    spark: SparkSession, arriving: str, schema: str, table: str, checkpoint: str, order: str, write: Callable[[DataFrame, str], object] = write_upserted
) -> StreamingQuery:
    """Reads parquet files as they arrive and upserts them by bug_id; of a bug's rows in a batch the one with the largest order counts.

    write is write_upserted for tables that are rewritten whole, buckets.upsert for bucketed ones; a batch that is repeated after a failure changes nothing.
    """

    def fold(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("bug_id").agg(F.max_by(F.struct(*batch.columns), order).alias("row"))
        write(last.select("row.*"), table)

    read = spark.readStream.schema(schema).parquet(arriving)
    return read.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
