"""Replies from a service: each task asks for its own prompts, some at once, and every prompt's reply is kept by the prompt's digest."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import file_system
from .repair import PROVIDERS, Provider

KEPT = "digest string, reply string"


def asking(call: Callable[[str], str | None], kept: str, at_once: int = 8, tries: int = 3, wait: float = 0.5, tasks: int | None = None, again: bool = False) -> Provider:
    """A provider that sends prompts to call.

    Of equal prompts one is sent, and none that the folder kept already has a reply for, whatever that was; again sends those without a
    reply once more. A task has at_once requests under way and holds as many replies. A call that raises is tried tries times in
    all, after waits that double; then the reply is null. tasks bounds the tasks, and so with at_once all requests under way; where it is not
    given it is the session's shuffle partitions. A lost task asks its prompts again: replies are kept when the whole batch is done.
    """

    def ask(prompt: str) -> str | None:
        for k in range(tries):
            try:
                return call(prompt)
            except Exception:  # whatever the service's client raises
                if k + 1 < tries:
                    time.sleep(wait * 2**k)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for start in range(0, batch.num_rows, at_once):
                    part = batch.slice(start, at_once)
                    replies = list(pool.map(ask, part.column(1).to_pylist()))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(replies, pa.string())], names=["digest", "reply"])

    def provide(prompts: DataFrame) -> DataFrame:
        spark = prompts.sparkSession
        marked = prompts.withColumn("digest", F.sha2("prompt", 256))
        files, where = file_system(spark, kept)
        before = spark.read.schema(KEPT).parquet(f"{kept}/*") if files.exists(where) and len(files.listStatus(where)) else spark.createDataFrame([], KEPT)
        known = before.where("reply IS NOT NULL") if again else before
        wanted = marked.select("digest", "prompt").dropDuplicates(["digest"]).join(known.select("digest"), "digest", "left_anti")
        n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
        wanted.repartition(n, "digest").mapInArrow(run, KEPT).write.parquet(f"{kept}/{uuid.uuid4().hex}")
        replies = spark.read.schema(KEPT).parquet(f"{kept}/*").groupBy("digest").agg(F.max("reply").alias("reply"))
        return marked.join(replies, "digest").drop("digest")

    return provide


PROVIDERS["asking"] = asking
