"""Tables written between the steps of one job, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder, if all runs on this machine."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="tracewright-"))


def file_system(spark: SparkSession, path: str):
    """The JVM's file system of a path, and the path as it knows it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


class Stages:
    """Named parquet tables under one folder. A table counts once its write is done, so a job that is started again goes on behind it."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
        if folder is None:
            atexit.register(self.remove)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def done(self, name: str) -> bool:
        files, path = file_system(self.spark, self.path(f"{name}/_SUCCESS"))
        return files.exists(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table, written unless that was done before."""
        if not self.done(name):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def remove(self) -> None:
        try:
            files, path = file_system(self.spark, self.folder)
            files.delete(path, True)
        except Exception:  # at exit the JVM may be gone; the folder is then the cluster's to clear
            pass
