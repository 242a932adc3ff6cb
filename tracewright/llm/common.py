"""What the operators of this subpackage share: table access and tables written between steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir; a temporary one where that is unset and all runs in this process."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tracewright-")
    return _own_dirs[app]


class Scratch:
    """Tables written to the shared folder to cut lineage and to compute costly steps once.

    A lost executor only costs the tasks it was running: everything before a
    written table is read back instead of recomputed. ``drop`` removes a table
    as soon as nothing reads it any more; what results still read stays until
    the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/tracewright-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.path(name))

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # at exit the JVM may be gone; the folder is then the cluster's to clear
            pass


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id falls in no fold (-1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds, F.lit(-1))


def bounded_sample(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """At most most rows, chosen by a hash of key: a share that gives about as many, then the cut.

    The share is applied where the rows are read, so the sort that makes the cut gets about
    most rows in all, not that many from each partition.
    """
    total = max(1, rows.count())
    scale = 2**31
    share = min(scale, -(-most * scale // total))
    order = F.xxhash64(F.col(key), F.lit(seed))
    return rows.where(F.pmod(order, F.lit(scale)) < share).orderBy(order, key).limit(most)
