"""Result tables in hash buckets under a manifest: an upsert rewrites only the buckets that its rows fall into.

    table/manifest/00000000000000000007.json   version 7: the folder of each bucket, the schema
    table/data/<write>/bucket=12/              the rows of a bucket as one write left them
    table/staging/<write>/                     new rows of a write that is under way

A write makes new folders and then the next manifest, whose name it may only create, not replace: of two writers from one version the second
fails with Conflict, or merges again over the first one's rows. Readers use the manifest they started with; vacuum() removes
what only older ones name. A store must refuse to rename over a file that is there.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.results import upserted
from .stages import file_system

BUCKETS = 256


class Conflict(Exception):
    """Another writer has made the version that this one was to make."""


@dataclass
class Manifest:
    version: int = 0
    buckets: int = BUCKETS
    schema: dict | None = None
    folders: dict[str, str] = field(default_factory=dict)  # bucket -> folder under the table


def bucket_of(key: str, buckets: int, columns: list[str]) -> Column:
    """A row's bucket by its key; rows without one, which nothing ever replaces, are spread by their other columns."""
    return F.pmod(F.when(F.col(key).isNull(), F.hash(*(F.to_json(F.struct(c)) for c in columns))).otherwise(F.hash(key)), F.lit(buckets))


def _versions(spark: SparkSession, table: str) -> list[int]:
    files, where = file_system(spark, f"{table}/manifest")
    if not files.exists(where):
        return []
    names = (entry.getPath().getName() for entry in files.listStatus(where))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())


def _name(table: str, version: int) -> str:
    return f"{table}/manifest/{version:020d}.json"


def manifest(spark: SparkSession, table: str, version: int | None = None) -> Manifest:
    """The current manifest, or an older one that is still there; version 0 of a table that was never written."""
    versions = _versions(spark, table)
    if not versions:
        return Manifest()
    files, where = file_system(spark, _name(table, versions[-1] if version is None else version))
    stream = files.open(where)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(**json.loads(text))


def commit(spark: SparkSession, table: str, made: Manifest) -> None:
    """Makes made the table's current manifest, or raises Conflict if there is one of its version."""
    jvm = spark.sparkContext._jvm
    files, draft = file_system(spark, f"{table}/manifest/draft-{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(made.__dict__).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(_name(table, made.version)), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        files.delete(draft, False)
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        raise Conflict(f"{table}: version {made.version} is there already") from None


def _read(spark: SparkSession, table: str, now: Manifest, buckets: list[str] | None = None) -> DataFrame | None:
    folders = [f for b, f in now.folders.items() if buckets is None or b in buckets]
    if not folders:
        return None
    return spark.read.schema(StructType.fromJson(now.schema)).parquet(*(f"{table}/{f}" for f in sorted(folders)))


def stored(spark: SparkSession, table: str, schema: str | None = None, keys: list | None = None, key: str = "bug_id", version: int | None = None) -> DataFrame:
    """The rows of a table; with keys only those of these keys, read from their buckets alone. No rows before the first write: schema names the columns then."""
    now = manifest(spark, table, version)
    fields = schema if schema else StructType.fromJson(now.schema) if now.schema else f"{key} string"
    wanted = None
    if keys is not None and now.schema:
        kind = StructType.fromJson(now.schema)[key].dataType
        asked = spark.createDataFrame([(k,) for k in keys if k is not None], StructType().add(key, kind))
        wanted = [str(r["b"]) for r in asked.select(bucket_of(key, now.buckets, [key]).alias("b")).distinct().collect()]  # at most as many as buckets
    rows = _read(spark, table, now, wanted)
    if rows is None:
        return spark.createDataFrame([], fields)
    return rows if keys is None else rows.where(F.col(key).isin([k for k in keys if k is not None]))


def upsert(new: DataFrame, table: str, buckets: int = BUCKETS, key: str = "bug_id", tries: int = 3) -> list[int]:
    """new over the rows stored under table, by key; returns the buckets that were written.

    Rows of new are taken as they are, so a key that occurs twice is stored twice; rows without a key are added and never replaced. Columns
    that either side lacks are null there. buckets counts when the table is made. After tries lost races with other writers Conflict is raised.
    """
    spark = new.sparkSession
    for _ in range(tries):
        now = manifest(spark, table)
        write, count = uuid.uuid4().hex, now.buckets if now.version else buckets
        fresh = new.withColumn("_bucket", bucket_of(key, count, [c for c in new.columns if c != key] or [key]))
        fresh.write.parquet(f"{table}/staging/{write}")
        fresh = spark.read.parquet(f"{table}/staging/{write}")
        touched = sorted(r["_bucket"] for r in fresh.select("_bucket").distinct().collect())
        old = _read(spark, table, now, [str(b) for b in touched])
        merged = fresh.drop("_bucket") if old is None else upserted(old, fresh.drop("_bucket"))
        schema = merged.schema
        if old is None and now.schema:  # columns of buckets that are not touched
            schema = spark.createDataFrame([], StructType.fromJson(now.schema)).unionByName(merged.limit(0), allowMissingColumns=True).schema
        others = [c for c in new.columns if c != key] or [key]
        placed = merged.withColumn("bucket", bucket_of(key, count, others))
        placed.repartition(max(1, min(len(touched), int(spark.conf.get("spark.sql.shuffle.partitions")))), "bucket").write.partitionBy("bucket").parquet(f"{table}/data/{write}")
        folders = now.folders | {str(b): f"data/{write}/bucket={b}" for b in touched}
        files, staging = file_system(spark, f"{table}/staging/{write}")
        files.delete(staging, True)
        try:
            commit(spark, table, Manifest(now.version + 1, count, schema.jsonValue(), folders))
            return touched
        except Conflict:
            files.delete(file_system(spark, f"{table}/data/{write}")[1], True)
    raise Conflict(f"{table}: {tries} writes were overtaken")


def vacuum(spark: SparkSession, table: str, keep: int = 2) -> int:
    """Removes all but the last keep manifests, and folders that none of them names; returns how many folders went. Not while a write or an older reader runs."""
    versions = _versions(spark, table)
    named = {f for v in versions[-keep:] for f in manifest(spark, table, v).folders.values()}
    files, data = file_system(spark, f"{table}/data")
    gone = 0
    if files.exists(data):
        for write in files.listStatus(data):
            folders = [e.getPath() for e in files.listStatus(write.getPath()) if e.getPath().getName().startswith("bucket=")]
            unused = [p for p in folders if f"data/{write.getPath().getName()}/{p.getName()}" not in named]
            for path in [write.getPath()] if len(unused) == len(folders) else unused:
                files.delete(path, True)
            gone += len(unused)
    for v in versions[:-keep]:
        files.delete(file_system(spark, _name(table, v))[1], False)
    return gone
