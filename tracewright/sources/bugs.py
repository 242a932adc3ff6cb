"""Readers and writers of bug records, recorded scores, results and test-case files. A missing file or folder has no rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names

TEST = "struct<test_id:string,outcome:string,covered_methods:array<string>,expected_output:string,actual_output:string,fail_reason:string>"
BUG_FILE = f"tests array<{TEST}>, ground_truth_functions array<string>, compile_cmd string, test_cmd_template string, _corrupt string"
META_FILE = f"bug_id string, dataset_name string, language string, source_file string, compile_cmd string, test_cmd_template string, tests array<{TEST}>, _corrupt string"
SCORES = "struct<scores:map<string,double>,ground_truth:array<string>>"
FLAT_SCORES = "map<string,double>"
RESULT = (
    "struct<status:string,patched_function:string,patched_file:string,selected_function:string,init_passed_tests:array<string>,init_failed_tests:array<string>,"
    "post_passed_tests:array<string>,post_failed_tests:array<string>,patch_file:string,mutation_strategy:string,elapsed_seconds:double,genprog_log:string,"
    "pos_tests_revlog:int,neg_tests_revlog:int>"
)


def _present(spark: SparkSession, read: Callable[[], DataFrame], schema: str) -> DataFrame:
    """What read gives; no rows of schema where its path is missing."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _documents(spark: SparkSession, where: str, schema: str) -> DataFrame:
    read = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").option("columnNameOfCorruptRecord", "_corrupt")
    rows = _present(spark, lambda: read.json(where).withColumn("file", F.col("_metadata.file_name")), f"{schema}, file string")
    return rows.where("_corrupt IS NULL").drop("_corrupt")


def _whole(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    read = lambda: spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return _present(spark, read, "value string, path string")


def bugs(spark: SparkSession, where: str, source_dir: str = "", dataset: str = "codeflaws") -> DataFrame:
    """One row per readable {bug_id}.json in a folder: bug_id, dataset, tests, ground_truth, source_file, compile_cmd, test_cmd_template.

    Unreadable files are left out; names of methods are qualified by the bug's source file.
    """
    rows = _documents(spark, where, BUG_FILE).withColumn("bug_id", F.replace("file", F.lit(".json"), F.lit("")))
    return described(rows, source_dir, dataset)


def described(rows: DataFrame, source_dir: str, dataset: str) -> DataFrame:
    """bugs() of rows(bug_id and the fields of BUG_FILE)."""
    file = names.source_path(F.lit(source_dir), F.col("bug_id"))
    none, no_names = F.array().cast(f"array<{TEST}>"), F.array().cast("array<string>")
    return rows.select(
        "bug_id",
        F.lit(dataset).alias("dataset"),
        names.qualify_tests(F.coalesce("tests", none), file).alias("tests"),
        names.qualify_all(F.coalesce("ground_truth_functions", no_names), file).alias("ground_truth"),
        file.alias("source_file"),
        "compile_cmd",
        "test_cmd_template",
    )


def bug(spark: SparkSession, where: str, bug_id: str, **options) -> DataFrame:
    """One bug's row, from its own file only; no row if it is missing."""
    return bugs(spark, f"{where}/{bug_id}.json", **options)


def metadata(spark: SparkSession, where: str) -> DataFrame:
    """The documented per-bug metadata files, as they are."""
    return _documents(spark, where, META_FILE)


LOADERS: dict[str, Callable[..., DataFrame]] = {"codeflaws": bugs}


def loader(name: str) -> Callable[..., DataFrame]:
    from . import folders  # noqa: F401  # adds the loader by data source

    key = name.strip().lower()
    if key not in LOADERS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[key]


def recorded_scores(spark: SparkSession, path: str) -> DataFrame:
    """bug_id, scores, ground_truth of one JSON object keyed by bug id, read by byte ranges; the flat shape {bug: {method: score}} is read too."""
    from .keyed import entries

    nested, flat = F.from_json("value", SCORES), F.from_json("value", FLAT_SCORES)
    rows = entries(spark, path, "string").select("bug_id", nested.alias("v"), flat.alias("flat"))
    return rows.select("bug_id", F.coalesce("v.scores", "flat").alias("scores"), F.coalesce("v.ground_truth", F.array().cast("array<string>")).alias("ground_truth"))


def recorded_results(spark: SparkSession, path: str) -> DataFrame:
    """bug_id and the fields of a result of one JSON object keyed by bug id, read by byte ranges."""
    from .keyed import entries

    return entries(spark, path, RESULT).select("bug_id", "value.*")


def scores_document(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """One row, one JSON object keyed by bug id: an export for small results; keyed.write_object() cuts large ones over files."""
    found = scores.groupBy("bug_id").agg(F.map_from_entries(F.collect_list(F.struct("method", "score"))).alias("scores"))
    wanted = truth.groupBy("bug_id").agg(F.collect_list("method").alias("ground_truth"))
    each = found.join(wanted, "bug_id", "left").withColumn("ground_truth", F.coalesce("ground_truth", F.array().cast("array<string>")))
    entry = F.map_from_entries(F.collect_list(F.struct("bug_id", F.struct("scores", "ground_truth"))))
    return each.agg(F.to_json(entry, {"ignoreNullFields": "false"}).alias("value"))


def case_id(file_name: Column, side: str) -> Column:
    return F.regexp_extract(file_name, rf"^{side}-((?:heldout-)?(?:pos|neg).*)$", 1)


def cases(spark: SparkSession, folders: str | list[str]) -> DataFrame:
    """bug_id, test_id, input_path, output_path and place of the input files in bugs' folders that have an output file.

    A bug's id is its folder's name. place numbers a bug's cases from 1: groups in the order pos, neg, heldout-pos, heldout-neg, each by file name.
    """
    read = lambda: spark.read.format("binaryFile").load(folders).select("path")
    parts = F.split("path", "/")
    files = _present(spark, read, "path string").select("path", F.element_at(parts, -1).alias("name"), F.get(parts, F.size(parts) - 2).alias("bug_id"))
    inputs = files.select("bug_id", case_id(F.col("name"), "input").alias("test_id"), F.col("path").alias("input_path"), "name").where("test_id <> ''")
    outputs = files.select("bug_id", case_id(F.col("name"), "output").alias("test_id"), F.col("path").alias("output_path")).where("test_id <> ''")
    group = F.when(F.startswith("test_id", F.lit("heldout-pos")), 2).when(F.startswith("test_id", F.lit("heldout-neg")), 3).when(F.startswith("test_id", F.lit("neg")), 1).otherwise(0)
    place = F.row_number().over(W.partitionBy("bug_id").orderBy(group, "name"))
    return inputs.join(outputs, ["bug_id", "test_id"]).select("bug_id", "test_id", "input_path", "output_path", place.alias("place"))


def source_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and text of whole files."""
    return _whole(spark, paths).select("path", F.col("value").alias("text"))


POINTER = "current.txt"


def stored(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows of a table that write_upserted keeps; none before the first write."""
    named = _present(spark, lambda: spark.read.text(f"{table}/{POINTER}"), "value string").first()
    return spark.read.schema(schema).parquet(f"{table}/{named['value']}") if named else spark.createDataFrame([], schema)


def write_patches(repairs: DataFrame, folder: str) -> None:
    """The patched files of repairs (patch_file, patched_file) that have a name: one text folder for each, folder/patch_file=NAME, closed by a zero character."""
    named = repairs.where("patch_file IS NOT NULL AND patched_file IS NOT NULL").select("patch_file", "patched_file")
    named.write.mode("overwrite").option("lineSep", "\u0000").partitionBy("patch_file").text(folder)


def patches(spark: SparkSession, folder: str) -> DataFrame:
    """patch_file, patched_file as write_patches wrote them."""
    read = lambda: spark.read.option("lineSep", "\u0000").schema("value string, patch_file string").text(folder)
    return _present(spark, read, "value string, patch_file string").select("patch_file", F.col("value").alias("patched_file"))


def write_upserted(results: DataFrame, table: str) -> None:
    """results over the rows stored under table, by bug_id.

    The new rows are a folder of their own, and the file POINTER, replaced by one rename, names the folder that counts. So a write that fails
    at any point leaves the old table whole, and readers of the version before keep theirs: only older ones are removed.
    """
    from ..operators.results import upserted

    spark = results.sparkSession
    fields = results.schema
    before = _present(spark, lambda: spark.read.text(f"{table}/{POINTER}"), "value string").first()
    old = spark.read.parquet(f"{table}/{before['value']}") if before else spark.createDataFrame([], fields)
    version = f"version-{uuid.uuid4().hex}"
    upserted(old, results).write.parquet(f"{table}/{version}")
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    root = path(table)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.getFileSystem(hadoop).getUri(), hadoop)
    files, written = root.getFileSystem(hadoop), path(f"{table}/{POINTER}-{version}")
    out = files.create(written, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(written, path(f"{table}/{POINTER}"), overwrite)
    keep = {version, before["value"] if before else version}
    for entry in files.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("version-") and name not in keep:
            files.delete(entry.getPath(), True)
