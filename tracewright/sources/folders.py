"""Folders of bug files as a Spark data source: files are dealt over tasks, filters on bug_id choose files before any is opened, and new files can be streamed.

    register(spark)
    spark.read.format("bug_files").load("/data/bugs").where("bug_id = '9-A-bug-1-2'")
    spark.readStream.format("bug_files").load("/data/bugs")

Options: suffix (".json"), files (that a task opens, 64), settle (seconds a file must be old before a stream takes it, 1). The folder must be in a
store that Python's pyarrow.fs reaches; bugs.bugs() reads by Spark's own readers where it is not.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from . import bugs

SCHEMA = "bug_id string, path string, text string"


@dataclass
class Files(InputPartition):
    """Files that one task opens."""

    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class _Folder:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.suffix, self.size, self.settle = options.get("suffix", ".json"), int(options.get("files", 64)), float(options.get("settle", 1))

    def system(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def listed(self) -> list[tuple[int, str]]:
        """(time in nanoseconds, path) of each file."""
        fs, base = self.system()
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return sorted((info.mtime_ns, info.path) for info in found if info.type == pafs.FileType.File and info.path.endswith(self.suffix))

    def named(self, bug_ids: Iterable[str]) -> list[str]:
        """Files of these bugs that are there; nothing is listed."""
        fs, base = self.system()
        wanted = [f"{base}/{bug}{self.suffix}" for bug in sorted(set(bug_ids)) if "/" not in bug]
        return [info.path for info in fs.get_file_info(wanted) if info.type == pafs.FileType.File] if wanted else []

    def dealt(self, paths: list[str]) -> list[Files]:
        return [Files(paths[k : k + self.size]) for k in range(0, len(paths), self.size)]

    def rows(self, paths: list[str]) -> Iterator[pa.RecordBatch]:
        fs, _ = self.system()
        for path in paths:
            with fs.open_input_stream(path) as file:
                text = file.read().decode()
            yield pa.RecordBatch.from_pydict({"bug_id": [path.rsplit("/", 1)[-1].removesuffix(self.suffix)], "path": [path], "text": [text]})


class _Reader(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder, self.bug_ids = folder, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("bug_id",):
                asked = {x for x in ([f.value] if isinstance(f, EqualTo) else f.value) if x is not None}
                self.bug_ids = asked if self.bug_ids is None else self.bug_ids & asked
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return self.folder.dealt([path for _, path in self.folder.listed()] if self.bug_ids is None else self.folder.named(self.bug_ids)) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition.paths)


class _StreamReader(DataSourceStreamReader):
    """Files in order of their times; one is taken when it has been left alone for some seconds."""

    def __init__(self, folder: _Folder):
        self.folder = folder

    def initialOffset(self) -> dict[str, Any]:  # noqa: N802
        return {"until": 0}

    def latestOffset(self) -> dict[str, Any]:  # noqa: N802
        settled = time.time_ns() - int(self.folder.settle * 1e9)
        return {"until": max((at for at, _ in self.folder.listed() if at <= settled), default=0)}

    def partitions(self, start: dict[str, Any], end: dict[str, Any]) -> list[InputPartition]:
        return self.folder.dealt([path for at, path in self.folder.listed() if start["until"] < at <= end["until"]])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition.paths)


class BugFiles(DataSource):
    """bug_id (the file's name), path and text of each file of a folder; a missing folder has none."""

    @classmethod
    def name(cls) -> str:
        return "bug_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Folder(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(_Folder(dict(self.options)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BugFiles)


def records(files: DataFrame, source_dir: str = "", dataset: str = "codeflaws") -> DataFrame:
    """bugs.bugs() of rows of the data source, a stream's as well: unreadable files are left out."""
    parsed = F.from_json("text", bugs.BUG_FILE.removesuffix(", _corrupt string") + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = files.select("bug_id", parsed.alias("r")).where("r IS NOT NULL AND r._corrupt IS NULL").select("bug_id", "r.*")
    return bugs.described(rows, source_dir, dataset)


def bug_files(spark: SparkSession, where: str, **options: str) -> DataFrame:
    """The files of a folder by the data source: bug_id, path, text."""
    register(spark)
    return spark.read.format("bug_files").options(**options).load(where)


bugs.LOADERS["codeflaws_files"] = lambda spark, where, source_dir="", dataset="codeflaws": records(bug_files(spark, where), source_dir, dataset)
