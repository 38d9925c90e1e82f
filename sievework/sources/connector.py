"""Submissions as a data source of their own, for batches and streams: spark.read.format("submissions").

A folder of files with a JSON submission a line. Files are taken in the order of their names, so what is added later must
sort later; a stream's offset is the last name it has read. A filter on `file` is applied before any file is opened. The folder may be on any file system that pyarrow opens by its URI, and must
be one that all executors see.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual


def _names(path: str) -> list[str]:
    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name[0] not in "._")


@dataclass
class File(InputPartition):
    path: str
    name: str


def _lines(file: File) -> Iterator[tuple[str, str, int]]:
    system, root = fs.FileSystem.from_uri(file.path) if "://" in file.path else (fs.LocalFileSystem(), file.path)
    with system.open_input_stream(f"{root}/{file.name}") as stream:
        rest, number = b"", 0
        while block := stream.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                yield line.decode("utf-8", "replace"), file.name, number
                number += 1
        if rest:
            yield rest.decode("utf-8", "replace"), file.name, number


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        tests = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b}
        for f in filters:
            if type(f) in tests and f.attribute == ("file",):
                self.tests.append((tests[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[File]:
        return [File(self.path, n) for n in _names(self.path) if all(test(n, value) for test, value in self.tests)]

    def read(self, partition: File) -> Iterator[tuple]:
        return _lines(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        return {"file": max(_names(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(self.path, n) for n in _names(self.path) if start["file"] < n <= end["file"]]

    def read(self, partition: File) -> Iterator[tuple]:
        return _lines(partition)


class Submissions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "submissions"

    def schema(self) -> str:
        return "payload string, file string, line long"

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("submissions are read from a path")
        return self.options["path"].removeprefix("file://").rstrip("/")

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._path())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._path())


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let Spark push filters down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Submissions)
