"""Digests of files as a Python data source: one partition per file, read in pieces."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 4 << 20


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: Sequence[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(partition.path)
        digest, size = hashlib.sha256(), 0
        with system.open_input_stream(name) as stream:
            while piece := stream.read(PIECE):
                digest.update(piece)
                size += len(piece)
        yield partition.path, size, digest.hexdigest()


class FileDigests(DataSource):
    """``path, bytes, sha256`` of each file of the option ``paths``, a JSON list of URIs."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, bytes long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["paths"]))


def data_files(spark: SparkSession, path: str) -> list[str]:
    """URIs of the files a path or glob names, those below a folder included; names that start with ``_`` or ``.`` are not data."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for found in fs.globStatus(hadoop_path) or []:
        listed = fs.listFiles(found.getPath(), True)
        while listed.hasNext():
            own = listed.next().getPath()
            if not own.getName().startswith(("_", ".")):
                out.append(own.toUri().toString())
    return sorted(u.replace("file:/", "file:///", 1) if u.startswith("file:/") and not u.startswith("file://") else u for u in out)


def file_digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, bytes, sha256`` per file; a task holds one piece of one file at a time."""
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").option("paths", json.dumps(list(paths))).load()
