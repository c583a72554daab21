"""Several tables that change together: each version is a manifest, written last, that names the files of every table.

A table's data go to a new folder; the manifest of the next number then names it beside the tables that stay. Readers take
the newest manifest that is whole, so a job that dies before it leaves the old state of all tables. Old folders stay until
``forget`` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tideframe.sources.tables import _fs


class ConcurrentCommit(RuntimeError):
    """Another job committed the version this one was about to write."""


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _fs(spark, f"{root}/versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), reverse=True)


def _manifest(spark: SparkSession, root: str, version: int) -> dict[str, str] | None:
    rows = spark.read.text(f"{root}/versions/{version:010d}.json", wholetext=True).collect()
    try:
        found = json.loads(rows[0][0]) if rows else None
    except json.JSONDecodeError:
        return None
    return found["tables"] if isinstance(found, dict) and found.get("whole") else None


def current(spark: SparkSession, root: str, upto: int | None = None) -> tuple[int, dict[str, str]]:
    """(version, folder of each table) of the newest whole version, or of the newest up to ``upto``; version 0 has no table."""
    for number in _versions(spark, root):
        if upto is None or number <= upto:
            tables = _manifest(spark, root, number)
            if tables is not None:
                return number, tables
    return 0, {}


def new_folder(root: str, name: str) -> str:
    """A folder for the data of a table; nothing reads it before a manifest names it."""
    return f"{root}/data/{name.replace('/', '_')}-{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str, folders: Mapping[str, str]) -> int:
    """Make written folders the tables of the next version, beside those that stay; returns its number.

    The manifest is created exclusively: of two jobs that build on the same version one fails.
    """
    _, tables = current(spark, root)
    number = max(_versions(spark, root), default=0) + 1
    fs, path = _fs(spark, f"{root}/versions/{number:010d}.json")
    text = json.dumps({"tables": {**tables, **folders}, "whole": True}, sort_keys=True)
    try:
        out = fs.create(path, False)
    except Exception as error:
        raise ConcurrentCommit(f"version {number} of {root} exists") from error
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    return number


def commit(spark: SparkSession, root: str, tables: Mapping[str, DataFrame]) -> int:
    """Write all tables, then publish them as one version."""
    folders = {name: new_folder(root, name) for name in tables}
    for name, df in tables.items():
        df.write.parquet(folders[name])
    return publish(spark, root, folders)


def read_version(spark: SparkSession, root: str, name: str, schema: str | T.StructType | None = None, version: int | None = None) -> DataFrame:
    """A table as of a version; without one, an empty table of ``schema``."""
    folder = current(spark, root, version)[1].get(name)
    if folder is None:
        if schema is None:
            raise FileNotFoundError(f"{root} has no table {name}")
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(folder)


def forget(spark: SparkSession, root: str) -> list[str]:
    """Remove the data folders that the newest version does not name; call it when no reader of an older version is left."""
    kept = {f.rsplit("/", 1)[-1] for f in current(spark, root)[1].values()}
    fs, folder = _fs(spark, f"{root}/data")
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in kept] if fs.exists(folder) else []
    for path in gone:
        fs.delete(path, True)
    return [p.getName() for p in gone]
