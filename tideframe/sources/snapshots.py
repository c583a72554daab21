"""Snapshot folders: landing, picking the newest, explicit selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.functions.scalars import safe_id

# Fixed value: the pull time inside a path, YYYYMMDD_HHMMSS.
STAMP = r"(\d{8}_\d{6})"


def pull_stamp(path: Column) -> Column:
    """The pull time written into the path; null when there is none."""
    return F.nullif(F.regexp_extract(path, STAMP, 1), F.lit(""))


def pull_time(path: Column) -> Column:
    return F.try_to_timestamp(pull_stamp(path), F.lit("yyyyMMdd_HHmmss"))


def land(df: DataFrame, root: str, source: str, series: str, stamp: str) -> None:
    """Append raw rows below ``source=/series=/ingest_ts=`` folders; existing pulls stay untouched."""
    (df.withColumn(series, safe_id(F.col(series)))
       .write.mode("append").partitionBy(source, series, stamp).json(root))


def newest_by_stamp(rows: DataFrame, keys: Sequence[str], path: str = "file_path") -> DataFrame:
    """Rows of the newest pull per key by the time inside the path; copies keep that, not file times."""
    stamped = rows.withColumn("_stamp", pull_stamp(F.col(path))).filter(F.col("_stamp").isNotNull())
    latest = stamped.groupBy(*keys).agg(F.max("_stamp").alias("_stamp"))
    return stamped.join(latest, [*keys, "_stamp"], "left_semi").drop("_stamp")


def newest_by_file_time(rows: DataFrame, keys: Sequence[str], time: str = "file_time", path: str = "file_path") -> DataFrame:
    """Rows of the most recently modified file per key; equal times fall back to the larger path."""
    latest = rows.groupBy(*keys).agg(F.max_by(path, F.struct(time, path)).alias(path))
    return rows.join(latest, [*keys, path], "left_semi")


def select_snapshots(wanted: Sequence[str], files: Mapping[str, str]) -> list[str]:
    """Explicit choice of one file per series; every series needs one."""
    lacking = sorted(set(wanted) - set(files))
    if lacking:
        raise ValueError(f"no snapshot chosen for {lacking}")
    return [files[s] for s in wanted]


def read_snapshots(spark: SparkSession, root: str, schema, stamp: str = "ingest_ts") -> DataFrame:
    """All landed pulls; partition folders come back as columns, the stamp as text."""
    raw = spark.read.schema(schema).option("basePath", root).option("recursiveFileLookup", False).json(root)
    return raw.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("file_time"))
