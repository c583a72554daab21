"""Tables on disk: CSV, optional tables, sinks, manifests and run reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.functions.scalars import to_day, to_number


def read_csv(spark: SparkSession, path: str, dates: Sequence[str], numbers: Sequence[str], texts: Sequence[str] = ()) -> DataFrame:
    """CSV with a header; every field is read as text and coerced, so bad cells become null."""
    header = spark.read.option("header", True).csv(path)
    return header.select(
        *[to_day(F.col(c)).alias(c) for c in dates],
        *[to_number(F.col(c)).alias(c) for c in numbers], *texts)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty table of the same type when it is absent."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_archive(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """Archive rows; an old archive without provenance gets a marker instead."""
    typed = ", ".join([*[f"{k} STRING" for k in keys], "reference_month DATE", "value DOUBLE", "source_pull STRING"])
    if not exists(spark, path):
        return spark.createDataFrame([], typed)
    found = spark.read.parquet(path)
    if "source_pull" not in found.columns:
        found = found.withColumn("source_pull", F.lit("unknown (before provenance was kept)"))
    return found.select(*keys, "reference_month", F.col("value").cast("double").alias("value"), "source_pull")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def replace_table(spark: SparkSession, df: DataFrame, path: str, check: Callable[[DataFrame], None]) -> None:
    """Write beside the target, check what was written, then swap; bad data never replaces good.

    A job that died between its two renames left the table under ``.old``; it is put back before anything else.
    """
    staged, old = f"{path}.staged", f"{path}.old"
    restore_table(spark, path)
    df.write.mode("overwrite").parquet(staged)
    check(spark.read.parquet(staged))
    fs, target = _fs(spark, path)
    _, staged_path = _fs(spark, staged)
    _, old_path = _fs(spark, old)
    if fs.exists(old_path):
        fs.delete(old_path, True)
    if fs.exists(target) and not fs.rename(target, old_path):
        raise OSError(f"cannot set aside {path}")
    if not fs.rename(staged_path, target):
        fs.rename(old_path, target)
        raise OSError(f"cannot put {staged} in place")
    fs.delete(old_path, True)


def restore_table(spark: SparkSession, path: str) -> None:
    """Put back a table that an interrupted swap had set aside."""
    fs, target = _fs(spark, path)
    _, old_path = _fs(spark, f"{path}.old")
    if not fs.exists(target) and fs.exists(old_path):
        fs.rename(old_path, target)


def write_mapping(mapping: DataFrame, path: str, start: str, end: str) -> int:
    """Write the release calendar in month order and return its row count.

    ``end`` never cuts months that are already known beyond it.
    """
    known = mapping.agg(F.max("reference_month").cast("string")).first()[0]
    last = F.lit(max(end, known or end)).cast("date")
    kept = mapping.filter(F.col("reference_month").between(F.lit(start).cast("date"), last))
    kept.orderBy("reference_month").write.mode("overwrite").parquet(path)
    return mapping.sparkSession.read.parquet(path).count()


def manifest(spark: SparkSession, files: Mapping[str, str], tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per input: path, bytes, sha256 of each file, row count and date range.

    ``files`` maps a name to a path, folder or glob; ``tables`` maps it to a frame and its date column. Files are hashed in
    pieces, one task per file.
    """
    from tideframe.sources.digests import data_files, file_digests

    listed = {name: data_files(spark, path) for name, path in files.items()}
    names = spark.createDataFrame([(n, p) for n, paths in listed.items() for p in paths], "input string, path string")
    hashed = names.join(file_digests(spark, sorted({p for paths in listed.values() for p in paths})), "path").select("input", "path", "bytes", "sha256")
    stats = table_facts(tables)
    return hashed.join(stats, "input", "left")


def table_facts(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per input: row count and date range."""
    stats = None
    for name, (df, time) in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.col(time)).cast("date").alias("first_date"), F.max(F.col(time)).cast("date").alias("last_date"))
        one = one.select(F.lit(name).alias("input"), "*")
        stats = one if stats is None else stats.unionByName(one)
    return stats


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A run report; missing or corrupt reports give no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_json("value", f"{schema}, _corrupt STRING", options).alias("r")
    return spark.read.text(path).select(parsed).select("r.*").filter(F.col("_corrupt").isNull()).drop("_corrupt")


def export_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Write result tables as CSV without their unrounded ``*_raw`` columns."""
    for name, df in tables.items():
        kept = [c for c in df.columns if not c.endswith("_raw")]
        df.select(*kept).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
