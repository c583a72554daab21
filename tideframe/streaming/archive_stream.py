"""The archive fed by a stream of snapshot files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tideframe.operators.archive import accept_pull, rebuild
from tideframe.session import stored
from tideframe.sources.snapshots import pull_stamp
from tideframe.sources.versions import current, new_folder, publish

#: Hashed keys by which the accepted rows of a pull are sorted, so that a scan for some of them skips row groups.
BUCKETS = 32


def read_pulls(spark: SparkSession, root: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """Stream of landed pull rows with the pull stamp of their path as ``source_pull``.

    ``per_trigger`` bounds the files of one batch; what the archive holds in the end does not depend on it.
    """
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True).json(root)
    return raw.withColumn("source_pull", pull_stamp(F.col("_metadata.file_path")))


def run_archive_stream(
    spark: SparkSession, pulls: DataFrame, root: str, keys: Sequence[str], limit: float
) -> StreamingQuery:
    """Keep the archive below ``root`` up to date; drains what is available and stops.

    A batch stages its rows under its own number, so repeating it changes nothing. Then the pulls it touched and all
    newer ones are judged anew, oldest first, each as a whole from the staged rows of every batch: a pull with one
    value further than ``limit`` from the archive before it is set aside, the rest become that pull's accepted
    rows. So neither the cut of a pull into batches nor the order of arrival decides anything, and a late, older pull fills
    gaps without overwriting newer values. Staged rows lie by pull and accepted ones sorted by hashed key, so a pull is held against
    the buckets of its own keys only. All that a batch changes becomes visible at once, as one version.
    """
    columns = [*keys, "value", "source_pull"]

    def fold(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.filter(F.col("value").isNotNull() & F.col("source_pull").isNotNull()).select(*columns)
        staged = f"{root}/staged/batch={number}"
        rows.withColumn("pull", F.col("source_pull")).write.mode("overwrite").partitionBy("pull").parquet(staged)
        typed = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType()), T.StructField("pull", T.StringType())])
        everything = session.read.schema(typed).parquet(f"{root}/staged")
        # One row per pull, read from the names of folders.
        stamps = sorted(r[0] for r in everything.select("pull").distinct().collect())
        touched = {r[0] for r in everything.filter(F.col("batch") == number).select("pull").distinct().collect()}
        held = current(session, root)[1]
        for stamp in [s for s in stamps if touched and s >= min(touched)]:
            own = stored(everything.filter(F.col("pull") == stamp).select(*columns).distinct().withColumn("bucket", _bucket(keys)), "pull")
            buckets = [r[0] for r in own.select("bucket").distinct().collect()]
            older = _rows(session, [p for n, p in held.items() if n.startswith("accepted/") and n < f"accepted/{stamp}"], keys)
            good, bad = accept_pull(older.filter(F.col("bucket").isin(buckets)).drop("bucket"), own, keys, limit)
            for name, df in (("accepted", good), ("quarantine", bad)):
                held[f"{name}/{stamp}"] = new_folder(root, name)
                df.sortWithinPartitions("bucket").write.parquet(held[f"{name}/{stamp}"])
        publish(session, root, held)

    return (
        pulls.writeStream.foreachBatch(fold)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )


def _bucket(keys: Sequence[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _rows(spark: SparkSession, folders: Sequence[str], keys: Sequence[str]) -> DataFrame:
    typed = ", ".join([*[f"{k} DATE" if k == "reference_month" else f"{k} STRING" for k in keys], "value DOUBLE", "source_pull STRING", "bucket INT"])
    return spark.read.schema(typed).parquet(*folders) if folders else spark.createDataFrame([], typed)


def accepted(spark: SparkSession, root: str, keys: Sequence[str], kind: str = "accepted") -> DataFrame:
    """Accepted rows of all pulls as of the newest version, or with ``kind="quarantine"`` those that were set aside."""
    held = current(spark, root)[1]
    return _rows(spark, [p for n, p in held.items() if n.startswith(f"{kind}/")], keys).drop("bucket")


def latest_archive(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """The archive as of the last finished batch: per key the accepted value of the newest pull."""
    return rebuild(accepted(spark, root, keys), keys)
