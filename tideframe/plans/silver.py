"""The published-index job: archive, window, release dates, contracts, write only after all checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.operators import archive as ar
from tideframe.operators import contracts as ct
from tideframe.operators.features import clamp
from tideframe.session import stored
from tideframe.sources.versions import commit, read_version


def align_to_releases(index: DataFrame, mapping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of the release dates; months without one stay and hold null."""
    return index.join(mapping.select(*keys, "release_date"), list(keys), "left")


def contract_table(silver: DataFrame, keys: Sequence[str], allowed: DataFrame) -> DataFrame:
    """One row per check: key present, value present, known after valid, release date present or allow-listed."""
    listed = silver.join(allowed.select(*keys, F.lit(True).alias("_allowed")), list(keys), "left")
    unknown = F.col("release_date").isNull()
    return ct.check_table(listed, {
        "key_present": F.col("reference_month").isNotNull(), "value_present": F.col("value").isNotNull(),
        "known_after_valid": unknown | (F.col("release_date") > F.col("reference_month")),
        "mapped_or_allowed": ~unknown | F.col("_allowed")})


def build_silver(archive: DataFrame, mapping: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Archive months in the window with their release dates."""
    return align_to_releases(clamp(archive, "reference_month", start, end), mapping, keys)


def run_silver(
    spark: SparkSession, archive: DataFrame, pull: DataFrame, mapping: DataFrame, allowed: DataFrame, keys: Sequence[str],
    start: str, end: str, limit: float, root: str, replay: bool,
) -> DataFrame:
    """Merge a pull, align and check it, commit the tables ``silver`` and ``archive`` of ``root``; a replay leaves the archive.

    Both tables are computed once, into the shared folder, and checked there. They become visible together, after every check
    has passed: a job that dies on the way leaves the old pair.
    """
    merged = stored(ar.guarded_merge(archive, pull, keys, limit), "merged")
    silver = stored(build_silver(merged, mapping, keys, start, end), "silver")
    ct.enforce(ct.archive_checks(merged, keys))
    ct.enforce(ct.check_table(ct.duplicate_keys(mapping, keys), {"mapping_unique": F.lit(False)}).withColumn("passed", F.col("n_rows") == 0))
    ct.enforce(contract_table(silver, keys, allowed))
    commit(spark, root, {"silver": silver} if replay else {"silver": silver, "archive": merged})
    return read_version(spark, root, "silver")
