"""Revision-guarded archive of snapshots: merge, rebuild and revision log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.operators.contracts import ContractError
from tideframe.panel import keep_one

TOLERANCE = 1e-9


def revisions(archive: DataFrame, pull: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Archived values a new pull would change."""
    old = archive.select(*keys, F.col("value").alias("value_old"), F.col("source_pull").alias("pull_old"))
    new = pull.filter(F.col("value").isNotNull()).select(*keys, F.col("value").alias("value_new"), F.col("source_pull").alias("pull_new"))
    change = F.col("value_new") - F.col("value_old")
    return old.join(new, list(keys)).withColumn("change", change).filter(F.abs("change") > TOLERANCE)


def guard_report(changes: DataFrame, limit: float) -> DataFrame:
    """One row: the limit, how many values move by more, the largest move and whether that refuses the merge."""
    far = F.count_if(F.abs("change") > limit)
    return changes.agg(F.lit(limit).alias("limit"), far.alias("n_over"), F.max(F.abs("change")).alias("largest"), (far > 0).alias("refused"))


def guard(changes: DataFrame, limit: float) -> None:
    """Refuse the whole merge when one value moves by more than ``limit``."""
    worst = guard_report(changes, limit).first()
    if worst["refused"]:
        raise ContractError(f"{worst['n_over']} archived values would change by more than {limit}; the largest by {worst['largest']}")


def merge(archive: DataFrame, pull: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of archive and pull per key: the newest pull wins, a null never overwrites a value."""
    columns = [*keys, "value", "source_pull"]
    both = archive.select(*columns, F.lit(0).alias("_new")).unionByName(
        pull.filter(F.col("value").isNotNull()).select(*columns, F.lit(1).alias("_new")))
    return keep_one(both, keys, [F.col("_new"), F.col("source_pull")], "last").drop("_new")


def guarded_merge(archive: DataFrame, pull: DataFrame, keys: Sequence[str], limit: float) -> DataFrame:
    guard(revisions(archive, pull, keys), limit)
    return merge(archive, pull, keys)


def revision_log(pulls: DataFrame, keys: Sequence[str], limit: float) -> DataFrame:
    """All changes between consecutive pulls that saw the same key, and whether they break the limit.

    The number of pulls of one key is the number of snapshots, so the window is short.
    """
    w = Window.partitionBy(*keys).orderBy("source_pull")
    seen = pulls.filter(F.col("value").isNotNull()).withColumns({
        "value_old": F.lag("value").over(w), "pull_old": F.lag("source_pull").over(w)})
    change = F.col("value") - F.col("value_old")
    return seen.withColumn("change", change).filter(F.abs("change") > TOLERANCE).select(
        *keys, "pull_old", F.col("source_pull").alias("pull_new"), "value_old", F.col("value").alias("value_new"),
        "change", (F.abs("change") > limit).alias("rejected"))


def accept_pull(before: DataFrame, pull: DataFrame, keys: Sequence[str], limit: float) -> tuple[DataFrame, DataFrame]:
    """(rows to take in, rows set aside) of one whole pull, given the accepted rows of older pulls.

    One value further than ``limit`` from the archived one sets the whole pull aside.
    """
    refused = not revisions(rebuild(before, keys), pull, keys).filter(F.abs("change") > limit).isEmpty()
    return pull.filter(F.lit(not refused)), pull.filter(F.lit(refused))


def rebuild(pulls: DataFrame, keys: Sequence[str], seed: DataFrame | None = None, limit: float | None = None) -> DataFrame:
    """The archive from all pulls at once: per key the value of the newest pull that had one.

    Equal to folding the pulls oldest to newest, in one aggregate. ``seed`` is an
    existing archive that any pull overrides. With ``limit`` each pull must pass the revision guard against
    the pulls before it, as if they were merged one by one; one that does not stops the job.
    """
    if limit is not None:
        steps = pulls if seed is None else pulls.select(*keys, "value", "source_pull").unionByName(seed.select(*keys, "value", F.lit("").alias("source_pull")))
        guard(revision_log(steps, keys, limit), limit)
    columns = [*keys, "value", "source_pull"]
    rows = pulls.filter(F.col("value").isNotNull()).select(*columns, F.lit(1).alias("_rank"))
    if seed is not None:
        rows = rows.unionByName(seed.select(*columns, F.lit(0).alias("_rank")))
    return keep_one(rows, keys, [F.col("_rank"), F.col("source_pull")], "last").drop("_rank")


def prioritised_union(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union where an earlier frame wins per key and later frames only fill gaps.

    Within one frame the first row by value order counts.
    """
    stacked = None
    for rank, df in enumerate(frames):
        ranked = df.withColumn("priority", F.lit(rank))
        stacked = ranked if stacked is None else stacked.unionByName(ranked, allowMissingColumns=True)
    others = [F.col(c) for c in stacked.columns if c not in (*keys, "priority")]
    return keep_one(stacked, keys, [F.col("priority"), *others], "first")
