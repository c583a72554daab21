"""Exact order statistics without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.scalars import is_finite
from tideframe.panel import UNBOUNDED, null_safe_join
from tideframe.session import stored


def _narrow(rows: DataFrame, targets: DataFrame, on: list[str], bin_of: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """Count rows per bin, find the bin of each target rank, keep only rows of such bins.

    The targets are stored: a few rows per group, whose file size lets the planner
    decide whether the join that follows is a broadcast.
    """
    binned = rows.withColumn(name, bin_of)
    counts = binned.groupBy(*on, name).agg(F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    before = Window.partitionBy(*on).orderBy(name).rowsBetween(UNBOUNDED, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    hit = null_safe_join(targets, counts, on).filter(
        (F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_in")))
    hit = stored(hit.withColumn("_rank", F.col("_rank") - F.col("_before")).drop("_before", "_in"), "ranks")
    wanted = hit.select(*on, name, "_lo", "_hi").distinct()
    kept = null_safe_join(binned.drop("_lo", "_hi"), wanted, [*on, name])
    return kept, hit.drop("_lo", "_hi")


def pick_ranks(df: DataFrame, groups: Sequence[str], value: str, ranks: DataFrame) -> DataFrame:
    """The value at each 1-based rank. ``ranks`` holds the groups, a ``label`` and ``rank``.

    Two rounds of counting per bin (by magnitude, then linear inside the bin) shrink a
    group of any size to the few values that can hold the rank. The rows themselves are
    scanned, never shuffled (NaN and infinity have no rank and are left out; a null group is a group): only bin counts and the last candidates move, and equal
    candidates are merged on the map side.
    """
    on = list(groups)
    rows = df.filter(is_finite(F.col(value).cast("double"))).select(*on, F.col(value).cast("double").alias("_v"))
    targets = ranks.select(*on, "label", F.col("rank").alias("_rank"))
    magnitude = F.floor(F.log2(F.abs("_v") + 1e-9) * 64) + 2000
    coarse = F.when(F.col("_v") < 0, -magnitude).otherwise(magnitude)
    rows, targets = _narrow(rows, targets, on, coarse, "_b1")
    width = F.col("_hi") - F.col("_lo")
    fine = F.when(width > 0, F.floor((F.col("_v") - F.col("_lo")) / width * 4095)).otherwise(0)
    rows, targets = _narrow(rows, targets, [*on, "_b1"], fine, "_b2")
    bins = [*on, "_b1", "_b2"]
    inside = Window.partitionBy(*bins).orderBy("_v").rowsBetween(UNBOUNDED, 0)
    ordered = rows.groupBy(*bins, "_v").agg(F.count(F.lit(1)).alias("_w")).withColumn("_upto", F.sum("_w").over(inside))
    found = null_safe_join(targets, ordered, bins).filter(
        (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_w")))
    return found.select(*on, "label", F.col("_v").alias("value"))


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles, one column ``q<percent>`` per level."""
    on = list(groups)
    sizes = df.groupBy(*on).agg(F.count_if(is_finite(F.col(value).cast("double"))).alias("_n")).filter("_n > 0")
    wanted = sizes.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in levels])))
    wanted = stored(wanted, "levels")
    at = wanted.withColumn("_at", (F.col("_n") - 1) * F.col("_p"))
    ends = F.explode(F.array(
        F.struct(F.lit("lo").alias("end"), (F.floor("_at") + 1).alias("rank")),
        F.struct(F.lit("hi").alias("end"), (F.ceil("_at") + 1).alias("rank"))))
    spread = at.withColumn("_e", ends)
    label = F.concat_ws("|", F.col("_p").cast("string"), F.col("_e.end"))
    picked = pick_ranks(df, on, value, spread.select(*on, label.alias("label"), F.col("_e.rank").alias("rank")))
    picked = null_safe_join(picked, spread.select(*on, label.alias("label"), "_p", "_at", F.col("_e.end").alias("_end")), [*on, "label"])
    ends = picked.groupBy(*on, "_p", "_at").agg(
        F.max(F.when(F.col("_end") == "lo", F.col("value"))).alias("_a"),
        F.max(F.when(F.col("_end") == "hi", F.col("value"))).alias("_b"))
    exact = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))
    columns = [F.max(F.when(F.col("_p") == float(p), exact)).alias(f"q{round(p * 100)}") for p in levels]
    return ends.groupBy(*on).agg(*columns)
