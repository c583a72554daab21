"""Data contracts: each check is an aggregate or a table of violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.panel import Framed, PanelSpec, framed


class ContractError(ValueError):
    """A contract does not hold."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ContractError(f"missing columns {lacking}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def check_table(df: DataFrame, checks: Mapping[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """Rows that break each check, counted in one pass. A null condition counts as broken."""
    names = list(checks)
    agg = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(~F.coalesce(checks[c], F.lit(False))).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n_bad")) for c in names])
    out = agg.select(*groups, "n_rows", F.explode(pairs).alias("_c"))
    return out.select(*groups, F.col("_c.check").alias("check"), "n_rows", F.col("_c.n_bad").alias("n_bad"),
                      ((F.col("_c.n_bad") == 0) & (F.col("n_rows") > 0)).alias("passed"))


def enforce(checks: DataFrame) -> None:
    """Stop the job when a check failed; the message counts all failures and shows the first of them.

    The table holds one row per check and group, not per data row; callers that need every failure filter it.
    """
    failed = checks.filter(~F.coalesce(F.col("passed"), F.lit(False)))
    n = failed.count()
    if n:
        shown = failed.orderBy(*checks.columns).limit(20).collect()
        raise ContractError(f"{n} failed: " + "; ".join(str(row.asDict()) for row in shown))


def missing_months(df: DataFrame, keys: Sequence[str], month: str = "reference_month") -> DataFrame:
    """Series whose months are not contiguous, with how many are missing between the first and the last."""
    at = F.year(month) * 12 + F.month(month)
    spans = df.filter(F.col(month).isNotNull()).groupBy(*keys).agg((F.max(at) - F.min(at) + 1 - F.countDistinct(at)).alias("n_missing"))
    return spans.filter("n_missing > 0")


def archive_checks(archive: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per rule of an archive: not empty, keys and values present, keys unique, months contiguous per series."""
    series = [k for k in keys if k != "reference_month"]
    present = check_table(archive, {"key_present": F.col("reference_month").isNotNull(), "value_present": F.col("value").isNotNull()})
    counted = lambda name, df: df.agg(F.count(F.lit(1)).alias("n_bad")).select(
        F.lit(name).alias("check"), F.lit(None).cast("long").alias("n_rows"), "n_bad", (F.col("n_bad") == 0).alias("passed"))
    return present.unionByName(counted("key_unique", duplicate_keys(archive, keys))).unionByName(counted("months_contiguous", missing_months(archive, series)))


def out_of_order(df: DataFrame, spec: PanelSpec, value: str) -> DataFrame:
    """Rows whose ``value`` is not after the one of the row before them; ``spec.time`` is the ingest position."""
    seen = framed(df, spec, Framed(1, 0, lambda w: {"_before": F.lag(value).over(w)}))
    return seen.filter(F.col(value) <= F.col("_before")).drop("_before")


def known_too_early(df: DataFrame, known: str, valid: str) -> DataFrame:
    """Rows whose knowledge time is not strictly after their valid time."""
    return df.filter(F.col(known) <= F.col(valid))


def unmapped(df: DataFrame, mapping: DataFrame, on: Sequence[str], allowed: DataFrame) -> DataFrame:
    """Rows without a mapping that no allow-list documents."""
    return df.join(mapping, list(on), "left_anti").join(allowed, list(on), "left_anti")


def mapping_coverage(mapping: DataFrame, requested_end: str, groups: Sequence[str] = ()) -> DataFrame:
    """Newest mapped month against the requested end, by year and month."""
    newest = mapping.groupBy(*groups).agg(F.max("reference_month").alias("latest_mapped"))
    short = F.date_format("latest_mapped", "yyyy-MM") < F.lit(requested_end[:7])
    return newest.withColumn("covers_request", ~short)


def source_status(checks: DataFrame, fallback: DataFrame, source: str = "source") -> DataFrame:
    """Status per source: success, warning when only the cached snapshot is usable, failed otherwise."""
    live = checks.groupBy(source).agg(F.bool_and("passed").alias("_live"))
    cached = fallback.groupBy(source).agg(F.bool_and("passed").alias("_cached"))
    both = live.join(cached, source, "full_outer")
    status = (F.when(F.coalesce("_live", F.lit(False)), "success")
              .when(F.coalesce("_cached", F.lit(False)), "warning").otherwise("failed"))
    return both.select(source, status.alias("status"))


def run_status(sources: DataFrame, source: str = "source") -> DataFrame:
    """Status of the run: the derived tables are built only when no source failed."""
    worst = sources.agg(
        F.count(F.lit(1)).alias("n_sources"), F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status") == "warning").alias("n_warning"))
    return worst.select(
        "*", F.when(F.col("n_failed") > 0, "skipped").otherwise("built").alias("gold"),
        F.when(F.col("n_failed") > 0, "failed").when(F.col("n_warning") > 0, "warning").otherwise("success").alias("status"))
