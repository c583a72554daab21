"""Queries over data with null keys, null times, NaN and infinity, in both physical forms of a panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.operators.order_statistics import exact_quantiles
from tideframe.operators.profile import box_statistics
from tideframe.operators.scoring import interval_coverage
from tideframe.panel import Framed, PanelSpec, Running, framed, running, series_length, with_position
from tideframe.plans import views as v
from tideframe.plans.catalogue import query, r, rounded
from tideframe.plans.views import sql_with

PLAIN = PanelSpec(keys=("event_type",), time="ts", tie=("event_id",))
BLOCKED = PanelSpec(keys=("event_type",), time="ts", tie=("event_id",), grain="minute", block_rows=200)

_GAPPY = """
SELECT CASE WHEN event_id % 5 > 0 THEN event_type END AS event_type, CASE WHEN event_id % 13 > 0 THEN ts END AS ts, event_id,
 CASE WHEN event_id % 50 = 1 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 50 = 2 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 50 = 3 THEN CAST('-Infinity' AS DOUBLE) WHEN event_id % 50 > 4 THEN ln(value + 1) END AS x
FROM events"""


def gappy_events(spark, folder):
    """Events of which some have no type, no time, no value, or a value that is not finite."""
    n = F.col("event_id")
    odd = F.when(n % 50 == 1, float("nan")).when(n % 50 == 2, float("inf")).when(n % 50 == 3, float("-inf")).when(n % 50 > 4, F.ln(F.col("value") + 1))
    return v.table(spark, folder, "events").select(F.when(n % 5 > 0, F.col("event_type")).alias("event_type"), F.when(n % 13 > 0, F.col("ts")).alias("ts"), "event_id", odd.alias("x"))


_WINDOW_SQL = sql_with(f"""
SELECT event_type, event_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY event_type) AS n_rows, count(z) OVER w AS n_seen, {r('sum(z) OVER w', 'total')}, {r('lag(z, 3) OVER w', 'back3')},
 {r('last_value(z IGNORE NULLS) OVER w', 'latest')} FROM (SELECT *, CASE WHEN isfinite(x) THEN x END AS z FROM g) WINDOW w AS (PARTITION BY event_type ORDER BY ts NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING)""", g=_GAPPY)


def _windows(spark, folder, spec):
    finite = F.when(~F.isnan("x") & (F.abs("x") != float("inf")), F.col("x"))
    d = gappy_events(spark, folder).withColumn("z", finite)
    d = series_length(with_position(d, spec), spec)
    d = framed(d, spec, Framed(3, 0, lambda w: {"back3": F.lag("z", 3).over(w)}))
    d = running(d, spec, Running("count", "z", "n_seen"), Running("sum", "z", "total"), Running("last", "z", "latest"))
    return rounded(d.select("event_type", "event_id", "pos", "n_rows", "n_seen", "total", "back3", "latest"))


@query("null_keys_plain", _WINDOW_SQL)
def null_keys_plain(spark, folder):
    return _windows(spark, folder, PLAIN)


@query("null_keys_blocked", _WINDOW_SQL)
def null_keys_blocked(spark, folder):
    return _windows(spark, folder, BLOCKED)


@query("quantiles_not_finite", sql_with(
    f"SELECT event_type, {r('quantile_cont(x, 0.25)', 'q25')}, {r('quantile_cont(x, 0.5)', 'q50')}, {r('quantile_cont(x, 0.9)', 'q90')} FROM g WHERE isfinite(x) GROUP BY 1", g=_GAPPY))
def quantiles_not_finite(spark, folder):
    """Values that are not finite have no rank; rows without a type are a group."""
    return rounded(exact_quantiles(gappy_events(spark, folder), ["event_type"], "x", (0.25, 0.5, 0.9)))


@query("coverage_not_finite", sql_with(f"""
SELECT event_type, count(*) AS n_forecasts, {r("avg(CASE WHEN actual BETWEEN lo AND hi THEN 100.0 ELSE 0.0 END) FILTER (isfinite(actual) AND isfinite(lo) AND isfinite(hi))", 'coverage_90')},
 {r("avg(hi - lo) FILTER (isfinite(actual) AND isfinite(lo) AND isfinite(hi))", 'width_90')} FROM (
 SELECT event_type, x AS actual, CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 1.0 END AS lo, CASE WHEN event_id % 9 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 3.0 + event_id % 2 END AS hi FROM g) GROUP BY 1""", g=_GAPPY))
def coverage_not_finite(spark, folder):
    d = gappy_events(spark, folder).select(
        "event_type", F.col("x").alias("actual"), F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(1.0).alias("lo"),
        F.when(F.col("event_id") % 9 == 0, float("inf")).otherwise(3.0 + F.col("event_id") % 2).alias("hi"))
    return rounded(interval_coverage(d, ["event_type"], {90: "lo"}, {90: "hi"}))


@query("box_null_group", sql_with(f"""
SELECT event_type, {r('quantile_cont(x, 0.25)', 'q25')}, {r('quantile_cont(x, 0.5)', 'q50')}, {r('quantile_cont(x, 0.75)', 'q75')} FROM g WHERE isfinite(x) GROUP BY 1""", g=_GAPPY))
def box_null_group(spark, folder):
    return rounded(box_statistics(gappy_events(spark, folder).filter("not isnan(x) and abs(x) < 1e300"), ["event_type"], "x").select("event_type", "q25", "q50", "q75"))
