"""Queries: windows, grids, features, targets and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.operators import features as ft
from tideframe.operators import splits as sp
from tideframe.panel import Running, framed, keep_one, running
from tideframe.plans import views as v
from tideframe.plans.catalogue import query, r, rounded
from tideframe.plans.views import EVENTS, MONTHLY, SPEC, sql_with

W = "WINDOW w AS (PARTITION BY series ORDER BY date)"
WE = "WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"


@query("first_diff", sql_with(
    f"SELECT series, date, {r('y - lag(y) OVER w','d_y')}, n - lag(n) OVER w AS d_n FROM daily_region {W}", "daily_region"))
def first_diff(spark, folder):
    return rounded(framed(v.daily_region(spark, folder), SPEC, ft.difference("y", "n")).select("series", "date", "d_y", "d_n"))


@query("first_diff_long_series", sql_with(f"SELECT event_type, event_id, {r('x - lag(x) OVER w','d_x')} FROM ev {WE}", "ev"))
def first_diff_long_series(spark, folder):
    """Rows per event type have no bound, so the window runs in blocks."""
    return rounded(framed(v.events(spark, folder), EVENTS, ft.difference("x")).select("event_type", "event_id", "d_x"))


@query("lags", sql_with("SELECT series, date, " + ", ".join(
    r(f"lag(y,{k}) OVER w", f"y_lag{k}") for k in (1, 2, 5, 20)) + f" FROM daily_region {W}", "daily_region"))
def lags(spark, folder):
    return rounded(framed(v.daily_region(spark, folder), SPEC, ft.lagged(["y"], [1, 2, 5, 20])).drop("y", "n"))


@query("lags_long_series", sql_with("SELECT event_type, event_id, " + ", ".join(
    r(f"lag(x,{k}) OVER w", f"x_lag{k}") for k in (1, 5)) + f" FROM ev {WE}", "ev"))
def lags_long_series(spark, folder):
    out = framed(v.events(spark, folder), EVENTS, ft.lagged(["x"], [1, 5]))
    return rounded(out.drop("ts", "x"))


def _rolling_sql(src, keys, col, part, fn, stem):
    cols = []
    for n in (5, 20):
        frame = f"({part} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        cols.append(r(f"CASE WHEN count({col}) OVER {frame} = {n} THEN {fn}({col}) OVER {frame} END", f"{stem}_{n}"))
    return f"SELECT {keys}, {', '.join(cols)} FROM {src}"


_PART = "PARTITION BY series ORDER BY date"
_EPART = "PARTITION BY event_type ORDER BY ts, event_id"


@query("rolling_std", sql_with(_rolling_sql("daily_region", "series, date", "y", _PART, "stddev_samp", "vol"), "daily_region"))
def rolling_std(spark, folder):
    items = [ft.rolling("y", n, "std", f"vol_{n}") for n in (5, 20)]
    return rounded(framed(v.daily_region(spark, folder), SPEC, *items).drop("y", "n"))


@query("rolling_sum", sql_with(_rolling_sql("daily_region", "series, date", "y", _PART, "sum", "mom"), "daily_region"))
def rolling_sum(spark, folder):
    items = [ft.rolling("y", n, "sum", f"mom_{n}") for n in (5, 20)]
    return rounded(framed(v.daily_region(spark, folder), SPEC, *items).drop("y", "n"))


@query("rolling_std_long_series", sql_with(_rolling_sql("ev", "event_type, event_id", "x", _EPART, "stddev_samp", "vol"), "ev"))
def rolling_std_long_series(spark, folder):
    items = [ft.rolling("x", n, "std", f"vol_{n}") for n in (5, 20)]
    return rounded(framed(v.events(spark, folder), EVENTS, *items).drop("ts", "x"))


@query("observed_volatility", sql_with(
    "SELECT series, date, " + ", ".join(r(
        f"CASE WHEN count(d) OVER (w ROWS BETWEEN {n-1} PRECEDING AND CURRENT ROW) = {n} THEN "
        f"stddev_samp(d) OVER (w ROWS BETWEEN {n-1} PRECEDING AND CURRENT ROW) END", f"vol_{n}") for n in (20, 60)
    ).replace("(w ROWS", f"({_PART} ROWS") + " FROM obs",
    "daily_region", obs=f"SELECT * FROM (SELECT series, date, y - lag(y) OVER w AS d FROM daily_region {W}) WHERE d IS NOT NULL"))
def observed_volatility(spark, folder):
    d = framed(v.daily_region(spark, folder), SPEC, ft.difference("y", prefix="d"))
    return rounded(ft.observed_volatility(d, SPEC, "dy", (20, 60)).select("series", "date", "vol_20", "vol_60"))


@query("ffill_limit2", sql_with(
    f"SELECT series, date, {r('last_value(y IGNORE NULLS) OVER (' + _PART + ' ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 'y')} FROM grid",
    "daily_nation", grid="""
SELECT g.series, CAST(g.date AS DATE) AS date, y FROM
 (SELECT series, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS date FROM daily_nation GROUP BY 1) g
 LEFT JOIN daily_nation d ON d.series=g.series AND d.date=g.date"""))
def ffill_limit2(spark, folder):
    dense = ft.densify(v.daily_nation(spark, folder).drop("n"), SPEC)
    return rounded(framed(dense, SPEC, ft.bounded_fill(["y"], 2)))


@query("ffill_unbounded", sql_with(f"""
SELECT event_type, event_id, {r('last_value(s IGNORE NULLS) OVER (' + _EPART + ' ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'filled')}
FROM (SELECT *, CASE WHEN x > 2.5 THEN x END AS s FROM ev)""", "ev"))
def ffill_unbounded(spark, folder):
    sparse = v.events(spark, folder).withColumn("s", F.when(F.col("x") > 2.5, F.col("x")))
    return rounded(running(sparse, EVENTS, Running("last", "s", "filled")).select("event_type", "event_id", "filled"))


@query("expanding_mean", sql_with(
    f"SELECT series, date, {r('avg(d) OVER (' + _PART + ' ROWS UNBOUNDED PRECEDING)', 'mean_d')} FROM "
    f"(SELECT series, date, y - lag(y) OVER w AS d FROM daily_region {W})", "daily_region"))
def expanding_mean(spark, folder):
    d = framed(v.daily_region(spark, folder), SPEC, ft.difference("y"))
    return rounded(running(d, SPEC, Running("mean", "d_y", "mean_d")).select("series", "date", "mean_d"))


@query("expanding_mean_long_series",
       sql_with(f"SELECT event_type, event_id, {r('avg(x) OVER (' + _EPART + ' ROWS UNBOUNDED PRECEDING)', 'mean_x')} FROM ev", "ev"))
def expanding_mean_long_series(spark, folder):
    out = running(v.events(spark, folder), EVENTS, Running("mean", "x", "mean_x"))
    return rounded(out.select("event_type", "event_id", "mean_x"))


@query("running_sum", sql_with(f"""
SELECT event_type, event_id, {r('sum(x) OVER (' + _EPART + ' ROWS UNBOUNDED PRECEDING)', 'total', 4)},
 row_number() OVER ({_EPART}) AS n_seen FROM ev""", "ev"))
def running_sum(spark, folder):
    items = [Running("sum", "x", "total"), Running("count", "x", "n_seen")]
    return rounded(running(v.events(spark, folder), EVENTS, *items).select("event_type", "event_id", "total", "n_seen"), 4)


@query("forward_target", sql_with("SELECT series, date, " + ", ".join(
    r(f"CASE WHEN count(d) OVER ({_PART} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN "
      f"sum(d) OVER ({_PART} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END", f"target_h{h}")
    + ", " + r(f"lead(y,{h}) OVER ({_PART})", f"level_h{h}") for h in (1, 5, 20))
    + f" FROM (SELECT series, date, y, y - lag(y) OVER w AS d FROM daily_region {W})", "daily_region"))
def forward_target(spark, folder):
    d = framed(v.daily_region(spark, folder), SPEC, ft.difference("y"))
    out = framed(d, SPEC, ft.forward_sum("d_y", (1, 5, 20)), ft.forward_value("y", (1, 5, 20), "level_h"))
    return rounded(out.drop("y", "n", "d_y"))


@query("trim_edges", sql_with(
    "SELECT series, date, " + r("y", "y") + " FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS i, "
    "count(*) OVER (PARTITION BY series) AS c FROM daily_region) WHERE i > 20 AND i <= c - 20", "daily_region"))
def trim_edges(spark, folder):
    return rounded(ft.trim_edges(v.daily_region(spark, folder), SPEC, 20, 20).select("series", "date", "y"))


@query("sequence_windows", sql_with(
    "SELECT series, date, len(win) AS rows_seen, " + r("win[1]", "oldest_y") + ", " + r("win[10]", "newest_y") + ", "
    + r("list_sum(win)", "sum_y") + f" FROM (SELECT series, date, list(y) OVER ({_PART} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS win "
    "FROM daily_region) WHERE len(win) = 10", "daily_region"))
def sequence_windows(spark, folder):
    out = framed(v.daily_region(spark, folder), SPEC, ft.sequence_window(["y", "n"], 10)).filter("window is not null")
    total = F.aggregate("window", F.lit(0.0), lambda acc, row: acc + row[0])
    return rounded(out.select(
        "series", "date", F.size("window").cast("long").alias("rows_seen"), F.col("window")[0][0].alias("oldest_y"),
        F.col("window")[9][0].alias("newest_y"), total.alias("sum_y")))


@query("lag_block", sql_with(
    "SELECT series, date, " + ", ".join(r(f"lag(d,{k}) OVER ({_PART})", f"b{2 - k}") if k else r("d", "b2") for k in (2, 1, 0))
    + f", i FROM (SELECT *, row_number() OVER ({_PART}) AS i FROM (SELECT series, date, y - lag(y) OVER w AS d FROM daily_region {W})) QUALIFY i >= 4",
    "daily_region"))
def lag_block(spark, folder):
    d = framed(v.daily_region(spark, folder), SPEC, ft.difference("y"))
    out = framed(sp.with_position(d, SPEC, "i"), SPEC, ft.lag_block(["d_y"], 3)).filter("block is not null")
    return rounded(out.select("series", "date", "i", *[F.col("block")[k].alias(f"b{k}") for k in range(3)]))


@query("densify_month", sql_with(f"""
SELECT g.series, CAST(g.month AS DATE) AS month, {r('v','v')} FROM
 (SELECT series, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM monthly_cell GROUP BY 1) g
 LEFT JOIN monthly_cell m ON m.series=g.series AND m.month=g.month""", "monthly_cell"))
def densify_month(spark, folder):
    return rounded(ft.densify(v.monthly_cell(spark, folder).drop("release_date"), MONTHLY, "month"))


@query("missing_months", sql_with("""
SELECT g.series, CAST(g.month AS DATE) AS month FROM
 (SELECT series, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM monthly_cell GROUP BY 1) g
 WHERE NOT EXISTS (SELECT 1 FROM monthly_cell m WHERE m.series=g.series AND m.month=g.month)""", "monthly_cell"))
def missing_months(spark, folder):
    return ft.missing_periods(v.monthly_cell(spark, folder), MONTHLY, "month")


@query("yoy_on_grid", sql_with(f"""
SELECT a.series, a.month, {r('(a.v/b.v - 1)*100','yoy')} FROM monthly_cell a
LEFT JOIN monthly_cell b ON b.series=a.series AND b.month = a.month - INTERVAL 12 MONTH""", "monthly_cell"))
def yoy_on_grid(spark, folder):
    out = ft.year_over_year(v.monthly_cell(spark, folder), MONTHLY, "v", "yoy")
    return rounded(out.select("series", "month", "yoy"))


@query("dedupe_keep_first", """
SELECT event_type, user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS i FROM events) WHERE i=1""")
def dedupe_keep_first(spark, folder):
    e = v.table(spark, folder, "events").select("event_type", "user_id", "event_id", "ts")
    return keep_one(e, ["event_type", "user_id"], [F.col("ts"), F.col("event_id")], "first")


@query("dedupe_keep_last", """
SELECT event_type, user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i=1""")
def dedupe_keep_last(spark, folder):
    e = v.table(spark, folder, "events").select("event_type", "user_id", "event_id", "ts")
    return keep_one(e, ["event_type", "user_id"], [F.col("ts"), F.col("event_id")], "last")


_NUM = "SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS rn, count(*) OVER (PARTITION BY series) AS n_rows FROM daily_region"


@query("origin_grid", sql_with(
    "SELECT series, date, rn, n_rows FROM num WHERE rn >= 100 AND (rn-100) % 5 = 0 AND rn < n_rows - 20", "daily_region", num=_NUM))
def origin_grid(spark, folder):
    out = sp.origin_grid(v.daily_region(spark, folder), SPEC, v.MIN_TRAIN, v.STEP, v.MAX_H)
    return out.select("series", "date", "rn", "n_rows")


@query("rolling_folds", sql_with(
    "SELECT series, date, rn, CASE WHEN rn > 100 THEN least((rn-1-100) // ((n_rows-100)//5), 4) END AS fold FROM num", "daily_region", num=_NUM))
def rolling_folds(spark, folder):
    return sp.rolling_folds(v.daily_region(spark, folder), SPEC, 100, 5).select("series", "date", "rn", "fold")


_BOUNDS = """SELECT series, f.fold, n_rows, 100 + f.fold*((n_rows-100)//5) AS te,
 CASE WHEN f.fold=4 THEN n_rows ELSE 100 + (f.fold+1)*((n_rows-100)//5) END AS stop, h.h AS horizon
 FROM (SELECT series, count(*) AS n_rows FROM daily_region GROUP BY 1), (SELECT unnest(range(5)) AS fold) f, (SELECT unnest([1,5,20]) AS h) h"""
_CUTS = "SELECT *, te-horizon AS tr, greatest(CAST(floor((te-horizon)*0.15) AS BIGINT),20) AS cal FROM bounds"
_ROLES = """SELECT n.series, n.date, n.rn, fold, horizon, CASE WHEN rn-1 >= te THEN 'test' WHEN rn-1 >= tr THEN 'embargo'
 WHEN rn-1 >= tr-cal THEN 'calibration' WHEN rn-1 >= tr-cal-horizon THEN 'gap' ELSE 'fit' END AS role
 FROM num n JOIN cuts c ON n.series=c.series WHERE rn-1 < stop"""


def roles(spark, folder):
    panel = v.daily_region(spark, folder)
    return sp.embargo_roles(panel, SPEC, sp.fold_bounds(panel, SPEC, 100, 5), (1, 5, 20))


@query("embargo_roles", sql_with("SELECT series, date, fold, horizon, role FROM roles", "daily_region", num=_NUM, bounds=_BOUNDS, cuts=_CUTS, roles=_ROLES))
def embargo_roles(spark, folder):
    return roles(spark, folder).select("series", "date", "fold", "horizon", "role")


@query("leakage_contract", sql_with("""
SELECT series, fold, horizon, max(rn+horizon) FILTER (role IN ('fit','calibration')) AS last_train_target,
 min(rn) FILTER (role='test') AS first_test_row,
 max(rn+horizon) FILTER (role IN ('fit','calibration')) < min(rn) FILTER (role='test') AS leak_free
FROM roles GROUP BY 1,2,3""", "daily_region", num=_NUM, bounds=_BOUNDS, cuts=_CUTS, roles=_ROLES))
def leakage_contract(spark, folder):
    return sp.leakage_report(roles(spark, folder), ["series", "fold", "horizon"])


@query("partition_log", sql_with("""
SELECT series, fold, horizon, role, min(rn) AS first_row, max(rn) AS last_row, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date
FROM roles GROUP BY 1,2,3,4""", "daily_region", num=_NUM, bounds=_BOUNDS, cuts=_CUTS, roles=_ROLES))
def partition_log(spark, folder):
    return sp.partition_log(roles(spark, folder), ["series", "fold", "horizon"])


@query("search_roles", sql_with("""
SELECT series, horizon, role, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM (
 SELECT series, date, horizon, CASE WHEN rn-1 < inner_end THEN 'inner_train' WHEN rn-1 < inner_end+horizon THEN 'gap' WHEN rn-1 < fit_end THEN 'inner_val'
  WHEN rn-1 < fit_end+horizon THEN 'gap' WHEN rn-1 < tr THEN 'calibration' ELSE 'embargo' END AS role FROM (
  SELECT *, fit_end - greatest(CAST(floor(fit_end*0.15) AS BIGINT),20) - horizon AS inner_end FROM (
   SELECT *, tr - greatest(CAST(floor(tr*0.15) AS BIGINT),20) - horizon AS fit_end FROM (
    SELECT series, date, rn, horizon, 200-horizon AS tr FROM num, (SELECT unnest([1,5,20]) AS horizon) WHERE rn <= 200)))) GROUP BY 1,2,3""",
    "daily_region", num=_NUM))
def search_roles(spark, folder):
    out = sp.search_roles(v.daily_region(spark, folder), SPEC, 200, (1, 5, 20))
    return sp.partition_log(out, ["series", "horizon"]).select("series", "horizon", "role", "n_rows", "first_date", "last_date")
