"""Queries: filters, calendar joins, point-in-time joins and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.functions import scalars as sc
from tideframe.operators import align as al
from tideframe.operators import features as ft
from tideframe.panel import framed
from tideframe.plans import gold as gd
from tideframe.plans import views as v
from tideframe.plans.catalogue import query, r, rounded
from tideframe.plans.views import MONTHLY, SPEC, sql_with

_PART = "PARTITION BY series ORDER BY date"
BREAK = "1998-01-01"


@query("coerce_cast", """
SELECT doc_id, TRY_CAST(list_extract(string_split(text, ' '), 1) AS DOUBLE) AS first_number,
 TRY_CAST(CASE WHEN lang = 'fr' THEN lang ELSE CAST(n_chars AS VARCHAR) END AS DOUBLE) AS chars
FROM documents""")
def coerce_cast(spark, folder):
    d = v.table(spark, folder, "documents")
    mixed = F.when(F.col("lang") == "fr", F.col("lang")).otherwise(F.col("n_chars").cast("string"))
    first = F.split("text", " ")[0]
    return d.select("doc_id", sc.to_number(first).alias("first_number"), sc.to_number(mixed).alias("chars"))


@query("sentinel_null", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events""")
def sentinel_null(spark, folder):
    e = v.table(spark, folder, "events")
    raw = F.when(F.col("event_type") == "error", ".").otherwise(F.col("value").cast("string"))
    return e.select("event_id", sc.to_number(sc.sentinel_to_null(raw)).alias("value"))


@query("complete_cases", sql_with(f"SELECT series, date, {r('y','y')}, {r('s','s')}, {r('q','q')} FROM daily_region JOIN daily_supply USING (series, date)",
                                  "daily_region", "daily_supply"))
def complete_cases(spark, folder):
    both = al.outer_calendar(v.daily_region(spark, folder), v.daily_supply(spark, folder), SPEC)
    return rounded(both.na.drop("any").select("series", "date", "y", "s", "q"))


@query("range_clamp", sql_with(f"SELECT series, date, {r('y','y')} FROM daily_region WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'", "daily_region"))
def range_clamp(spark, folder):
    """The range is sent to the scan and checked again on the result."""
    d = v.daily_region(spark, folder, "1996-01-01", "1997-12-31")
    return rounded(ft.clamp(d, "date", "1996-01-01", "1997-12-31").select("series", "date", "y"))


@query("half_open_window", """
SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'""")
def half_open_window(spark, folder):
    """The last day counts in full although its stamps are intraday."""
    return ft.day_window(v.table(spark, folder, "events"), "ts", "2024-01-05", "2024-01-10").select("event_id", "event_type")


@query("series_splice", sql_with(f"""
SELECT series, date, {r("CASE WHEN date < DATE '1998-01-01' THEN y ELSE s END",'spliced')}, {r('y','y')}, {r('s','s')}
FROM daily_region FULL JOIN daily_supply USING (series, date)""", "daily_region", "daily_supply"))
def series_splice(spark, folder):
    both = al.outer_calendar(v.daily_region(spark, folder), v.daily_supply(spark, folder), SPEC)
    return rounded(al.splice(both, "date", BREAK, "y", "s", "spliced").select("series", "date", "spliced", "y", "s"))


@query("stitched_scan", sql_with(f"""
SELECT series, date, {r('y','value')} FROM daily_region WHERE date < DATE '1998-01-01'
UNION ALL SELECT series, date, {r('s','value')} FROM daily_supply WHERE date >= DATE '1998-01-01'""", "daily_region", "daily_supply"))
def stitched_scan(spark, folder):
    legacy = v.daily_region(spark, folder).select("series", "date", F.col("y").alias("value"))
    current = v.daily_supply(spark, folder).select("series", "date", F.col("s").alias("value"))
    return rounded(al.stitch(legacy, current, "date", BREAK))


@query("splice_transition", sql_with("""
SELECT series, CASE WHEN date < DATE '1998-01-01' THEN 'legacy' ELSE 'current' END AS side, count(*) AS n_rows
FROM daily_region WHERE date BETWEEN DATE '1997-12-01' AND DATE '1998-01-31' GROUP BY 1,2""", "daily_region"))
def splice_transition(spark, folder):
    d = v.daily_region(spark, folder, "1997-12-01", "1998-01-31")
    side = F.when(F.col("date") < F.lit(BREAK).cast("date"), "legacy").otherwise("current")
    return d.groupBy("series", side.alias("side")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("spread_inversions", sql_with(f"""
SELECT series, count(*) AS n_days, count(*) FILTER (sp < 0) AS n_inverted, count(*) FILTER (sign(sp) <> sign(prev)) AS n_crossings FROM (
 SELECT series, date, y - s AS sp, lag(y - s) OVER ({_PART}) AS prev FROM daily_region JOIN daily_supply USING (series, date)) GROUP BY 1""",
    "daily_region", "daily_supply"))
def spread_inversions(spark, folder):
    both = v.daily_region(spark, folder).join(v.daily_supply(spark, folder), ["series", "date"])
    sp = both.withColumn("sp", F.col("y") - F.col("s"))
    seen = sp.withColumn("prev", F.lag("sp").over(SPEC.window()))
    return seen.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if(F.col("sp") < 0).alias("n_inverted"),
        F.count_if(F.signum("sp") != F.signum("prev")).alias("n_crossings"))


@query("weekend_rows", "SELECT l_returnflag AS series, count(*) AS n_weekend FROM lineitem WHERE isodow(l_shipdate) >= 6 GROUP BY 1")
def weekend_rows(spark, folder):
    li = v.table(spark, folder, "lineitem").filter(F.weekday("l_shipdate") >= 5)
    return li.groupBy(F.col("l_returnflag").alias("series")).agg(F.count(F.lit(1)).alias("n_weekend"))


@query("calendar_full_outer", sql_with(f"""
SELECT series, date, {r('y','y')}, n, {r('s','s')}, {r('q','q')} FROM daily_region FULL JOIN daily_supply USING (series, date)""", "daily_region", "daily_supply"))
def calendar_full_outer(spark, folder):
    return rounded(al.outer_calendar(v.daily_region(spark, folder), v.daily_supply(spark, folder), SPEC))


@query("left_join_one_to_one", sql_with(f"""
SELECT series, date, {r('y','y')}, {r('s','s')} FROM daily_region LEFT JOIN daily_supply USING (series, date)""", "daily_region", "daily_supply"))
def left_join_one_to_one(spark, folder):
    left = v.daily_region(spark, folder).select("series", "date", "y")
    right = v.daily_supply(spark, folder).select("series", "date", "s")
    return rounded(al.join_one_to_one(left, right, ["series", "date"]))


@query("left_join_null_keys", sql_with(f"""
SELECT a.series, a.year, {r('a.y', 'y')}, {r('b.s', 's')} FROM (SELECT nullif(series, 'ASIA') AS series, nullif(year(date), 1995) AS year, sum(y) AS y FROM daily_region GROUP BY 1, 2) a
LEFT JOIN (SELECT nullif(series, 'ASIA') AS series, nullif(year(date), 1995) AS year, sum(s) AS s FROM daily_supply WHERE year(date) <> 1996 GROUP BY 1, 2) b
 ON a.series IS NOT DISTINCT FROM b.series AND a.year IS NOT DISTINCT FROM b.year""", "daily_region", "daily_supply"))
def left_join_null_keys(spark, folder):
    """Yearly sums where one region and one year have no name: their rows stay and meet each other."""
    keys = [F.nullif("series", F.lit("ASIA")).alias("series"), F.nullif(F.year("date"), F.lit(1995)).alias("year")]
    left = v.daily_region(spark, folder).groupBy(*keys).agg(F.sum("y").alias("y"))
    right = v.daily_supply(spark, folder).filter(F.year("date") != 1996).groupBy(*keys).agg(F.sum("s").alias("s"))
    return rounded(al.join_one_to_one(left, right, ["series", "year"]))


_WINDOWS = """SELECT l_suppkey, CASE WHEN l_linenumber = 7 AND l_tax < 0.03 THEN NULL ELSE l_shipdate END AS opens, CASE WHEN l_linenumber = 7 AND l_tax > 0.05 THEN NULL
 WHEN l_tax = 0 THEN l_shipdate - INTERVAL 1 DAY ELSE l_shipdate + to_days(CAST(l_quantity AS INTEGER)) END AS closes, l_quantity AS held FROM lineitem"""


@query("interval_join", sql_with(f"SELECT a.l_suppkey, count(*) AS n_held, {r('sum(b.held)', 'quantity')}, {r('sum(a.l_discount)', 'discount', 2)} FROM lineitem a JOIN windows b ON a.l_suppkey = b.l_suppkey AND (b.opens IS NULL OR a.l_shipdate >= b.opens) AND (b.closes IS NULL OR a.l_shipdate <= b.closes) "
                                "WHERE b.opens IS NULL OR b.closes IS NULL OR b.opens <= b.closes GROUP BY 1", windows=_WINDOWS))
def interval_join(spark, folder):
    """Line items against intervals from a table: overlapping, empty and open ones, per supplier."""
    li = v.table(spark, folder, "lineitem")
    day = F.col("l_shipdate")
    windows = li.select(
        "l_suppkey", F.when((F.col("l_linenumber") == 7) & (F.col("l_tax") < 0.03), F.lit(None)).otherwise(day).alias("opens"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_tax") > 0.05), F.lit(None)).when(F.col("l_tax") == 0, day - F.expr("INTERVAL 1 DAY")).otherwise(
            day + F.make_dt_interval(F.col("l_quantity").cast("int"))).alias("closes"), F.col("l_quantity").alias("held"))
    points = li.select("l_suppkey", "l_shipdate", "l_discount", "l_orderkey", "l_linenumber")
    met = al.interval_join(points, windows, ["l_suppkey"], "l_shipdate", "opens", "closes")
    out = met.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_held"), F.sum("held").alias("quantity"), F.sum("l_discount").alias("discount"))
    return rounded(out.withColumn("discount", F.round("discount", 2)))


_ASOF = """SELECT f.series, f.date, f.y, a.v FROM daily_region f ASOF LEFT JOIN {rel} a ON f.series=a.series AND f.date >= a.release_date"""
_FIRST = "SELECT m.* FROM monthly_region m JOIN (SELECT series, min(date) AS lo FROM daily_region GROUP BY 1) b ON m.series=b.series AND m.release_date >= b.lo"


@query("asof_release", sql_with(f"SELECT series, date, {r('y','y')}, {r('v','v')} FROM (" + _ASOF.format(rel="rel") + ")", "daily_region", "monthly_region", rel=_FIRST))
def asof_release(spark, folder):
    facts = v.daily_region(spark, folder).select("series", "date", "y")
    return rounded(al.asof_release(facts, v.monthly_region(spark, folder), SPEC, "release_date", ["v"], tie=["month"]))


@query("asof_release_carry_in", sql_with(
    f"SELECT series, date, {r('v','v')} FROM (SELECT f.series, f.date, a.v FROM late f ASOF LEFT JOIN monthly_region a ON f.series=a.series AND f.date >= a.release_date)",
    "daily_region", "monthly_region", late="SELECT * FROM daily_region WHERE date >= DATE '1997-01-01'"))
def asof_release_carry_in(spark, folder):
    facts = v.daily_region(spark, folder, first="1997-01-01").select("series", "date")
    return rounded(al.asof_release(facts, v.monthly_region(spark, folder), SPEC, "release_date", ["v"], tie=["month"], carry_in=True))


@query("asof_long_series", sql_with(f"""
SELECT event_id, {r('v','last_error_x')} FROM (SELECT f.event_id, a.x AS v FROM ev f ASOF LEFT JOIN
 (SELECT ts, max_by(x, event_id) AS x FROM ev WHERE event_type='error' GROUP BY 1) a ON f.ts >= a.ts WHERE f.event_type <> 'error')""", "ev"))
def asof_long_series(spark, folder):
    """Every other event sees the newest error before it: one series of all events, run in time blocks."""
    from tideframe.panel import PanelSpec

    whole = PanelSpec(keys=("feed",), time="ts", tie=("event_id",), grain="minute")
    e = v.events(spark, folder).withColumn("feed", F.lit("all"))
    facts = e.filter("event_type <> 'error'").select("feed", "ts", "event_id")
    errors = e.filter("event_type = 'error'").select("feed", F.col("ts").alias("known"), "event_id", F.col("x").alias("last_error_x"))
    out = al.asof_release(facts, errors, whole, "known", ["last_error_x"], tie=["event_id"], carry_in=True)
    return rounded(out.select("event_id", "last_error_x"))


_POS = "SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY date) AS p FROM daily_nation"


@query("target_date", sql_with("""
SELECT a.series, a.date AS origin_date, h.h AS horizon, b.date AS target_date FROM pos a, (SELECT unnest([1,5,20]) AS h) h
LEFT JOIN pos b ON b.series=a.series AND b.p = a.p + h.h""", "daily_nation", pos=_POS))
def target_date(spark, folder):
    days = v.daily_nation(spark, folder).select("series", "date")
    origins = days.select("series", F.col("date").alias("origin_date"), F.explode(F.array(*[F.lit(h) for h in (1, 5, 20)])).alias("horizon"))
    return al.attach_target_date(origins, days, SPEC).select("series", "origin_date", "horizon", "target_date")


_OTHERCAL = "SELECT DISTINCT series, date FROM daily_region JOIN daily_supply USING (series, date)"


@query("cross_calendar_join", sql_with("""
SELECT l.series, l.date AS origin_date, l.h AS horizon, l.target AS target_date, """ + r("l.y", "naive") + ", " + r("t.y", "actual") + """ FROM
 (SELECT a.series, a.date, h.h, a.y, b.date AS target FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS p FROM daily_region) a,
   (SELECT unnest([1,5]) AS h) h JOIN (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS p FROM daily_region) b ON b.series=a.series AND b.p=a.p+h.h) l
 JOIN (SELECT a.series, a.date, h.h, b.date AS target FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS p FROM oc) a,
   (SELECT unnest([1,5]) AS h) h JOIN (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS p FROM oc) b ON b.series=a.series AND b.p=a.p+h.h) r
 ON l.series=r.series AND l.date=r.date AND l.h=r.h AND l.target=r.target
 JOIN daily_region t ON t.series=l.series AND t.date=l.target""", "daily_region", "daily_supply", oc=_OTHERCAL))
def cross_calendar_join(spark, folder):
    """Two arms on different calendars: rows stay where both mean the same target day."""
    def arm(days, name):
        framed_days = framed(days, SPEC, ft.forward_value("y", (1, 5), "a"))
        cells = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"a{h}").alias("actual")) for h in (1, 5)]))
        rows = framed_days.select("series", F.col("date").alias("origin_date"), F.col("y").alias("naive"), F.col("y").alias(name), cells.alias("c"))
        return rows.select("series", "origin_date", F.col("c.horizon").alias("horizon"), F.col("c.actual").alias("actual"), "naive", name)

    full = v.daily_region(spark, folder).select("series", "date", "y")
    other = full.join(v.daily_supply(spark, folder).select("series", "date"), ["series", "date"])
    out = al.merge_by_target(arm(full, "arm_a"), "arm_a", full, arm(other, "arm_b"), "arm_b", other, SPEC)
    return rounded(out.select("series", "origin_date", "horizon", "target_date", "naive", "actual"))


def gold_frame(spark, folder, family="all"):
    return gd.build_gold(
        v.daily_region(spark, folder), v.daily_supply(spark, folder), v.monthly_region(spark, folder), SPEC,
        index="v", spreads={"spread_ys": ("y", "s")}, diffs=["y", "n", "s", "q"], family=family)


def _filled(c):
    return f"last_value({c} IGNORE NULLS) OVER ({_PART} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS {c}"


GOLD_SQL = dict(
    outer_days="SELECT series, date, y, n, s, q FROM daily_region FULL JOIN daily_supply USING (series, date)",
    filled=f"SELECT series, date, {', '.join(_filled(c) for c in 'ynsq')} FROM outer_days",
    yo="SELECT a.series, a.month, a.release_date, a.v, (a.v/b.v-1)*100 AS v_yoy FROM monthly_region a LEFT JOIN monthly_region b ON b.series=a.series AND b.month=a.month - INTERVAL 12 MONTH",
    rel="SELECT yo.* FROM yo JOIN (SELECT series, min(date) AS lo FROM filled GROUP BY 1) b ON yo.series=b.series AND yo.release_date >= b.lo",
    known="SELECT f.*, a.v FROM filled f ASOF LEFT JOIN rel a ON f.series=a.series AND f.date >= a.release_date",
    known2="SELECT f.*, a.v_yoy FROM known f ASOF LEFT JOIN (SELECT * FROM rel WHERE v_yoy IS NOT NULL) a ON f.series=a.series AND f.date >= a.release_date",
    diffed="SELECT *, y-s AS spread_ys, " + ", ".join(f"{c} - lag({c}) OVER ({_PART}) AS d_{c}" for c in ("y", "n", "s", "q", "v_yoy"))
           + f", (y-s) - lag(y-s) OVER ({_PART}) AS d_spread_ys FROM known2",
)
_GOLD_ALL = ["y", "s", "q", "v", "v_yoy", "spread_ys", "d_y", "d_s", "d_q", "d_v_yoy", "d_spread_ys"]
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in ["n", "d_n", *_GOLD_ALL])


@query("gold_build", sql_with("SELECT series, date, n, d_n, " + ", ".join(r(c, c) for c in _GOLD_ALL) + f" FROM diffed WHERE {_COMPLETE}",
                              "daily_region", "daily_supply", "monthly_region", **GOLD_SQL))
def gold_build(spark, folder):
    return rounded(gold_frame(spark, folder))


@query("gold_family_stationary", sql_with("SELECT series, date, d_n, " + ", ".join(r(c, c) for c in _GOLD_ALL if c.startswith("d_")) + f" FROM diffed WHERE {_COMPLETE}",
                                          "daily_region", "daily_supply", "monthly_region", **GOLD_SQL))
def gold_family_stationary(spark, folder):
    return rounded(gold_frame(spark, folder, "stationary"))


@query("tolerant_projection", "SELECT o_orderkey, o_totalprice AS value, CAST(NULL AS DOUBLE) AS absent FROM orders")
def tolerant_projection(spark, folder):
    have = gd.available(v.table(spark, folder, "orders"), ["o_orderkey", "o_totalprice", "not_there"])
    renamed = have.withColumnsRenamed({"o_totalprice": "value"})
    return renamed if "absent" in renamed.columns else renamed.withColumn("absent", F.lit(None).cast("double"))


@query("month_functions", """
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS following,
 strftime(o_orderdate, '%Y-%m') AS year_month FROM orders""")
def month_functions(spark, folder):
    o = v.table(spark, folder, "orders")
    m = sc.month_start(F.col("o_orderdate"))
    return o.select("o_orderkey", m.alias("month"), sc.next_month(m).alias("following"), sc.year_month(F.col("o_orderdate")).alias("year_month"))


@query("nulls_last_sort", sql_with("""
SELECT series, month, row_number() OVER (PARTITION BY series ORDER BY release_date ASC NULLS LAST, month) AS place FROM (
 SELECT series, month, CASE WHEN EXTRACT(month FROM month) <> 6 THEN release_date END AS release_date FROM monthly_region)""", "monthly_region"))
def nulls_last_sort(spark, folder):
    from pyspark.sql import Window

    known = v.monthly_region(spark, folder).withColumn("release_date", F.when(F.month("month") != 6, F.col("release_date")))
    w = Window.partitionBy("series").orderBy(F.col("release_date").asc_nulls_last(), "month")
    return known.select("series", "month", F.row_number().over(w).cast("long").alias("place"))
