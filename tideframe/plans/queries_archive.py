"""Queries: contracts, snapshots, archive, release mapping, manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.operators import archive as ar
from tideframe.operators import contracts as ct
from tideframe.panel import PanelSpec
from tideframe.plans import views as v
from tideframe.plans.catalogue import query, r, rounded
from tideframe.plans.views import sql_with
from tideframe.session import fresh_path
from tideframe.sources import snapshots as sn
from tideframe.sources import tables as tb
from tideframe.streaming import archive_stream as st

KEYS = ["series", "reference_month"]
LIMIT = 60.0
# Three pulls. Each knows the orders of more states and a later range of months.
PULLS = (
    ("20000101_060000", ("F",), "1995-01-01", "1998-12-31"),
    ("20010101_060000", ("F", "O"), "1996-01-01", "2000-12-31"),
    ("20020101_060000", ("F", "O", "P"), "1996-07-01", "2001-12-31"),
)


def pulls(spark, folder):
    """Monthly index per nation as three snapshots saw it: later pulls revise and drop old months."""
    orders = v.table(spark, folder, "orders")
    located = orders.join(v.table(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    located = located.join(v.table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    month = F.trunc(F.to_date("o_orderdate"), "month")
    saw = [
        F.when(F.col("o_orderstatus").isin(*states) & month.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), F.lit(stamp))
        for stamp, states, lo, hi in PULLS]
    rows = located.select(F.col("n_name").alias("series"), month.alias("reference_month"), F.col("o_totalprice").alias("price"), F.explode(F.array_compact(F.array(*saw))).alias("source_pull"))
    return rows.groupBy(*KEYS, "source_pull").agg((F.exp(F.avg(F.ln("price"))) / 1000.0).alias("value"))


_PULLS = " UNION ALL ".join(
    f"""SELECT n_name AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS reference_month, '{stamp}' AS source_pull, exp(avg(ln(o_totalprice)))/1000.0 AS value
 FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
 WHERE o_orderstatus IN ({', '.join(repr(s) for s in states)}) AND date_trunc('month', o_orderdate) BETWEEN DATE '{lo}' AND DATE '{hi}' GROUP BY 1,2"""
    for stamp, states, lo, hi in PULLS)


@query("archive_rebuild", sql_with(f"SELECT series, reference_month, {r('arg_max(value, source_pull)','value')}, max(source_pull) AS source_pull FROM p GROUP BY 1,2", p=_PULLS))
def archive_rebuild(spark, folder):
    return rounded(ar.rebuild(pulls(spark, folder), KEYS))


@query("archive_merge", sql_with(f"""
SELECT series, reference_month, {r("arg_max(value, source_pull)",'value')}, max(source_pull) AS source_pull FROM p WHERE source_pull <= '{PULLS[1][0]}' GROUP BY 1,2""", p=_PULLS))
def archive_merge(spark, folder):
    both = pulls(spark, folder)
    old, new = (both.filter(F.col("source_pull") == PULLS[i][0]) for i in (0, 1))
    return rounded(ar.merge(old, new, KEYS))


@query("revision_log", sql_with(f"""
SELECT series, reference_month, pull_old, pull_new, {r('value_old','value_old')}, {r('value_new','value_new')}, {r('value_new-value_old','change')}, abs(value_new-value_old) > {LIMIT} AS rejected FROM (
 SELECT series, reference_month, source_pull AS pull_new, value AS value_new, lag(value) OVER w AS value_old, lag(source_pull) OVER w AS pull_old FROM p WINDOW w AS (PARTITION BY series, reference_month ORDER BY source_pull))
WHERE abs(value_new-value_old) > 1e-9""", p=_PULLS))
def revision_log(spark, folder):
    return rounded(ar.revision_log(pulls(spark, folder), KEYS, LIMIT))


@query("revision_overlap", sql_with(f"""
SELECT a.series, a.reference_month, {r('a.value','value_old')}, {r('b.value','value_new')}, {r('b.value-a.value','change')} FROM p a JOIN p b USING (series, reference_month)
WHERE a.source_pull='{PULLS[0][0]}' AND b.source_pull='{PULLS[1][0]}' AND abs(b.value-a.value) > 1e-9""", p=_PULLS))
def revision_overlap(spark, folder):
    both = pulls(spark, folder)
    old, new = (both.filter(F.col("source_pull") == PULLS[i][0]) for i in (0, 1))
    return rounded(ar.revisions(old, new, KEYS).drop("pull_old", "pull_new"))


def _land(spark, folder):
    root = fresh_path(spark, "pulls")
    rows = pulls(spark, folder).select("series", F.col("reference_month").cast("string").alias("reference_month"), "value", F.lit("index").alias("source"), F.col("source_pull").alias("ingest_ts"))
    sn.land(rows, root, "source", "series", "ingest_ts")
    return root


_LANDED = "value DOUBLE, reference_month STRING"


@query("snapshot_latest", sql_with(f"""
SELECT p.series, reference_month, {r('value','value')} FROM p JOIN (SELECT series, max(source_pull) AS s FROM p GROUP BY 1) m ON p.series=m.series AND p.source_pull=m.s""", p=_PULLS))
def snapshot_latest(spark, folder):
    """Land the pulls as JSON, read them back, keep the newest pull per series by the time in its path."""
    raw = sn.read_snapshots(spark, _land(spark, folder), _LANDED + ", source STRING, series STRING, ingest_ts STRING")
    newest = sn.newest_by_stamp(raw, ["series"])
    return rounded(newest.select("series", F.col("reference_month").cast("date").alias("reference_month"), "value"))


# Each pull against the accepted ones before it, as a whole.
_GUARDED = {
    "a1": f"SELECT * FROM p WHERE source_pull='{PULLS[0][0]}'",
    "n2": f"SELECT count(*) AS n FROM p JOIN a1 USING (series, reference_month) WHERE p.source_pull='{PULLS[1][0]}' AND abs(p.value-a1.value) > {LIMIT}",
    "a2": f"SELECT * FROM a1 UNION ALL SELECT * FROM p WHERE source_pull='{PULLS[1][0]}' AND (SELECT n FROM n2) = 0",
    "l2": "SELECT series, reference_month, arg_max(value, source_pull) AS value FROM a2 GROUP BY 1,2",
    "n3": f"SELECT count(*) AS n FROM p JOIN l2 USING (series, reference_month) WHERE p.source_pull='{PULLS[2][0]}' AND abs(p.value-l2.value) > {LIMIT}",
    "a3": f"SELECT * FROM a2 UNION ALL SELECT * FROM p WHERE source_pull='{PULLS[2][0]}' AND (SELECT n FROM n3) = 0",
}


@query("archive_stream", sql_with(f"SELECT series, reference_month, {r('arg_max(value, source_pull)','value')}, max(source_pull) AS source_pull FROM a3 GROUP BY 1,2", p=_PULLS, **_GUARDED))
def archive_stream(spark, folder):
    """The landed pulls as a file stream folded into the archive under the revision guard."""
    landed, root = _land(spark, folder), fresh_path(spark, "archive")
    stream = st.read_pulls(spark, landed, _LANDED + ", source STRING, series STRING, ingest_ts STRING")
    series = F.regexp_extract(F.col("_metadata.file_path"), "series=([^/]+)/", 1)
    rows = stream.select(series.alias("series"), F.col("reference_month").cast("date").alias("reference_month"), "value", "source_pull")
    st.run_archive_stream(spark, rows, root, KEYS, limit=LIMIT).awaitTermination()
    return rounded(st.latest_archive(spark, root, KEYS))


@query("archive_contracts", sql_with("""
SELECT series, 'no_null_key' AS "check", count(*) AS n_rows, count(*) FILTER (NOT coalesce(reference_month IS NOT NULL, false)) AS n_bad, true AS passed FROM p GROUP BY 1
UNION ALL SELECT series, 'positive', count(*), count(*) FILTER (NOT coalesce(value > 0, false)), count(*) FILTER (NOT coalesce(value > 0, false)) = 0 FROM p GROUP BY 1
UNION ALL SELECT series, 'known_after_valid', count(*), count(*) FILTER (strptime(substr(source_pull,1,8), '%Y%m%d') <= reference_month + INTERVAL 40 DAY), count(*) FILTER (strptime(substr(source_pull,1,8), '%Y%m%d') <= reference_month + INTERVAL 40 DAY) = 0 FROM p GROUP BY 1""", p=_PULLS))
def archive_contracts(spark, folder):
    pulled = F.to_date(F.substring("source_pull", 1, 8), "yyyyMMdd")
    return ct.check_table(pulls(spark, folder), {
        "no_null_key": F.col("reference_month").isNotNull(), "positive": F.col("value") > 0,
        "known_after_valid": pulled > F.date_add("reference_month", 40)}, ["series"])


@query("unique_key_contract", "SELECT event_type, user_id, count(*) AS n_rows FROM events GROUP BY 1,2 HAVING count(*) > 1")
def unique_key_contract(spark, folder):
    return ct.duplicate_keys(v.table(spark, folder, "events"), ["event_type", "user_id"])


@query("order_contract", "SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE value <= b")
def order_contract(spark, folder):
    e = v.table(spark, folder, "events").select("user_id", "event_id", "value")
    spec = PanelSpec(keys=("user_id",), time="event_id", grain=1_000_000, block_rows=1000)
    return ct.out_of_order(e, spec, "value").select("event_id")


@query("knowledge_after_valid_contract", sql_with("""
SELECT series, month, release_date FROM (SELECT series, month, CASE WHEN EXTRACT(month FROM month) = 2 THEN month ELSE release_date END AS release_date FROM monthly_cell) WHERE release_date <= month""", "monthly_cell"))
def knowledge_after_valid_contract(spark, folder):
    m = v.monthly_cell(spark, folder).select("series", "month", F.when(F.month("month") == 2, F.col("month")).otherwise(F.col("release_date")).alias("release_date"))
    return ct.known_too_early(m, "release_date", "month")


@query("allow_list_contract", sql_with("""
SELECT series, month FROM monthly_cell c WHERE NOT EXISTS (SELECT 1 FROM monthly_cell m WHERE m.series=c.series AND m.month = c.month - INTERVAL 1 MONTH)
 AND month <> DATE '1995-01-01'""", "monthly_cell"))
def allow_list_contract(spark, folder):
    """Months without the month before them, except the first of the calendar, which the list allows."""
    m = v.monthly_cell(spark, folder).select("series", "month")
    previous = m.select("series", F.add_months("month", 1).alias("month"))
    allowed = m.filter(F.col("month") == F.lit("1995-01-01").cast("date"))
    return ct.unmapped(m, previous, ["series", "month"], allowed)


@query("mapping_coverage", sql_with("""
SELECT series, max(month) AS latest_mapped, strftime(max(month), '%Y-%m') >= '2001-07' AS covers_request FROM monthly_cell GROUP BY 1""", "monthly_cell"))
def mapping_coverage(spark, folder):
    m = v.monthly_cell(spark, folder).withColumnRenamed("month", "reference_month")
    return ct.mapping_coverage(m, "2001-07-31", ["series"])


@query("priority_union", sql_with("""
SELECT series, reference_month, arg_min(value, priority) AS value, min(priority) AS priority FROM (
 SELECT series, reference_month, round(value,6)+0.0 AS value, CASE source_pull WHEN '20020101_060000' THEN 0 WHEN '20010101_060000' THEN 1 ELSE 2 END AS priority FROM p) GROUP BY 1,2""", p=_PULLS))
def priority_union(spark, folder):
    all_pulls = pulls(spark, folder)
    frames = [all_pulls.filter(F.col("source_pull") == s).select(*KEYS, "value") for s in (PULLS[2][0], PULLS[1][0], PULLS[0][0])]
    return rounded(ar.prioritised_union(frames, KEYS))


@query("union_distinct_newest", sql_with(f"SELECT series, reference_month, {r('arg_max(value, source_pull)','value')} FROM p GROUP BY 1,2", p=_PULLS))
def union_distinct_newest(spark, folder):
    return rounded(ar.rebuild(pulls(spark, folder), KEYS).drop("source_pull"))


@query("set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, folder):
    """Documents that nobody labelled."""
    return v.table(spark, folder, "documents").select("doc_id").distinct().join(v.table(spark, folder, "labels").select("doc_id"), "doc_id", "left_anti")


@query("set_intersection", sql_with("SELECT DISTINCT series, date FROM daily_region INTERSECT SELECT DISTINCT series, date FROM daily_supply", "daily_region", "daily_supply"))
def set_intersection(spark, folder):
    return v.daily_region(spark, folder).select("series", "date").intersect(v.daily_supply(spark, folder).select("series", "date"))


@query("union_all_frames", sql_with(f"SELECT series, date, {r('y','y')}, n FROM daily_region UNION ALL SELECT series, date, {r('y','y')}, CAST(NULL AS BIGINT) FROM daily_ship", "daily_region", "daily_ship"))
def union_all_frames(spark, folder):
    return rounded(v.daily_region(spark, folder).unionByName(v.daily_ship(spark, folder).drop("q"), allowMissingColumns=True))


@query("mapping_range", sql_with("SELECT series, month FROM monthly_cell WHERE month BETWEEN DATE '1996-01-01' AND greatest(DATE '1999-12-31', (SELECT max(month) FROM monthly_cell))", "monthly_cell"))
def mapping_range(spark, folder):
    """Write the mapping with an early end; months already known beyond it stay."""
    path = fresh_path(spark, "mapping")
    tb.write_mapping(v.monthly_cell(spark, folder).select("series", F.col("month").alias("reference_month")), path, "1996-01-01", "1999-12-31")
    return spark.read.parquet(path).select("series", F.col("reference_month").alias("month"))


@query("source_report", """
SELECT source, CASE WHEN n_bad = 0 THEN 'success' WHEN source = 'orders' THEN 'failed' ELSE 'warning' END AS status FROM (
 SELECT 'orders' AS source, count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) AS n_bad FROM orders UNION ALL
 SELECT 'events', count(*) FILTER (NOT coalesce(value > 0.5, false)) FROM events UNION ALL
 SELECT 'lineitem', count(*) FILTER (NOT coalesce(l_quantity > 0, false)) FROM lineitem)""")
def source_report(spark, folder):
    """Live checks per source with looser checks of the fallback; status by rule."""
    def checked(name, condition):
        return ct.check_table(v.table(spark, folder, name), {"valid": condition}).withColumn("source", F.lit(name))

    live = checked("orders", F.col("o_totalprice") > 0).unionByName(checked("events", F.col("value") > 0.5)).unionByName(checked("lineitem", F.col("l_quantity") > 0))
    cached = checked("events", F.col("value").isNotNull()).unionByName(checked("lineitem", F.col("l_quantity").isNotNull()))
    return ct.source_status(live, cached)


_DATED = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


@query("table_facts", " UNION ALL ".join(f"SELECT '{n}' AS input, count(*) AS n_rows, CAST(min({t}) AS DATE) AS first_date, CAST(max({t}) AS DATE) AS last_date FROM {n}" for n, t in _DATED.items()))
def table_facts(spark, folder):
    """Rows and dates of the inputs that a manifest lists."""
    return tb.table_facts({n: (v.table(spark, folder, n), t) for n, t in _DATED.items()})


@query("manifest")
def manifest(spark, folder):
    names = _DATED
    out = tb.manifest(spark, {n: f"{folder}/{n}.parquet" for n in names}, {n: (v.table(spark, folder, n), t) for n, t in names.items()})
    return out.drop("path")


@query("silver_index", sql_with(f"""
SELECT a.series, a.reference_month, {r('a.value','value')}, m.release_date FROM (SELECT series, reference_month, arg_max(value, source_pull) AS value FROM p GROUP BY 1,2) a
LEFT JOIN (SELECT n_name AS series, CAST(date_trunc('month', date) AS DATE) AS reference_month, CAST(date_trunc('month', date) + INTERVAL 1 MONTH + INTERVAL 19 DAY AS DATE) AS release_date FROM located
 WHERE c_mktsegment = 'BUILDING' GROUP BY ALL) m ON m.series=a.series AND m.reference_month=a.reference_month
WHERE a.reference_month BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""", "located", p=_PULLS))
def silver_index(spark, folder):
    """Rebuilt archive in a window, with release dates known for months in which one segment ordered."""
    from tideframe.plans.silver import build_silver

    known = v.located_orders(spark, folder).filter("c_mktsegment = 'BUILDING'").select(F.col("n_name").alias("series"), F.trunc("date", "month").alias("reference_month")).distinct()
    mapping = known.withColumn("release_date", F.date_add(F.add_months("reference_month", 1), 19))
    out = build_silver(ar.rebuild(pulls(spark, folder), KEYS), mapping, KEYS, "1996-01-01", "2000-12-31")
    return rounded(out.select("series", "reference_month", "value", "release_date"))


@query("silver_contracts", sql_with("""
SELECT 'key_present' AS "check", count(*) AS n_rows, 0 AS n_bad, true AS passed FROM s UNION ALL SELECT 'value_present', count(*), 0, true FROM s UNION ALL
SELECT 'known_after_valid', count(*), 0, true FROM s UNION ALL
SELECT 'mapped_or_allowed', count(*), count(*) FILTER (release_date IS NULL AND reference_month >= DATE '1997-01-01'), count(*) FILTER (release_date IS NULL AND reference_month >= DATE '1997-01-01') = 0 FROM s""",
    "located", p=_PULLS, s="""SELECT a.series, a.reference_month, m.release_date FROM (SELECT DISTINCT series, reference_month FROM p WHERE reference_month BETWEEN DATE '1996-01-01' AND DATE '2000-12-31') a
LEFT JOIN (SELECT n_name AS series, CAST(date_trunc('month', date) AS DATE) AS reference_month, CAST(date_trunc('month', date) + INTERVAL 1 MONTH + INTERVAL 19 DAY AS DATE) AS release_date FROM located
 WHERE c_mktsegment = 'BUILDING' GROUP BY ALL) m ON m.series=a.series AND m.reference_month=a.reference_month"""))
def silver_contracts(spark, folder):
    """Months before 1997 may lack a release date; later ones count as broken."""
    from tideframe.plans.silver import contract_table

    silver = silver_index(spark, folder)
    allowed = silver.filter(F.col("reference_month") < F.lit("1997-01-01").cast("date")).select(*KEYS)
    return contract_table(silver, KEYS, allowed)
