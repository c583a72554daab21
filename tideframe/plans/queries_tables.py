"""Queries: choosing snapshots, swapping tables, reports, exports, the whole index job, rules of the archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.functions.scalars import safe_id
from tideframe.operators import archive as ar
from tideframe.operators import contracts as ct
from tideframe.operators.arms import reconstruct_levels
from tideframe.operators.diagnostics import require_i1
from tideframe.plans import views as v
from tideframe.plans.catalogue import query, r, rounded
from tideframe.plans.queries_archive import _PULLS, KEYS, LIMIT, PULLS, pulls
from tideframe.plans.silver import run_silver
from tideframe.plans.views import sql_with
from tideframe.session import fresh_path
from tideframe.sources import snapshots as sn
from tideframe.sources import tables as tb
from tideframe.sources import versions as vs


def _land_in_turn(spark, folder):
    """The three pulls written one after the other, one file per series, so later pulls have later file times."""
    root = fresh_path(spark, "turns")
    rows = pulls(spark, folder).select("series", F.col("reference_month").cast("string").alias("reference_month"), "value", F.lit("index").alias("source"), F.col("source_pull").alias("ingest_ts"))
    for stamp, *_ in PULLS:
        sn.land(rows.filter(F.col("ingest_ts") == stamp).repartition("series"), root, "source", "series", "ingest_ts")
    return root


_SCHEMA = "value DOUBLE, reference_month STRING, source STRING, series STRING, ingest_ts STRING"


@query("snapshot_by_file_time", sql_with(f"""
SELECT p.series, reference_month, {r('value','value')} FROM p JOIN (SELECT series, max(source_pull) AS s FROM p GROUP BY 1) m ON p.series=m.series AND p.source_pull=m.s""", p=_PULLS))
def snapshot_by_file_time(spark, folder):
    raw = sn.read_snapshots(spark, _land_in_turn(spark, folder), _SCHEMA)
    newest = sn.newest_by_file_time(raw, ["series"])
    return rounded(newest.select("series", F.col("reference_month").cast("date").alias("reference_month"), "value"))


@query("snapshot_explicit", sql_with(f"SELECT series, reference_month, {r('value','value')} FROM p WHERE source_pull = '{PULLS[0][0]}' AND series IN (SELECT DISTINCT series FROM p WHERE source_pull = '{PULLS[0][0]}' ORDER BY series LIMIT 2)", p=_PULLS))
def snapshot_explicit(spark, folder):
    """Two series from folders that the caller names."""
    root = _land_in_turn(spark, folder)
    # One name per nation: a list of fixed length.
    names = sorted(x[0] for x in pulls(spark, folder).filter(F.col("source_pull") == PULLS[0][0]).select("series").distinct().collect())
    chosen = sn.select_snapshots(names[:2], {s: f"{root}/source=index/series={s.translate(str.maketrans('/.', '__'))}/ingest_ts={PULLS[0][0]}" for s in names})
    raw = spark.read.schema(_SCHEMA).option("basePath", root).json(chosen)
    named = raw.join(pulls(spark, folder).select("series", safe_id(F.col("series")).alias("safe")).distinct().withColumnRenamed("series", "name"), F.col("series") == F.col("safe"))
    return rounded(named.select(F.col("name").alias("series"), F.col("reference_month").cast("date").alias("reference_month"), "value"))


@query("table_swap", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3")
def table_swap(spark, folder):
    """A table replaced twice; what a failed check leaves is the good one."""
    path = fresh_path(spark, "swap")
    nation = v.table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    not_empty = lambda df: ct.enforce(ct.check_table(df, {"key_present": F.col("n_nationkey").isNotNull()}))
    tb.replace_table(spark, nation, path, not_empty)
    tb.replace_table(spark, nation.filter("n_regionkey < 3"), path, not_empty)
    try:
        tb.replace_table(spark, nation.filter("false"), path, not_empty)
    except ct.ContractError:
        pass
    return spark.read.parquet(path).select("n_nationkey", "n_name")


@query("report_round_trip", "SELECT o_orderpriority AS source, count(*) AS n_rows, 'success' AS status FROM orders GROUP BY 1")
def report_round_trip(spark, folder):
    path = fresh_path(spark, "report")
    rows = v.table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("status", F.lit("success"))
    tb.write_report(rows, path)
    absent = tb.read_report(spark, path + "-absent", "source STRING, n_rows BIGINT, status STRING")
    return tb.read_report(spark, path, "source STRING, n_rows BIGINT, status STRING").unionByName(absent)


@query("optional_table", "SELECT r_regionkey, r_name FROM region")
def optional_table(spark, folder):
    """A table that is there and one that is absent."""
    schema = ", ".join(f"{n} {t}" for n, t in v.table(spark, folder, "region").select("r_regionkey", "r_name").dtypes)
    present = tb.read_optional(spark, f"{folder}/region.parquet", schema)
    return present.unionByName(tb.read_optional(spark, f"{folder}/no_such_table.parquet", schema))


@query("export_csv", f"SELECT o_orderstatus AS status, count(*) AS n_rows, {r('avg(o_totalprice)', 'mean_price', 4)} FROM orders GROUP BY 1")
def export_csv(spark, folder):
    """Result tables as CSV lose their unrounded columns."""
    path = fresh_path(spark, "export")
    rows = v.table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("o_totalprice").alias("price_raw"))
    tb.export_tables({"orders": rows.withColumn("mean_price", F.round("price_raw", 4))}, path)
    return spark.read.option("header", True).schema("status STRING, n_rows BIGINT, mean_price DOUBLE").csv(f"{path}/orders").withColumn("mean_price", F.round("mean_price", 4) + 0.0)


@query("levels_from_changes", sql_with(f"SELECT series, date, {r('y + d', 'd')}, {r('y + d - 1', 'lo')}, {r('y + d + 1', 'hi')} FROM (SELECT *, y - lag(y) OVER (PARTITION BY series ORDER BY date) AS d FROM daily_region) WHERE d IS NOT NULL", "daily_region"))
def levels_from_changes(spark, folder):
    """Forecast changes and their bands shifted to the level they start from."""
    from pyspark.sql import Window

    d = v.daily_region(spark, folder).withColumn("d", F.col("y") - F.lag("y").over(Window.partitionBy("series").orderBy("date"))).filter("d is not null")
    d = d.withColumns({"lo": F.col("d") - 1, "hi": F.col("d") + 1})
    return rounded(reconstruct_levels(d, "y", "d", ("lo", "hi")).select("series", "date", "d", "lo", "hi"))


@query("integration_required")
def integration_required(spark, folder):
    """The unit-root report of the walks: the variables that are integrated of order one go through, the gate holds the rest back."""
    from tideframe.operators.diagnostics import integration_report
    from tideframe.plans.queries_models import WALKS, walks
    from tideframe.session import stored

    report = stored(integration_report(walks(spark, folder), v.SPEC, WALKS), "report")
    whole = report.groupBy("series").agg(F.bool_and("is_i1").alias("all_i1"))
    return rounded(require_i1(report.filter("is_i1")).join(whole, "series"), 4)


_YEARS = "reference_month BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"
_MEANS = f"SELECT 'world' AS series, reference_month, source_pull, avg(value) AS value FROM p WHERE {_YEARS} GROUP BY ALL"
#: The mean of all nations moves by less from the first pull to the second.
WORLD_LIMIT = 250.0


def _world(spark, folder):
    """(pulls of the mean of all nations, release dates of its months)."""
    both = pulls(spark, folder).filter(F.col("reference_month").between(F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date")))
    both = both.groupBy(F.lit("world").alias("series"), "reference_month", "source_pull").agg(F.avg("value").alias("value"))
    return both, both.select(*KEYS).distinct().withColumn("release_date", F.date_add(F.add_months("reference_month", 1), 19))


def _run(spark, both, mapping, root, archive, number, replay, limit=WORLD_LIMIT):
    return run_silver(spark, archive, both.filter(F.col("source_pull") == PULLS[number][0]), mapping, mapping.select(*KEYS).filter("false"), KEYS, "1996-01-01", "1998-12-31", limit, root, replay)


@query("index_job", sql_with(f"""
SELECT series, reference_month, {r('arg_max(value, source_pull)','value')}, CAST(reference_month + INTERVAL 1 MONTH + INTERVAL 19 DAY AS DATE) AS release_date FROM m
WHERE source_pull <= '{PULLS[1][0]}' GROUP BY 1,2""", p=_PULLS, m=_MEANS))
def index_job(spark, folder):
    """The whole job for the mean of all nations: guarded merge, release dates, contracts, one commit of both tables, the index read back."""
    both, mapping = _world(spark, folder)
    silver = _run(spark, both, mapping, fresh_path(spark, "index-job"), both.filter(F.col("source_pull") == PULLS[0][0]), 1, False)
    return rounded(silver.select(*KEYS, "value", "release_date"))


@query("index_replay", sql_with(f"""
SELECT 'archive' AS table_name, series, reference_month, {r('arg_max(value, source_pull)','value')}, max(source_pull) AS source_pull FROM m WHERE source_pull <= '{PULLS[1][0]}' GROUP BY 2,3
UNION ALL SELECT 'silver', series, reference_month, {r('arg_max(value, source_pull)','value')}, max(source_pull) FROM m GROUP BY 2,3""", p=_PULLS, m=_MEANS))
def index_replay(spark, folder):
    """After a job a replay of the third pull: the index is new, the archive stays."""
    both, mapping = _world(spark, folder)
    root = fresh_path(spark, "index-replay")
    _run(spark, both, mapping, root, both.filter(F.col("source_pull") == PULLS[0][0]), 1, False)
    _run(spark, both, mapping, root, vs.read_version(spark, root, "archive"), 2, True)
    tables = [vs.read_version(spark, root, n).select(F.lit(n).alias("table_name"), *KEYS, "value", "source_pull") for n in ("archive", "silver")]
    return rounded(tables[0].unionByName(tables[1]))


@query("index_refusal", sql_with(f"""
SELECT series, reference_month, {r('arg_max(value, source_pull)','value')}, (SELECT count(*) FROM m a JOIN m b USING (series, reference_month)
  WHERE a.source_pull = '{PULLS[0][0]}' AND b.source_pull = '{PULLS[1][0]}' AND abs(b.value - a.value) > 0.001) > 0 AS refused FROM m WHERE source_pull = '{PULLS[0][0]}' GROUP BY 1,2""", p=_PULLS, m=_MEANS))
def index_refusal(spark, folder):
    """A limit that the second pull breaks: the job is refused and both tables stay as the first pull left them."""
    both, mapping = _world(spark, folder)
    root, refused = fresh_path(spark, "index-refusal"), False
    _run(spark, both, mapping, root, both.filter("false"), 0, False)
    try:
        _run(spark, both, mapping, root, vs.read_version(spark, root, "archive"), 1, False, limit=0.001)
    except ct.ContractError:
        refused = True
    return rounded(vs.read_version(spark, root, "silver").select(*KEYS, "value").withColumn("refused", F.lit(refused)))


@query("archive_rules", sql_with("""
SELECT 'key_present' AS "check", count(*) FILTER (reference_month IS NULL) AS n_bad FROM p UNION ALL SELECT 'value_present', count(*) FILTER (value IS NULL) FROM p
UNION ALL SELECT 'key_unique', count(*) FROM (SELECT series, reference_month FROM p GROUP BY 1,2 HAVING count(*) > 1)
UNION ALL SELECT 'months_contiguous', count(*) FROM (SELECT series FROM p GROUP BY 1 HAVING date_diff('month', min(reference_month), max(reference_month)) + 1 > count(DISTINCT reference_month))""", p=_PULLS))
def archive_rules(spark, folder):
    """The rules of an archive, on all pulls stacked: keys repeat there."""
    return ct.archive_checks(pulls(spark, folder), KEYS).select("check", "n_bad")


@query("guarded_rebuild", sql_with(f"SELECT series, reference_month, {r('arg_max(value, source_pull)','value')}, max(source_pull) AS source_pull FROM p GROUP BY 1,2", p=_PULLS))
def guarded_rebuild(spark, folder):
    """The archive from all pulls, each held against those before it; the limit is the largest change there is, which none exceeds."""
    changes = ar.guard_report(ar.revision_log(pulls(spark, folder), KEYS, 0.0), 0.0).first()
    return rounded(ar.rebuild(pulls(spark, folder), KEYS, limit=changes["largest"]))


@query("guard_report", sql_with(f"""
SELECT CAST(l AS DOUBLE) AS "limit", count(*) FILTER (abs(value - old) > l) AS n_over, {r('max(abs(value - old))', 'largest')}, count(*) FILTER (abs(value - old) > l) > 0 AS refused
FROM (SELECT value, lag(value) OVER (PARTITION BY series, reference_month ORDER BY source_pull) AS old FROM p), (SELECT unnest([{LIMIT}, 1000000.0]) AS l) WHERE abs(value - old) > 1e-9 GROUP BY 1, l""", p=_PULLS))
def guard_report(spark, folder):
    """What the guard says about all pulls at two limits; the lower one refuses them."""
    changes = ar.revision_log(pulls(spark, folder), KEYS, LIMIT)
    return rounded(ar.guard_report(changes, LIMIT).unionByName(ar.guard_report(changes, 1e6)))
