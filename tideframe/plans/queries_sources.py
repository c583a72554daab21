"""Queries: JSON and CSV feeds, release calendars, text extraction, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.functions import scalars as sc
from tideframe.plans import views as v
from tideframe.plans.catalogue import query, r, rounded
from tideframe.plans.views import sql_with
from tideframe.session import fresh_path
from tideframe.sources import feeds as fd
from tideframe.sources import tables as tb

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
CODES = {f"R.{name.replace(' ', '.')}": name.lower().replace(" ", "_") for name in REGIONS}


def _monthly_counts(spark, folder):
    return v.located_orders(spark, folder).groupBy("r_name", F.trunc("date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))


_COUNTS = "SELECT r_name, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS n FROM located GROUP BY 1,2"


@query("json_wide_feed", sql_with("SELECT month AS date, " + ", ".join(
    f"CAST(max(n) FILTER (r_name='{name}') AS DOUBLE) AS {CODES['R.' + name.replace(' ', '.')]}" for name in REGIONS) + ", CAST(NULL AS DOUBLE) AS retired FROM c GROUP BY 1", "located", c=_COUNTS))
def json_wide_feed(spark, folder):
    """Monthly order counts written as one wide JSON feed per year, then scanned with dotted codes."""
    counts = _monthly_counts(spark, folder)
    cells = [F.struct(F.max(F.when(F.col("r_name") == name, F.col("n").cast("string"))).alias("v")).alias(f"R.{name.replace(' ', '.')}") for name in REGIONS]
    months = counts.groupBy("month").agg(*cells)
    row = F.struct(F.col("month").cast("string").alias("d"), *[F.col(f"`{c}`") for c in CODES])
    path = fresh_path(spark, "wide")
    months.groupBy(F.year("month").alias("year")).agg(F.collect_list(row).alias("observations")).drop("year").write.json(path)
    feed = spark.read.schema(fd.wide_schema(list(CODES))).json(path)
    return fd.wide_observations(feed, {**CODES, "R.RETIRED": "retired"})


@query("json_long_feed", sql_with("SELECT r_name, month AS date, CASE WHEN n > 1 THEN CAST(n AS DOUBLE) END AS value FROM c", "located", c=_COUNTS))
def json_long_feed(spark, folder):
    """One document per region; single counts are published as the missing sign."""
    counts = _monthly_counts(spark, folder)
    row = F.struct(F.col("month").cast("string").alias("date"), F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise(".").alias("value"))
    body = counts.groupBy("r_name").agg(F.to_json(F.struct(F.collect_list(row).alias("observations"))).alias("body"))
    parsed = body.select("r_name", F.from_json("body", fd.LONG_SCHEMA).alias("f")).select("r_name", "f.*")
    return fd.long_observations(parsed, ["r_name"])


def _vector_feed(spark, folder):
    counts = _monthly_counts(spark, folder)
    point = F.struct(F.col("month").cast("string").alias("refPer"), F.col("n").cast("double").alias("value"))
    status = F.when(F.col("r_name") == "ASIA", "FAILED").otherwise("SUCCESS")
    docs = counts.groupBy("r_name").agg(F.collect_list(point).alias("p"))
    body = docs.select("r_name", F.to_json(F.struct(status.alias("status"), F.struct(F.col("p").alias("vectorDataPoint")).alias("object"))).alias("body"))
    return body.select("r_name", F.from_json("body", fd.VECTOR_SCHEMA).alias("f")).select("r_name", "f.*")


@query("json_vector_feed", sql_with("SELECT r_name, month AS reference_month, CAST(n AS DOUBLE) AS value FROM c WHERE r_name <> 'ASIA'", "located", c=_COUNTS))
def json_vector_feed(spark, folder):
    return fd.vector_observations(_vector_feed(spark, folder), ["r_name"], strict=False)


@query("response_report", sql_with("SELECT r_name, CASE WHEN r_name='ASIA' THEN 'FAILED' ELSE 'SUCCESS' END AS status, count(*) AS n_points, r_name <> 'ASIA' AS usable FROM c GROUP BY 1", "located", c=_COUNTS))
def response_report(spark, folder):
    return fd.response_report(_vector_feed(spark, folder), ["r_name"])


@query("run_summary", sql_with("SELECT 'long' AS feed, r_name AS series, count(*) AS n_observations, min(month) AS first_date, max(month) AS last_date FROM c GROUP BY 2 UNION ALL SELECT 'vector', r_name, count(*), min(month), max(month) FROM c WHERE r_name <> 'ASIA' GROUP BY 2", "located", c=_COUNTS))
def run_summary(spark, folder):
    long = json_long_feed(spark, folder).select(F.lit("long").alias("feed"), F.col("r_name").alias("series"), "date")
    vector = json_vector_feed(spark, folder).select(F.lit("vector").alias("feed"), F.col("r_name").alias("series"), F.col("reference_month").alias("date"))
    return long.unionByName(vector).groupBy("feed", "series").agg(
        F.count(F.lit(1)).alias("n_observations"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("event_properties", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.absent'), 'none') AS absent FROM events")
def event_properties(spark, folder):
    p = F.from_json("props", "k BIGINT, absent STRING")
    return v.table(spark, folder, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["absent"], F.lit("none")).alias("absent"))


@query("csv_scan", sql_with(f"SELECT series, month, {r('v','v')}, CASE WHEN EXTRACT(month FROM month) <> 3 THEN release_date END AS release_date FROM monthly_region", "monthly_region"))
def csv_scan(spark, folder):
    """Written as CSV with a bad date in every March, read back with coercion."""
    path = fresh_path(spark, "csv")
    m = v.monthly_region(spark, folder).withColumn("release_date", F.when(F.month("month") == 3, "n/a").otherwise(F.col("release_date").cast("string")))
    tb.write_table(m, path, "csv")
    return rounded(tb.read_csv(spark, path, ["month", "release_date"], ["v"], ["series"]).select("series", "month", "v", "release_date"))


@query("release_feed", sql_with("""
SELECT series, month AS reference_month, CAST(release_date + CASE WHEN EXTRACT(month FROM month)=5 THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END AS DATE) AS release_date
FROM monthly_cell WHERE EXTRACT(month FROM month) <> 7""", "monthly_cell"))
def release_feed(spark, folder):
    """Entries in mixed case beside other titles; Mays are published twice, Julys have no readable month."""
    m = v.monthly_cell(spark, folder)
    text = F.when(F.month("month") == 7, "midyear").otherwise(F.date_format("month", "MMMM yyyy"))
    stamp = lambda d, t: F.concat(d.cast("string"), F.lit(t))
    base = m.select("series", "release_date", text.alias("description"), F.month("month").alias("_m"))
    first = base.select("series", F.lit("  Consumer price index, all items").alias("title"), stamp(F.col("release_date"), " 08:30:00").alias("date"), "description")
    again = base.filter("_m = 5").select("series", F.lit("CONSUMER PRICE INDEX revised").alias("title"), stamp(F.date_add("release_date", 2), " 08:30:00").alias("date"), "description")
    other = base.select("series", F.lit("Labour force survey").alias("title"), stamp(F.date_add("release_date", 5), " 08:30:00").alias("date"), "description")
    return fd.release_entries(first.unionByName(again).unionByName(other), "Consumer Price Index", ["series"])


def calendar_texts(spark, folder):
    """One release calendar text per customer from the months of their orders.

    The heading stands once in an index line and once over the real table; other
    tables stand before and after it.
    """
    o = v.table(spark, folder, "orders").select("o_custkey", F.trunc(F.to_date("o_orderdate"), "month").alias("m")).distinct()
    pair = F.concat(F.date_format(F.date_add(F.add_months("m", 1), 19), "MMMM d, yyyy"), F.lit(" "), F.date_format("m", "MMMM yyyy"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", pair.alias("t")))), lambda s: s["t"]), "\n")
    head = F.concat(F.lit("22 Consumer Price Index December 2019\n"), F.repeat(F.lit("- "), F.lit(210)), F.lit("\nLabour Force Survey\nJanuary 9, 1990 December 1989\n"))
    tail = F.lit("\nEmployment Insurance\nMarch 3, 1990 February 1990\n")
    return o.groupBy("o_custkey").agg(F.concat(head, F.lit("Consumer Price Index\n"), lines, tail).alias("text"))


@query("text_pair_extract", """
WITH m AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
k AS (SELECT o_custkey, count(*) AS c FROM m GROUP BY 1),
pairs AS (SELECT o_custkey, month, CAST(month + INTERVAL 1 MONTH + INTERVAL 19 DAY AS DATE) AS release_date FROM m
 UNION ALL SELECT o_custkey, DATE '1989-12-01', DATE '1990-01-09' FROM k WHERE c < 2)
SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY month) - 1 AS position, release_date, month AS reference_month FROM pairs""")
def text_pair_extract(spark, folder):
    """A heading needs three pairs within reach, the next table's pair counts; else the text is read from the first heading on."""
    out = fd.calendar_pairs(calendar_texts(spark, folder), ["o_custkey"], "text", "Consumer Price Index", "Employment Insurance")
    return out.withColumn("position", F.col("position").cast("long"))


_SECRET = r"((?:api_key|apikey|key|token|secret|password)=)[^\s&\"'']+"


@query("redact_secrets", rf"""
SELECT doc_id AS id, 'documents' AS origin, md5(regexp_replace(text, '{_SECRET}', '\1***REDACTED***', 'gi')) AS clean_md5, regexp_matches(text, '{_SECRET}', 'i') AS had_secret FROM documents
UNION ALL SELECT page_id, 'pages', md5(regexp_replace(url || '&token=' || md5(url) || ' ' || html, '{_SECRET}', '\1***REDACTED***', 'gi')), true FROM pages""")
def redact_secrets(spark, folder):
    """Whole texts of documents, and of pages with a token added to the address."""
    d = v.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"), "text")
    p = v.table(spark, folder, "pages").select(
        F.col("page_id").alias("id"), F.lit("pages").alias("origin"), F.concat("url", F.lit("&token="), F.md5("url"), F.lit(" "), "html").alias("text"))
    clean = F.md5(sc.redact(F.col("text")))
    return d.unionByName(p).select("id", "origin", clean.alias("clean_md5"), (F.col("text").contains("=") & F.col("text").rlike(sc.SECRET_PARAMETER)).alias("had_secret"))


@query("safe_series_ids", "SELECT DISTINCT replace(replace(url, '/', '_'), '.', '_') AS safe FROM pages")
def safe_series_ids(spark, folder):
    return v.table(spark, folder, "pages").select(sc.safe_id(F.col("url")).alias("safe")).distinct()


@query("finite_and_close", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, isfinite(ln(l_discount + 1)) AS finite, abs(l_extendedprice*(1-l_discount) - (l_extendedprice - l_extendedprice*l_discount)) <= 1e-12 + 1e-10*abs(l_extendedprice - l_extendedprice*l_discount) AS close FROM lineitem")
def finite_and_close(spark, folder):
    li, e, d = v.table(spark, folder, "lineitem"), F.col("l_extendedprice"), F.col("l_discount")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sc.is_finite(F.ln(d + 1)).alias("finite"), sc.is_close(e * (1 - d), e - e * d).alias("close"))
