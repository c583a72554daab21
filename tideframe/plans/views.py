"""Panels over the star-schema tables, each with the same definition as SQL text.

Money is summed as whole cents, so a total does not depend on the order in which
partitions are merged, and the sums stay in primitive longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.panel import PanelSpec

HORIZONS = (1, 5, 20)
MIN_TRAIN, STEP, MAX_H = 100, 5, 20
# The closed date intervals used as regimes on the order calendar.
REGIMES = (
    ("early", "1995-01-01", "1996-12-31"),
    ("middle", "1997-01-01", "1998-12-31"),
    ("late", "1999-01-01", "2001-12-31"),
)
SPEC = PanelSpec()
MONTHLY = PanelSpec(time="month")
EVENTS = PanelSpec(keys=("event_type",), time="ts", tie=("event_id",), grain="minute", block_rows=1000)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(name: str) -> Column:
    """A two-decimal amount as a whole number of hundredths."""
    return F.rint(F.col(name) * 100).cast("long")


def net_value() -> Column:
    """Discounted price of a line item in units of 1/10,000."""
    return cents("l_extendedprice") * (100 - cents("l_discount"))


def located_orders(spark: SparkSession, folder: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Orders with date, price and the nation and region of the customer.

    A date range is applied to the stored timestamp, half-open, so it reaches the scan.
    """
    orders = table(spark, folder, "orders")
    if first:
        orders = orders.filter(F.col("o_orderdate") >= F.lit(first).cast("timestamp_ntz"))
    if last:
        orders = orders.filter(F.col("o_orderdate") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))
    orders = orders.select(
        "o_custkey", F.to_date("o_orderdate").alias("date"), cents("o_totalprice").alias("cents"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


def _daily(spark: SparkSession, folder: str, key: str, first: str | None = None, last: str | None = None) -> DataFrame:
    return located_orders(spark, folder, first, last).groupBy(F.col(key).alias("series"), "date").agg(
        F.ln(F.sum("cents") / 100.0).alias("y"), F.count(F.lit(1)).alias("n"))


def daily_region(spark: SparkSession, folder: str, first: str | None = None, last: str | None = None) -> DataFrame:
    return _daily(spark, folder, "r_name", first, last)


def daily_nation(spark: SparkSession, folder: str) -> DataFrame:
    return _daily(spark, folder, "n_name")


def daily_ship(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(
        F.col("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("date")
    ).agg(F.ln(F.sum(net_value()) / 10000.0).alias("y"), (F.sum(cents("l_quantity")) / 100.0).alias("q"))


def daily_supply(spark: SparkSession, folder: str, terms: bool = False) -> DataFrame:
    """Shipped value and quantity per day and region of the supplier: a second calendar for the same keys.

    With ``terms`` also the mean discount and tax of the day's line items.
    """
    shipped = table(spark, folder, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("date"), net_value().alias("value"), cents("l_quantity").alias("quantity"), cents("l_discount").alias("discount"), cents("l_tax").alias("tax"))
    means = [(F.sum(c) / F.count(c)).alias(c) for c in ("discount", "tax")] if terms else []
    return (
        shipped.join(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("series"), "date")
        .agg(F.ln(F.sum("value") / 10000.0).alias("s"), (F.sum("quantity") / 100.0).alias("q"), *means)
    )


def monthly_region(spark: SparkSession, folder: str) -> DataFrame:
    """Geometric mean of order prices per region and month, published 19 days into the month after."""
    return _monthly(spark, folder, F.col("r_name"))


def monthly_cell(spark: SparkSession, folder: str) -> DataFrame:
    """The same per nation and market segment: fine enough to have months without an order."""
    return _monthly(spark, folder, F.concat_ws("/", "n_name", "c_mktsegment"))


def _monthly(spark: SparkSession, folder: str, key: Column) -> DataFrame:
    month = F.trunc("date", "month")
    return located_orders(spark, folder).groupBy(key.alias("series"), month.alias("month")).agg(
        (F.exp(F.avg(F.ln(F.col("cents") / 100.0))) / 1000.0).alias("v")
    ).withColumn("release_date", F.date_add(F.add_months("month", 1), 19))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream as one series per type; rows per type have no bound. ``x`` is on the log scale."""
    return table(spark, folder, "events").select("event_type", "ts", "event_id", F.ln(F.col("value") + 1).alias("x"))


VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), "SELECT event_type, ts, event_id, ln(value + 1) AS x FROM events"),
    "located": ((), """
SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
       n_name, r_name, c_mktsegment
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
JOIN region ON n_regionkey=r_regionkey"""),
    "daily_region": (("located",), """
SELECT r_name AS series, date, ln(CAST(SUM(price) AS DOUBLE)) AS y, COUNT(*) AS n FROM located GROUP BY 1,2"""),
    "daily_nation": (("located",), """
SELECT n_name AS series, date, ln(CAST(SUM(price) AS DOUBLE)) AS y, COUNT(*) AS n FROM located GROUP BY 1,2"""),
    "daily_ship": ((), """
SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS date,
 ln(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))*(1-CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)) AS y,
 CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q
FROM lineitem GROUP BY 1,2"""),
    "daily_supply": ((), """
SELECT r_name AS series, CAST(l_shipdate AS DATE) AS date,
 ln(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))*(1-CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)) AS s,
 CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q
FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey
JOIN region ON n_regionkey=r_regionkey GROUP BY 1,2"""),
    "monthly_region": (("located",), """
SELECT r_name AS series, CAST(date_trunc('month',date) AS DATE) AS month,
 exp(avg(ln(CAST(price AS DOUBLE))))/1000.0 AS v,
 CAST(date_trunc('month',date) + INTERVAL 1 MONTH + INTERVAL 19 DAY AS DATE) AS release_date
FROM located GROUP BY 1,2,4"""),
    "monthly_cell": (("located",), """
SELECT n_name || '/' || c_mktsegment AS series, CAST(date_trunc('month',date) AS DATE) AS month,
 exp(avg(ln(CAST(price AS DOUBLE))))/1000.0 AS v,
 CAST(date_trunc('month',date) + INTERVAL 1 MONTH + INTERVAL 19 DAY AS DATE) AS release_date
FROM located GROUP BY 1,2,4"""),
}


def sql_with(body: str, *views: str, **extra: str) -> str:
    """Prefix a query with the view definitions it names, and with CTEs of its own."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEW_SQL[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for v in views:
        visit(v)
    ctes = [f"{v} AS ({VIEW_SQL[v][1].strip()})" for v in ordered]
    ctes += [f"{k} AS ({v.strip()})" for k, v in extra.items()]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body.strip()
