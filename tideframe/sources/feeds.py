"""JSON feeds with an explicit schema: wide, long and vector responses, release calendars, calendar texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions.scalars import month_start, sentinel_to_null, to_day, to_number
from tideframe.panel import keep_one

LONG_SCHEMA = "observations ARRAY<STRUCT<date: STRING, value: STRING>>"
VECTOR_SCHEMA = "status STRING, object STRUCT<vectorDataPoint: ARRAY<STRUCT<refPer: STRING, value: DOUBLE>>>"
RELEASE_SCHEMA = "title STRING, date STRING, description STRING"


def wide_schema(codes: Sequence[str]) -> T.StructType:
    value = T.StructType([T.StructField("v", T.StringType())])
    row = T.StructType([T.StructField("d", T.StringType()), *[T.StructField(c, value) for c in codes]])
    return T.StructType([T.StructField("observations", T.ArrayType(row))])


def read_json(spark: SparkSession, paths: str | Sequence[str], schema) -> DataFrame:
    """Read feed files with file path and modification time of each snapshot."""
    return (
        spark.read.schema(schema).option("multiLine", True).json(paths)
        .select("*", F.col("_metadata.file_path").alias("file_path"),
                F.col("_metadata.file_modification_time").alias("file_time"))
    )


def wide_observations(feed: DataFrame, codes: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per observation, one column per mapped code; an absent code is null."""
    rows = feed.select(*keep, F.explode("observations").alias("o"))
    have = set(rows.schema["o"].dataType.fieldNames())
    cells = [
        to_number(F.col("o")[code]["v"] if code in have else F.lit(None).cast("string")).alias(name)
        for code, name in codes.items()]
    return rows.select(*keep, to_day(F.col("o.d")).alias("date"), *cells)


def long_observations(feed: DataFrame, keep: Sequence[str] = (), sentinel: str = ".") -> DataFrame:
    """``date, value`` rows; the sentinel is a missing value, rows without a date are dropped."""
    fields = set(feed.schema["observations"].dataType.elementType.fieldNames())
    if not {"date", "value"} <= fields:
        raise ValueError(f"the feed lacks {sorted({'date', 'value'} - fields)}")
    rows = feed.select(*keep, F.explode("observations").alias("o"))
    return rows.select(
        *keep, to_day(F.col("o.date")).alias("date"),
        to_number(sentinel_to_null(F.col("o.value"), sentinel)).alias("value"),
    ).na.drop(subset=["date"])


def vector_observations(feed: DataFrame, keep: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Data points of successful responses. ``strict`` fails the job on a bad status or an empty list."""
    good = (F.col("status") == "SUCCESS") & (F.size("object.vectorDataPoint") > 0)
    if strict:
        feed = feed.withColumn("status", F.when(good, F.col("status")).otherwise(
            F.raise_error(F.concat(F.lit("response without data, status "), F.coalesce("status", F.lit("missing"))))))
        feed = feed.filter(F.col("status") == "SUCCESS")
    else:
        feed = feed.filter(good)
    rows = feed.select(*keep, F.explode("object.vectorDataPoint").alias("p"))
    return rows.select(*keep, month_start(to_day(F.col("p.refPer"))).alias("reference_month"), to_number(F.col("p.value")).alias("value"))


def response_report(feed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Status and size of each vector response, for the contract table."""
    n = F.coalesce(F.size("object.vectorDataPoint"), F.lit(0))
    return feed.select(*keep, "status", n.cast("long").alias("n_points"), ((F.col("status") == "SUCCESS") & (n > 0)).alias("usable"))


def release_entries(feed: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Release calendar entries whose title starts with ``prefix`` in any case.

    Rows whose description is not a month are skipped; the last entry per month wins.
    """
    wanted = feed.filter(F.lower(F.trim("title")).startswith(prefix.lower()))
    parsed = wanted.select(
        *keep, to_day(F.trim("description"), "MMMM yyyy").alias("reference_month"),
        to_day(F.split("date", " ")[0]).alias("release_date"), F.col("date").alias("_stamp"))
    valid = parsed.filter(F.col("reference_month").isNotNull() & F.col("release_date").isNotNull())
    return keep_one(valid, [*keep, "reference_month"], [F.col("_stamp")], "last").drop("_stamp")


# Fixed value: a release date followed by its reference month.
PAIR = r"([A-Z][a-z]+ \d{1,2}, \d{4})\s+([A-Z][a-z]+ \d{4})"


def with_section(
    texts: DataFrame, text: str, heading: str, stop: str, alias: str = "section", lookahead: int = 400, least: int = 3, fallback: int | None = None
) -> DataFrame:
    """Add the section of each text that starts at the first heading followed by real date pairs.

    Headings are found by splitting the whole text on them; a heading counts when the
    ``lookahead`` characters from it hold at least ``least`` pairs, else the first one
    is used. The section ends at the next ``stop`` heading; without one it goes on to the end
    of the text, or for ``fallback`` characters if that is given. Texts without the heading are dropped.
    """
    size = len(heading)
    whole = F.col(text)
    # The offset of each heading: every piece before it plus the headings between them.
    starts = F.aggregate(
        F.slice("_lengths", F.lit(1), F.size("_lengths") - 1), F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("seen")),
        lambda s, n: F.struct((s["at"] + n + size).alias("at"), F.array_append(s["seen"], s["at"] + n).alias("seen")), lambda s: s["seen"])
    pairs_near = lambda at: F.size(F.regexp_extract_all(F.substr(whole, at, F.lit(lookahead)), F.lit(PAIR), F.lit(0)))
    confirmed = F.filter("_starts", lambda at: pairs_near(at) >= least)
    found = texts.filter(whole.contains(heading))
    lengths = F.transform(F.split(whole, F.lit("\\Q" + heading + "\\E")), lambda part: F.length(part))
    staged = (
        found.withColumn("_lengths", lengths).withColumn("_starts", starts)
        .withColumn("_at", F.coalesce(F.get(confirmed, F.lit(0)), F.get("_starts", F.lit(0))))
        .withColumn("_rest", F.substr(whole, F.col("_at")))
        .withColumn("_end", F.instr("_rest", stop)))
    length = F.when(F.col("_end") > 0, F.col("_end") - 1).otherwise(F.length("_rest") if fallback is None else F.lit(fallback))
    return staged.withColumn(alias, F.substr("_rest", F.lit(1), length)).drop("_lengths", "_starts", "_at", "_rest", "_end")


def calendar_pairs(texts: DataFrame, keep: Sequence[str], text: str, heading: str, stop: str) -> DataFrame:
    """Release date and reference month pairs of each text's section, in text order."""
    section = with_section(texts, text, heading, stop, "_s").select(*keep, "_s")
    both = F.arrays_zip(
        F.regexp_extract_all("_s", F.lit(PAIR), F.lit(1)).alias("a"),
        F.regexp_extract_all("_s", F.lit(PAIR), F.lit(2)).alias("b"))
    rows = section.select(*keep, F.posexplode(both).alias("position", "p"))
    return rows.select(
        *keep, "position", to_day(F.col("p")["a"], "MMMM d, yyyy").alias("release_date"),
        to_day(F.col("p")["b"], "MMMM yyyy").alias("reference_month"))
