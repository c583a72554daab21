"""Scalar column expressions: coercion, comparison, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters whose value must never be shown.
SECRET_PARAMETER = r"(?i)((?:api_key|apikey|key|token|secret|password)=)[^\s&\"']+"
REDACTED = "***REDACTED***"


def to_number(c: Column) -> Column:
    """Bad numbers become null; so does NaN, which Spark would treat as a value."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def to_day(c: Column, *formats: str) -> Column:
    """Bad dates become null; the first format that fits counts."""
    tries = [F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats] or [c.try_cast("date")]
    return F.coalesce(*tries)


def sentinel_to_null(c: Column, sentinel: str = ".") -> Column:
    return F.nullif(F.trim(c), F.lit(sentinel))


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def is_close(a: Column, b: Column, rtol: float = 1e-10, atol: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def month_start(c: Column) -> Column:
    return F.trunc(c, "month")


def next_month(c: Column) -> Column:
    return F.add_months(c, 1)


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def redact(c: Column) -> Column:
    """Hide the values of secret parameters; text without an equals sign skips the pattern."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.contains("="), F.regexp_replace(text, F.lit(SECRET_PARAMETER), F.lit(f"$1{REDACTED}"))).otherwise(text)


def safe_id(c: Column) -> Column:
    """Series id usable in a file name."""
    return F.translate(c, "/.", "__")


def percent_label(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c)


def guarded_ratio(top: Column, bottom: Column, floor: float = 1e-12) -> Column:
    """Ratio, null where the denominator is degenerate."""
    return F.when(bottom > floor, top / bottom)


def improvement_pct(model: Column, naive: Column) -> Column:
    return F.when(naive > 0, (naive - model) / naive * 100).otherwise(F.lit(0.0))
