"""Small column helpers with the semantics the workload relies on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import WHITE_SPACE


def has_prefix(column: str, prefix: str) -> Column:
    """Prefix match that reaches the parquet scan as StringStartsWith."""
    return F.col(column).startswith(prefix)


def county_key(geoid: str = "GEOID") -> Column:
    """County part (first five digits) of a tract key."""
    return F.left(F.col(geoid), F.lit(5))


def tract_text(fips: str) -> Column:
    """An 11-digit tract key from its integer form, leading zeros restored."""
    return F.lpad(F.col(fips).cast("string"), 11, "0")


def valid_pct(column: str) -> Column:
    """Percent or percentile inside 0..100; sentinels and NULL drop out."""
    return F.col(column).between(0, 100)


def year_text(date: str) -> Column:
    """Year as a string."""
    return F.date_format(F.col(date), "yyyy")


def share_of(condition: Column) -> Column:
    """Aggregate: fraction of rows where the condition holds (NULL counts as no)."""
    hits = F.sum(F.when(condition, 1.0).otherwise(0.0))
    return F.try_divide(hits, F.count(F.lit(1)).cast("double"))


def finite_or_null(column: str) -> Column:
    """NaN and infinities become NULL."""
    c = F.col(column)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def number_or_null(column: str, kind: str = "double") -> Column:
    """Text as a number, blanks around it allowed; NULL where it is none."""
    return F.trim(F.col(column).cast("string")).try_cast(kind)


def blob_text(column: str) -> Column:
    """Binary values are reported by their length only."""
    return F.concat(F.lit("BLOB("), F.octet_length(column).cast("string"), F.lit(" bytes)"))


def iso_text(column: str) -> Column:
    """Date or timestamp as ISO text; microseconds only where there are any."""
    c = F.col(column).cast("timestamp")
    fraction = F.date_format(c, "SSSSSS")
    return F.concat(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""),
    )


def flatten_text(text: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(text, WHITE_SPACE, " "))


def strip_fences(text: Column) -> Column:
    """Take code fences off a text, and white space of any kind off its ends."""
    return F.regexp_replace(F.regexp_replace(text, r"```(sql)?", ""), r"^\s+|\s+$", "")


def describe_or_unknown(description: Column) -> Column:
    return F.coalesce(description, F.lit("unknown"))
