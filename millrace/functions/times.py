"""Times: zoned parsing, periods and clusters, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc(text: Column) -> Column:
    """A timestamp from ISO-8601 with a zone, or from seconds since the epoch; a
    text without a zone is null, never taken for UTC."""
    number = text.rlike(r"^\s*-?\d+(\.\d+)?\s*$")
    zoned = text.rlike(r"(?i)^\s*\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}.*(z|[+-]\d{2}:?\d{2})\s*$")
    iso = F.regexp_replace(F.btrim(text), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(number, F.timestamp_seconds(F.btrim(text).try_cast("double"))).when(zoned, iso.try_cast("timestamp"))


def iso_week(t: Column) -> Column:
    """YYYY-Www by ISO year."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))


def month(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM")


def in_period(t: Column, start: str, end: str) -> Column:
    """Whether start <= t < end."""
    return (t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp"))


def window_complete(start: Column, observed_until: Column, days: int) -> Column:
    """Whether the days after start were observed; unknown is false."""
    return F.coalesce(observed_until >= start + F.make_dt_interval(F.lit(days)), F.lit(False))


def days_between(later: Column, earlier: Column) -> Column:
    """Days as a fraction, from seconds since the epoch."""
    return (later - earlier) / F.lit(86400.0)
