"""Timestamps as they appear in logs, captures and exports. Sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
_EPOCH = "1970-01-01T00:00:00.000Z"


def clf_local_iso(ts: Column) -> Column:
    """Common-log time with its offset dropped and the local time stamped ``Z``; bad text -> ""."""
    parsed = F.try_to_timestamp(F.split_part(ts, F.lit(" "), F.lit(1)), F.lit("dd/MMM/yyyy:HH:mm:ss"))
    return F.coalesce(F.date_format(parsed, ISO_MILLIS), F.lit(""))


def clf_utc_iso(ts: Column) -> Column:
    """Common-log time with its offset applied; bad text -> the epoch."""
    parsed = F.try_to_timestamp(ts, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return F.coalesce(F.date_format(parsed, ISO_MILLIS), F.lit(_EPOCH))


def date_time_iso(date: Column, time: Column) -> Column:
    return F.concat(date, F.lit("T"), time, F.lit(".000Z"))


def parse_iso(ts: Column | str) -> Column:
    """ISO time with fraction and ``Z``; any other form gives null."""
    c = F.col(ts) if isinstance(ts, str) else ts
    shaped = F.when(c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{1,6}Z$"), c)
    return F.try_to_timestamp(shaped)


def is_usable(ts: Column) -> Column:
    """A real time: parsed, and later than the year the epoch fallback falls in."""
    return ts.isNotNull() & (F.year(ts) > 1970)


def window_number(ts: Column, seconds: int = 10) -> Column:
    """Index of the tumbling window that holds ``ts``."""
    return F.floor(F.unix_seconds(ts) / F.lit(seconds)).cast("long")


def integer_or(c: Column, default: int | None = None) -> Column:
    """Digits to bigint, anything else to ``default``."""
    digits = F.when(c.rlike(r"^\d+$"), c).try_cast("bigint")
    return digits if default is None else F.coalesce(digits, F.lit(default).cast("bigint"))
