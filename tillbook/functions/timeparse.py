"""B5 normalize_ts and B6 business_day.

The ledger writes two encodings: local text with an offset suffix
(``YYYY-MM-DD HH:MM:SS-06:00``) and suffix-less text (what the database
default wrote, UTC). Operators compare instants, never text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The business time zone of the ledger.
BUSINESS_ZONE = "America/Tegucigalpa"

_OFFSET = r"([+-])(\d{2}):?(\d{2})$"


def normalize_ts(col: Column | str, naive_zone: str = "UTC") -> Column:
    """Mixed-offset text -> UTC instant as ``timestamp_ntz`` (UTC wall time).

    Suffixed text is shifted by its own offset (``Z`` is none); suffix-less text
    is read in ``naive_zone``. Fractions of a second are kept to the
    microsecond. An hour printed as ``24`` is read as ``00``; text that does
    not parse gives NULL (``try_to_timestamp``)."""
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    c = F.regexp_replace(F.regexp_replace(c, "[Zz]$", "+00:00"), r"^(\d{4}-\d{2}-\d{2})[ T]24:", "$1 00:")
    has_offset = c.rlike(_OFFSET)
    local_text = F.regexp_replace(F.regexp_replace(c, _OFFSET, ""), "T", " ")
    local = F.try_to_timestamp(F.substring(local_text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    fraction = F.rpad(F.regexp_extract(local_text, r"^.{19}[.](\d{1,6})\d*$", 1), 6, "0").cast("int")
    local = local + F.make_dt_interval(secs=(fraction / 1_000_000).cast("decimal(18,6)"))
    sign = F.when(F.regexp_extract(c, _OFFSET, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    minutes = (F.regexp_extract(c, _OFFSET, 2).try_cast("int") * 60
               + F.regexp_extract(c, _OFFSET, 3).try_cast("int")) * sign
    shifted = local - F.make_dt_interval(mins=minutes)
    naive = local if naive_zone.upper() == "UTC" else \
        F.convert_timezone(F.lit(naive_zone), F.lit("UTC"), local.cast("timestamp_ntz"))
    out = F.when(has_offset, shifted).otherwise(naive)
    return out.cast("timestamp_ntz")


def business_day(col: Column | str, tz: str | None = BUSINESS_ZONE) -> Column:
    """Local calendar day of a UTC instant (``tz=None``: the value is already
    local wall time)."""
    c = F.col(col) if isinstance(col, str) else col
    if tz is None:
        return F.to_date(c)
    # wall-clock conversion of a timestamp_ntz: independent of the session zone
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), c.cast("timestamp_ntz")))


def ts_literal(value) -> Column:
    """A ``timestamp_ntz`` literal from text, a ``datetime`` (its wall time,
    not shifted by the Python process zone) or a Column (returned as is)."""
    import datetime as _dt
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        value = value.strftime("%Y-%m-%d 00:00:00")
    return F.lit(value).cast("timestamp_ntz")
