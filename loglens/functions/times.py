"""Time parsing and formatting (T1, T2, T3), independent of the session time zone."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK_SECONDS = 7 * 60 * 60 * 24
_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_local_time(text, pattern: str, tz: str = "UTC") -> Column:
    """Text in zone ``tz`` to epoch seconds; NULL when it does not parse."""
    ts = F.try_to_timestamp(F.concat(_c(text), F.lit(" " + tz)), F.lit(pattern + " VV"))
    return F.unix_timestamp(ts)


_DECIMAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_EPOCH_LIMIT = float(1 << 62)          # times whose differences fit 64 bits
_NTZ_LIMIT = 9_000_000_000_000         # seconds that a zone-less timestamp holds


def parse_epoch(text) -> Column:
    """``1700000000.750`` to whole seconds (floor); NULL for anything but a decimal number
    (no type suffix, no infinity) and for numbers that 64 bits do not hold."""
    t = F.trim(_c(text))
    value = F.when(t.rlike(_DECIMAL), t.try_cast("double"))
    return F.when(F.abs(value) < F.lit(_EPOCH_LIMIT), F.floor(value))


def ntz_seconds(ts) -> Column:
    """Seconds since the epoch of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("SECOND", F.expr(_EPOCH_NTZ), _c(ts))


def seconds_to_ntz(seconds) -> Column:
    """Zone-less timestamp of epoch seconds; NULL beyond the range of timestamps."""
    s = F.when(F.abs(_c(seconds)) < F.lit(_NTZ_LIMIT), _c(seconds).cast("bigint"))
    days = F.floor(s / F.lit(86400)).cast("int")
    return F.expr(_EPOCH_NTZ) + F.make_dt_interval(days, F.lit(0), F.lit(0), F.pmod(s, F.lit(86400)).cast("decimal(18,6)"))


def hour_bucket(seconds) -> Column:
    """T2 ``%Y-%m-%d %H`` in UTC."""
    return F.substring_index(seconds_to_ntz(seconds).cast("string"), ":", 1)


def minute_text(seconds) -> Column:
    """T2 ``%Y-%m-%d %H:%i`` in UTC."""
    return F.substring_index(seconds_to_ntz(seconds).cast("string"), ":", 2)
