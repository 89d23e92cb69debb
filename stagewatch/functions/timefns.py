"""Time functions (C8-C10, C12, C16) on TIMESTAMP_NTZ, independent of the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _epoch() -> Column:
    # A TIMESTAMP_NTZ literal: no session time zone is involved anywhere below.
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def from_epoch_ms(ms: Column | str) -> Column:
    """Epoch milliseconds -> TIMESTAMP_NTZ (UTC wall clock)."""
    return from_epoch_us(_col(ms).cast("long") * 1000)


def to_epoch_us(ts: Column | str) -> Column:
    """Microseconds since the epoch of a wall-clock (NTZ) time, by interval arithmetic
    (NTZ - NTZ is a day-time interval), so the session zone never applies."""
    iv = _col(ts) - _epoch()
    days = F.extract(F.lit("DAY"), iv).cast("long")
    hours = F.extract(F.lit("HOUR"), iv).cast("long")
    mins = F.extract(F.lit("MINUTE"), iv).cast("long")
    secs_us = (F.extract(F.lit("SECOND"), iv) * 1_000_000).cast("long")
    return ((days * 24 + hours) * 60 + mins) * 60_000_000 + secs_us


def from_epoch_us(us: Column | str) -> Column:
    """Inverse of ``to_epoch_us``: NTZ epoch plus an interval."""
    u = _col(us).cast("long")
    days = F.floor(u / 86_400_000_000).cast("int")
    rest = (u - days.cast("long") * 86_400_000_000).cast("decimal(20,0)") / 1_000_000
    return _epoch() + F.make_dt_interval(days=days, secs=rest.cast("decimal(18,6)"))


def to_epoch_ms(ts: Column | str) -> Column:
    """Inverse of C8: epoch milliseconds, rounded to the nearest (half up)."""
    return F.round(to_epoch_us(ts) / 1000).cast("long")


def to_epoch_s(ts: Column | str) -> Column:
    """Epoch seconds, truncated."""
    return F.floor(to_epoch_us(ts) / 1_000_000).cast("long")


def with_offset(ts: Column | str, days: float = 0, minutes: float = 0, ahead: bool = True, ms: bool = True) -> Column:
    """Timestamp +/- days and minutes, as epoch ms (or s when ``ms`` is false)."""
    delta_us = int(round((days * 86400 + minutes * 60) * 1_000_000))
    us = to_epoch_us(ts) + F.lit(delta_us if ahead else -delta_us)
    return F.round(us / 1000).cast("long") if ms else F.floor(us / 1_000_000).cast("long")


FIXED_UNITS_US = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def truncate(ts: Column | str, unit: str = "minute") -> Column:
    """DATE_TRUNC / bin to a unit; NTZ stays NTZ. Fixed-width units are floored
    in epoch microseconds (no zone involved); calendar units use date_trunc."""
    u = unit.lower()
    if u in FIXED_UNITS_US:
        w = FIXED_UNITS_US[u]
        return from_epoch_us(F.floor(to_epoch_us(ts) / w).cast("long") * w)
    return F.date_trunc(u, _col(ts)).cast("timestamp_ntz")


def now_ms(as_of: Column | None = None) -> Column:
    """Current time in epoch ms; pass ``as_of`` for repeatable results."""
    return to_epoch_ms(as_of if as_of is not None else F.localtimestamp())
