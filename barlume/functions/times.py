"""Times in UTC, whatever the session's time zone.

A timestamp is an instant; one without a zone (``timestamp_ntz``), a date and a
string without an offset are read as wall clocks in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ZONED = r":\d{2}(\.\d+)?\s*(Z|UTC|GMT|[+-]\d{2}:?\d{2})\s*$"


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def instant(x: Column, kind: str) -> Column:
    """The instant of a column of that type; numbers are seconds since 1970."""
    if kind in ("string", "date", "timestamp_ntz") or kind.startswith(("varchar", "char")):
        wall = F.timestamp_seconds(F.lit(0)) + (x.cast("timestamp_ntz") - _epoch())
        return wall if kind in ("date", "timestamp_ntz") else F.when(x.rlike(_ZONED), x.cast("timestamp")).otherwise(wall)
    return x.cast("timestamp")


def wall(x: Column, kind: str) -> Column:
    """The wall clock in UTC, as a timestamp without a zone."""
    if kind != "timestamp":
        return x.cast("timestamp_ntz")
    return _epoch() + F.make_dt_interval(secs=(F.unix_micros(x).cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))


def wall_of(df: DataFrame, column: str = "timestamp") -> Column:
    return wall(F.col(column), dict(df.dtypes)[column])
