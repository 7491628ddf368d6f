"""Bars built from trades and ticks, and coarser bars from finer ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.functions.times import instant, wall_of

_WEEKDAY = re.compile(r"W-(MON|TUE|WED|THU|FRI|SAT|SUN)")


def from_trades(trades: DataFrame, symbol: Column, timestamp: Column, price: Column, quantity: Column, order: Column) -> DataFrame:
    """OHLCV bars of trades: one for each symbol and timestamp, opened and closed by ``order``.

    An order of a plain type, such as a number that packs several keys, is
    aggregated by hash; a struct would have all trades sorted first.
    """
    rows = trades.select(symbol.alias("symbol"), timestamp.alias("timestamp"), price.alias("p"), quantity.alias("q"), order.alias("k"))
    return rows.groupBy("symbol", "timestamp").agg(
        F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("q").alias("volume"),
    )


def bucket(rule: str, timestamp: Column) -> Column:
    """The label of the bar into which a wall clock falls: week ends, period ends, or starts of intraday spans."""
    day = F.to_date(timestamp)
    if m := _WEEKDAY.fullmatch(rule.upper()):
        return F.next_day(F.date_sub(day, 1), m[1])
    if rule.upper() in ("M", "ME"):
        return F.last_day(day)
    if rule.upper() in ("Q", "QE"):
        return F.last_day(F.add_months(F.date_trunc("quarter", timestamp).cast("date"), 2))
    if rule.upper() in ("Y", "YE", "A"):
        return F.last_day(F.add_months(F.date_trunc("year", timestamp).cast("date"), 11))
    if rule.upper() in ("D", "1D", "B"):
        return day
    m = re.fullmatch(r"(\d+)\s*(min|m|h|hour|t)", rule, re.I)
    if not m:
        raise ValueError(f"unknown rule {rule!r}")
    return F.window(timestamp, f"{m[1]} {'hours' if m[2][0] in 'hH' else 'minutes'}")["start"]


def resample(bars: DataFrame, rule: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close, summed volume. Days and weeks are those of UTC."""
    kind = dict(bars.dtypes)["timestamp"]
    label = bucket(rule, wall_of(bars)).cast("timestamp_ntz")
    rows = bars.withColumn("__bucket", instant(label, "timestamp_ntz") if kind == "timestamp" else label.cast(kind))
    return (
        rows.groupBy(*keys, "__bucket")
        .agg(F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"))
        .withColumnRenamed("__bucket", "timestamp").dropna(subset=["open", "close"])
    )
