"""Bars out of the driver's tables, for the query catalogue.

Daily bars: trades are line items, the symbol is the part's brand, the price
its retail price, the volume the quantity. Hourly bars: ticks are events, the
price the value plus one, the volume their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlume.functions.times import instant
from barlume.sources.bars import from_trades

BENCHMARK = "Brand#11"
SPOT = 950.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_order() -> Column:
    """Order, line, supplier and part in one number, in that order of weight: 15, 2, 10 and 11 digits."""
    shift = lambda digits: F.lit("1" + "0" * digits).cast("decimal(22,0)")
    line = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("decimal(17,0)")
    return (line * shift(21) + F.col("l_suppkey").cast("decimal(10,0)") * shift(11) + F.col("l_partkey")).cast("decimal(38,0)")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    trades = items.join(parts, items["l_partkey"] == parts["p_partkey"])
    return from_trades(trades, F.col("p_brand"), F.col("l_shipdate"), F.col("p_retailprice"), F.col("l_quantity"), trade_order())


def tick_order() -> Column:
    """Microseconds and event in one number: 17 and 20 digits."""
    micros = F.unix_micros(instant(F.col("ts"), "timestamp_ntz")).cast("decimal(17,0)")
    return (micros * F.lit("1" + "0" * 20).cast("decimal(21,0)") + F.col("event_id").cast("decimal(20,0)")).cast("decimal(38,0)")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = read(spark, sf_dir, "events")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return from_trades(ticks, F.col("event_type"), hour, F.col("value") + 1, F.lit(1.0), tick_order())


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as contracts: strike, years to expiry, volatility; the odd ones are puts."""
    rows = read(spark, sf_dir, "part")
    return rows.select(
        F.col("p_partkey").alias("contract"), F.col("p_retailprice").alias("strike"), (F.col("p_size") / F.lit(365.0)).alias("years"), F.col("p_size").alias("days"),
        (F.lit(0.1) + F.col("p_size") / F.lit(100.0)).alias("sigma"), F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("option_type"),
    )


BARS = """bars AS (SELECT p_brand AS symbol, l_shipdate AS timestamp, first(p_retailprice ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey) AS open, max(p_retailprice) AS high,
  min(p_retailprice) AS low, last(p_retailprice ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
HOURS = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS timestamp, first(value + 1 ORDER BY ts, event_id) AS open, max(value + 1) AS high,
  min(value + 1) AS low, last(value + 1 ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL)"""
CHAIN = """chain AS (SELECT p_partkey AS contract, p_retailprice AS strike, p_size / 365.0::DOUBLE AS years, p_size AS days, 0.1::DOUBLE + p_size / 100.0::DOUBLE AS sigma,
  CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS option_type FROM part)"""
