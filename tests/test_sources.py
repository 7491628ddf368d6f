"""The bar contract, providers, the lake, resampling."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlume.operators import scanners
from barlume.sources import bars as S
from barlume.sources import contract as C
from barlume.sources import lake as L
from barlume.sources import providers as P
from tests.conftest import made_bars, path


def test_normalize_aliases_and_keep_last(spark):
    raw = spark.createDataFrame([("2024-01-02", 1.0, 2.0, 0.5, 1.5, 100), ("2024-01-02", 1.0, 3.0, 0.5, 2.5, 200), ("2024-01-03", 1.0, 2.0, 0.5, float("nan"), 1)], "Date string, Open double, High double, Low double, `Adj Close` double, Vol int").coalesce(1)
    found = C.normalize(raw, "X").orderBy("timestamp").collect()
    assert [(r["symbol"], r["close"], r["volume"]) for r in found] == [("X", 2.5, 200.0), ("X", None, 1.0)]
    with pytest.raises(ValueError, match="missing"):
        C.normalize(raw.drop("Open"), "X")
    with pytest.raises(ValueError, match="no bars"):
        C.normalize(raw.limit(0), "X")


def test_times_are_utc_in_any_session(spark):
    """Naive times are read as UTC, bounds and days too, whatever the session's zone is."""
    micros = lambda df: [r[0] for r in df.select(F.unix_micros("timestamp")).orderBy(F.unix_micros("timestamp")).collect()]
    midnight, hour = 1_709_251_200_000_000, 3_600_000_000  # 2024-03-01
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = [("2024-03-01",), ("2024-03-01 01:00:00",), ("2024-03-01T04:00:00+02:00",), ("2024-03-01T03:00:00Z",), ("2024-03-10 02:30:00",)]
            text = spark.createDataFrame(rows, "timestamp string").selectExpr("timestamp", "1D open", "2D high", "1D low", "1D close", "1L volume")
            want = [midnight + k * hour for k in (0, 1, 2, 3)] + [midnight + (9 * 24 + 2.5) * hour]
            assert micros(C.normalize(text, "X")) == want, zone
            bare = text.filter("timestamp NOT LIKE '%T%'")
            assert micros(C.normalize(bare.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), "X")) == [want[0], want[1], want[4]]
            assert micros(C.normalize(bare.withColumn("timestamp", F.col("timestamp").cast("date")), "X")) == [midnight, midnight + 9 * 24 * hour]
            bars = C.normalize(text, "X")
            provider = P.FrameProvider(spark, bars)
            assert micros(provider.get_ohlcv("X", "2024-03-01 01:00:00", "2024-03-01T02:00:00Z")) == want[1:3]
            assert micros(S.resample(bars, "1d")) == [midnight, midnight + 9 * 24 * hour]
            assert micros(S.resample(bars, "2h")) == [midnight, midnight + 2 * hour, midnight + (9 * 24 + 2) * hour]
            assert micros(P.get_provider("synthetic", spark=spark, days=2).get_ohlcv("A")) == [1_577_836_800_000_000, 1_577_923_200_000_000]
            assert scanners.orb_features(bars.withColumn("symbol", F.lit("X")), 1).collect()[0]["last"] == 1.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_adjusted_prices(spark):
    raw = spark.createDataFrame([("2024-01-02", 1.0, 9.0, 0.5, 4.0, 2.0, 5)], "Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume int")
    assert C.normalize(raw, "X").first()["close"] == 2.0 and C.normalize(raw, "X", adjust=False).first()["close"] == 4.0
    assert C.normalize(raw.drop("Close"), "X", adjust=False).first()["close"] == 2.0
    provider = P.FrameProvider(spark, raw.withColumnRenamed("Date", "timestamp").withColumn("symbol", F.lit("X")))
    assert [provider.get_ohlcv("X", adjust=a).first()["close"] for a in (True, False)] == [2.0, 4.0]


def test_trades_are_aggregated_by_hash(spark):
    trades = spark.createDataFrame([("A", 1, 5.0, 2, 1.0), ("A", 1, 4.0, 1, 2.0), ("A", 1, 6.0, 3, 3.0)], "s string, day int, p double, k long, q double")
    bars = S.from_trades(trades, F.col("s"), F.col("day"), F.col("p"), F.col("q"), F.col("k").cast("decimal(38,0)"))
    assert tuple(bars.first()) == ("A", 1, 4.0, 6.0, 4.0, 6.0, 6.0)
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_validate(spark):
    good = spark.createDataFrame(made_bars(20))
    assert C.validate(good) is good
    for bad in (good.withColumn("high", F.lit(0.0)), good.withColumn("volume", F.lit(-1.0)), good.unionByName(good)):
        with pytest.raises(AssertionError, match="XYZ"):
            C.validate(bad, "XYZ")
    with pytest.raises(AssertionError):
        C.validate_rows([("A", 2), ("A", 1)])
    with pytest.raises(ValueError):
        C.check_timeframe("7d")
    assert C.annualization_factor("2m") == 252 and C.resample_factor("W-FRI") == 52 and C.resample_factor("30min") == 252 and C.resample_factor("min") == 12


def test_providers(spark, tmp_path):
    frame = P.FrameProvider(spark, spark.createDataFrame(pd.concat([made_bars(30, symbol=s) for s in ("AAA", "BBB")])))
    assert frame.get_ohlcv("AAA", "2019-03-05", "2019-03-07").count() == 3
    assert frame.get_ohlcv_multi([]).columns == [f.name for f in C.BARS_SCHEMA]
    assert frame.get_ohlcv_multi(["AAA", "BBB"]).count() == 60
    with pytest.raises(ValueError):
        frame.get_ohlcv("NONE")
    with pytest.raises(KeyError):
        P.get_provider("nowhere")
    P.register_provider("Mine", lambda **kw: frame)
    assert P.get_provider("MINE") is frame
    made = P.get_provider("synthetic", spark=spark, days=40)
    assert made.get_ohlcv_multi(["A", "B"]).count() == 80
    cached = P.CachedProvider(made, str(tmp_path / "cache"))
    first = cached.get_ohlcv("A").orderBy("timestamp").toPandas()
    pd.testing.assert_frame_equal(first, cached.get_ohlcv("A").orderBy("timestamp").toPandas())
    with pytest.raises(NotImplementedError):
        made.get_options_chain("A")


def test_option_chain(spark):
    calls = spark.createDataFrame([(100.0, 1.0)], "Strike double, Bid double")
    puts = spark.createDataFrame([(90.0, 2.0, 3)], "Strike double, Bid double, OpenInterest int")
    p = P.FrameProvider(spark, calls, {"X": {"2024-02-01": (calls, puts), "2024-01-01": (calls, puts)}})
    found = p.get_options_chain("X").collect()
    assert {(r["option_type"], r["expiry"], r["strike"]) for r in found} == {("call", "2024-01-01", 100.0), ("put", "2024-01-01", 90.0)}
    with pytest.raises(ValueError):
        p.get_options_chain("X", "2030-01-01")


def test_lake_upsert_and_sql(spark, tmp_path):
    lake = L.Lake(spark, str(tmp_path / "lake"))
    a = spark.createDataFrame(pd.concat([path([1.0, 2, 3], "123"), path([5.0, 6, 7], "B")]))
    assert lake.write(a) == 6
    newer = a.filter("symbol = '123'").withColumn("close", F.col("close") + 10).filter("close > 11.5")
    assert lake.write(newer) == 2
    rows = lake.scan().orderBy("symbol", "timestamp").collect()
    assert [(r["symbol"], r["close"]) for r in rows] == [("123", 1), ("123", 12), ("123", 13), ("B", 5), ("B", 6), ("B", 7)]
    latest = lake.query("WITH x AS (SELECT * FROM lake) SELECT symbol, close FROM x QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1 ORDER BY symbol")
    assert [tuple(r) for r in latest.collect()] == [("123", 13.0), ("B", 7.0)]
    plan = lake.scan().filter("symbol = 'B'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan
    assert lake.ingest(P.get_provider("synthetic", spark=spark, days=5), ["Q"]) == 5


def test_resample(spark):
    bars = spark.createDataFrame(path(list(range(1, 16))))  # from Tuesday, 1 February 2022, on every third day
    weekly = S.resample(bars, "W-FRI").orderBy("timestamp").collect()
    assert [(str(r["timestamp"].date()), r["open"], r["close"], r["volume"]) for r in weekly][:3] == [("2022-02-04", 1, 2, 3e3), ("2022-02-11", 2, 4, 7e3), ("2022-02-18", 4, 6, 11e3)]
    assert all(r["timestamp"].weekday() == 4 for r in weekly) and sum(r["volume"] for r in weekly) == 120e3
    assert S.resample(bars, "M").count() == 2
    with pytest.raises(ValueError):
        S.resample(bars, "fortnight")


def test_data_source(spark):
    from barlume.sources import datasource

    datasource.register(spark)
    df = spark.read.format("bars").option("symbols", "A,B").option("days", "30").load()
    assert df.count() == 60 and df.rdd.getNumPartitions() == 2
    assert C.validate(C.normalize(df)).select("symbol").distinct().count() == 2
