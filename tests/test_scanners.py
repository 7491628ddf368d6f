"""Scanners, sessions, labels, folds, options, streams."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlume.functions.scalar import norm_cdf, norm_cdf_sql
from barlume.operators import learning, options, scanners
from tests.conftest import made_bars, path


@pytest.fixture(scope="module")
def universe(spark):
    return spark.createDataFrame(pd.concat([made_bars(320, seed=k, symbol=s, drift=0.001 - 0.0004 * k) for k, s in enumerate(("SPY", "AAA", "BBB", "CCC", "DDD"))])).cache()


@pytest.mark.parametrize("name", sorted(scanners.available_setups()))
def test_setups(universe, name):
    which = scanners.available_setups()[name]
    snapshot = scanners.latest_snapshot(universe, "SPY").cache()
    assert snapshot.count() == 5
    hits = scanners.scan_snapshot(snapshot, which, "mom20", min_dollar_vol=1e6).toPandas()
    mask = snapshot.filter(which(snapshot.columns, min_dollar_vol=1e6))
    assert set(hits["symbol"]) == {r["symbol"] for r in mask.collect()}
    assert list(hits["mom20"]) == sorted(hits["mom20"], reverse=True)
    assert len(scanners.scan_snapshot(snapshot, which, top=1, min_dollar_vol=1e6).collect()) <= 1
    without = scanners.latest_snapshot(universe, "NONE")
    assert "rs" not in without.columns
    if name == "relative_strength":
        assert scanners.scan_snapshot(without, which).count() == 0
    with pytest.raises(ValueError):
        scanners.scan_snapshot(snapshot, which, "colour")


def test_benchmark_is_carried_along_own_bars(spark):
    a = path([1.0, 2, 3, 4])
    bench = spark.createDataFrame(path([10.0, 20, 30, 40]).iloc[[0, 2]])
    found = scanners.benchmark_line(spark.createDataFrame(a), bench).orderBy("timestamp").toPandas()["bench"].tolist()
    assert found == [10, 10, 30, 30]


def test_opening_range(spark):
    def session(symbol, highs):
        times = pd.date_range("2024-03-01 14:30", periods=len(highs), freq="5min")
        h = np.array(highs, float)
        return pd.DataFrame({"symbol": symbol, "timestamp": times, "open": h - 1, "high": h, "low": h - 2, "close": h - 1, "volume": 1e4})

    bars = spark.createDataFrame(pd.concat([session("UP", [5, 6, 5, 7]), session("FLAT", [5, 6, 5, 6]), session("SHORT", [5, 6])]))
    found = {r["symbol"]: r for r in scanners.orb_features(bars, 2).collect()}
    assert (found["UP"]["orb_up"], found["FLAT"]["orb_up"], found["SHORT"]["orb_up"]) == (True, False, False)
    assert found["UP"]["or_high"] == 6 and found["UP"]["or_low"] == 3 and found["SHORT"]["or_high"] is None
    assert [r["symbol"] for r in scanners.orb_scan(bars, 2, 1e4).collect()] == ["UP"]


def test_triple_barrier_against_a_loop(spark):
    bars = made_bars(120, seed=3)
    c = bars["close"].to_numpy()
    vol = bars["close"].pct_change().rolling(20).std().to_numpy()
    found = learning.triple_barrier(spark.createDataFrame(bars), 10, 1.5, 1.0).orderBy("timestamp").toPandas()
    for i in range(len(c)):
        if np.isnan(vol[i]) or i + 10 > len(c) - 1:
            assert pd.isna(found["label"][i])
            continue
        ahead = c[i + 1 : i + 11]
        up, down = np.flatnonzero(ahead >= c[i] * (1 + 1.5 * vol[i])), np.flatnonzero(ahead <= c[i] * (1 - vol[i]))
        u, d = (x[0] if len(x) else 99 for x in (up, down))
        want = 0 if u == d == 99 else 1 if u <= d else -1
        touch = 10 if want == 0 else min(u, d) + 1
        assert (found["label"][i], found["touch_idx"][i]) == (want, touch)
        assert found["label_ret"][i] == pytest.approx(c[i + touch] / c[i] - 1)


def test_folds(spark):
    assert learning.fold_bounds(11, 3) == [(0, 4), (4, 8), (8, 11)]
    rows = spark.createDataFrame(made_bars(103)[["symbol", "timestamp"]])
    found = learning.purged_folds(rows, 5, 7, 0.05).toPandas()
    for k, (a, b) in enumerate(learning.fold_bounds(103, 5)):
        part = found[found["fold"] == k]
        roles = dict(zip(part["row"], part["role"], strict=True))
        want = {i: "test" if a <= i < b else "purged" if a - 7 <= i < a else "embargoed" if b <= i < b + 5 else "train" for i in range(103)}
        assert roles == want
    assert learning.time_split(rows, 0.25).filter("is_test").count() == 103 - int(103 * 0.75)


def test_features_and_models(spark, universe):
    df = learning.make_features(universe).withColumn("label", learning.binary_label(5))
    names = learning.feature_names()
    rows = learning.complete(df, [*names, "label"])
    assert rows.filter(" OR ".join(f"{c} IS NULL" for c in names)).count() == 0
    folds = learning.purged_auc(df, names, n_splits=2, label_horizon=5).collect()
    assert all(0 <= r["auc"] <= 1 for r in folds) and len(folds) == 2
    scored, ranks = learning.boosted(df, names, rounds=3)
    assert scored.filter("proba < 0 OR proba > 1").count() == 0 and ranks.count() == len(names)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normal_distribution(spark):
    import duckdb

    xs = np.linspace(-9, 9, 181)
    found = spark.createDataFrame([(float(x),) for x in xs], "x double").select(norm_cdf(F.col("x")).alias("p")).toPandas()["p"]
    want = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs])
    np.testing.assert_allclose(found, want, atol=1e-13)
    sql = duckdb.sql(f"SELECT {norm_cdf_sql('x')} FROM (SELECT unnest({xs.tolist()}) AS x)").fetchall()
    np.testing.assert_allclose([r[0] for r in sql], want, atol=1e-13)


def test_options(spark):
    s, k, t, r = 100.0, 95.0, 0.75, 0.03
    call, put = (value(spark, options.bs_price(s, k, t, r, 0.3, kind)) for kind in ("call", "put"))
    assert call - put == pytest.approx(s - k * math.exp(-r * t), abs=1e-8)
    for sigma in (0.1, 0.25, 0.6):
        assert value(spark, options.implied_vol(options.bs_price(s, k, t, r, sigma), s, k, t, r)) == pytest.approx(sigma, abs=1e-3)
    assert value(spark, options.implied_vol(1.0, s, 50.0, t, r)) is None
    g = options.greeks(s, k, t, r, 0.3)
    bump = lambda f: (value(spark, f(1e-4)) - value(spark, f(-1e-4))) / 2e-4
    assert value(spark, g["delta"]) == pytest.approx(bump(lambda e: options.bs_price(s + e, k, t, r, 0.3)), abs=1e-5)
    assert value(spark, g["vega"]) == pytest.approx(bump(lambda e: options.bs_price(s, k, t, r, 0.3 + e)), abs=1e-3)
    assert value(spark, g["rho"]) == pytest.approx(bump(lambda e: options.bs_price(s, k, t, r + e, 0.3)), abs=1e-3)
    assert value(spark, g["theta"]) == pytest.approx(-bump(lambda e: options.bs_price(s, k, t + e, r, 0.3)), abs=1e-3)
    with pytest.raises(ValueError):
        options.bs_price(s, k, t, r, 0.3, "straddle")


def test_stream(spark, tmp_path):
    from barlume.streaming.bars import stream_bars, stream_ewma

    ticks = pd.DataFrame({"symbol": "A", "timestamp": pd.date_range("2024-01-01", periods=240, freq="10min"), "price": np.arange(240.0) + 1, "quantity": 1.0})
    spark.createDataFrame(ticks).coalesce(1).write.parquet(str(tmp_path / "ticks"))
    source = spark.readStream.schema("symbol string, timestamp timestamp, price double, quantity double").parquet(str(tmp_path / "ticks"))
    q = stream_bars(source).writeStream.format("memory").queryName("bars_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT * FROM bars_out ORDER BY timestamp").collect()
    assert rows[0]["open"] == 1 and rows[0]["close"] == 6 and rows[0]["volume"] == 6 and len(rows) >= 36
    q = stream_ewma(source.withColumnRenamed("price", "close"), 3).writeStream.format("memory").queryName("ewma_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    found = spark.sql("SELECT ewma FROM ewma_out ORDER BY timestamp").toPandas()["ewma"]
    np.testing.assert_allclose(found, pd.Series(np.arange(240.0) + 1).ewm(span=3, adjust=False).mean())
