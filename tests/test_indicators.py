"""Indicators against independent NumPy and pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barlume.operators import indicators as I
from barlume.operators import kernels as K
from tests.conftest import made_bars, path

prices = st.lists(st.floats(1, 1000), min_size=60, max_size=200).map(np.array)


def column(df, name: str, symbol: str = "AAA") -> np.ndarray:
    rows = df.filter(f"symbol = '{symbol}'").orderBy("timestamp").select(name).toPandas()[name]
    return rows.astype(float).to_numpy()


def test_windows_match_pandas(spark, panel):
    df = I.combine(panel, [("sma", {"window": 20}), ("std", {"window": 20}), ("zscore", {"window": 20}), ("ret", {"periods": 3}), ("ewma", {"span": 20}), ("wma", {"window": 5})])
    close = made_bars(seed=0)["close"]
    sma, sd = close.rolling(20).mean(), close.rolling(20).std(ddof=0)
    weights = np.arange(1, 6)
    for name, want in {
        "sma_20": sma, "std_20": sd, "zscore_20": (close - sma) / sd, "ret_3": close.pct_change(3), "ewma_20": close.ewm(span=20, adjust=False).mean(),
        "wma_5": close.rolling(5).apply(lambda x: (x * weights).sum() / 15, raw=True),
    }.items():
        np.testing.assert_allclose(column(df, name), want.to_numpy(), atol=1e-9, err_msg=name)


def test_windows_need_one_exchange_and_no_python(panel):
    df = I.combine(panel, [("sma", {"window": 20}), ("std", {"window": 50}), ("zscore", {"window": 20}), ("trange", {})])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Pandas" not in plan


def test_flat_window_and_bad_window(spark):
    df = spark.createDataFrame(path([5.0] * 30))
    assert set(column(I.combine(df, [("zscore", {"window": 20})]), "zscore_20")[19:]) == {0.0}
    with pytest.raises(ValueError):
        I.combine(df, [("sma", {"window": 0})])
    assert np.isnan(column(I.combine(df, [("sma", {"window": 31})]), "sma_31")).all()


def test_registry(panel):
    assert {"sma", "ewma", "std", "zscore", "rsi", "atr", "ret"} <= set(I.available())
    with pytest.raises(KeyError):
        I.make("nothing", panel)
    with pytest.raises(ValueError):
        I.combine(panel, [("sma", {"window": 20}), ("sma", {"window": 20, "source": "open"})])
    with pytest.raises(NotImplementedError):
        I.by_function("HT_PHASOR", panel)

    for name, (_, _, outputs) in I.FUNCTIONS.items():
        assert I.by_function(name, panel).columns[2:] == [f"{name}_{o}" for o in outputs]
    assert I.by_function("rsi", panel, timeperiod=5).columns[-1] == "RSI_real"
    with pytest.raises(KeyError):
        I.by_function("NOTHING", panel)
    assert "rsi" in I.available_by_group()["momentum"]
    assert len(I.combine(panel, I.BUNDLES["momentum"]).columns) == len(panel.columns) + 5

    @I.register("double", lambda: ("double",))
    def double(keys=("symbol",)):
        from pyspark.sql import functions as F

        return {"double": F.col("close") * 2}

    assert I.make("DOUBLE", panel).columns == ["symbol", "timestamp", "double"]


def loop_rsi(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    ups = [max(b - a, 0) for a, b in zip(x, x[1:], strict=False)]
    downs = [max(a - b, 0) for a, b in zip(x, x[1:], strict=False)]
    if len(x) <= n:
        return out
    u, d = sum(ups[:n]) / n, sum(downs[:n]) / n
    for t in range(n, len(x)):
        if t > n:
            u, d = (u * (n - 1) + ups[t - 1]) / n, (d * (n - 1) + downs[t - 1]) / n
        out[t] = 100 if d == 0 else 100 - 100 / (1 + u / d)
    return out


@given(prices)
@settings(max_examples=60, deadline=None)
def test_rsi_bounds_and_no_lookahead(x):
    found = K.rsi(x, 14)
    assert np.nanmin(found) >= 0 and np.nanmax(found) <= 100
    np.testing.assert_allclose(found, loop_rsi(x, 14), atol=1e-7)
    np.testing.assert_allclose(K.rsi(x[:40], 14), found[:40], atol=1e-12)


@given(prices)
@settings(max_examples=60, deadline=None)
def test_ranges_and_trends(x):
    high, low = x * 1.01, x * 0.99
    assert (K.atr(high, low, x) >= 0).all()
    line, way = K.supertrend(high, low, x, 10, 3.0)
    assert set(np.unique(way)) <= {1.0, -1.0} and np.isnan(line[:10]).all() and not np.isnan(line[10:]).any()
    stop = K.chandelier(high, low, x, 22)
    assert (np.diff(stop[22:]) >= 0).all() and np.isnan(stop[:22]).all()
    cut, _ = K.supertrend(high[:40], low[:40], x[:40], 10, 3.0)
    np.testing.assert_allclose(cut, line[:40])


def test_hand_vectors():
    np.testing.assert_allclose(K.ewma(np.array([1.0, 2, 3]), 3), [1, 1.5, 2.25])
    np.testing.assert_allclose(K.wilder(np.array([1.0, 2, 3, 5]), 2), [np.nan, 1.5, 2.25, 3.625])
    np.testing.assert_allclose(K.true_range(np.array([5.0, 9]), np.array([3.0, 8]), np.array([4.0, 8.5])), [2, 5])
    assert K.rsi(np.full(20, 3.0))[-1] == 100
    assert np.isnan(K.rsi(np.arange(14.0))).all()
    bars = made_bars(80)
    h, l, c = (bars[x].to_numpy() for x in ("high", "low", "close"))
    macd, signal, hist = K.macd(c)
    np.testing.assert_allclose(macd, pd.Series(c).ewm(span=12, adjust=False).mean() - pd.Series(c).ewm(span=26, adjust=False).mean())
    np.testing.assert_allclose(hist, macd - signal)
    assert np.isnan(K.adx(h, l, c)[:27]).all() and 0 <= K.adx(h, l, c)[-1] <= 100
    assert np.isfinite(K.sar(h, l)).all()


def test_nulls_do_not_spread(spark):
    bars = path([1.0, 2, 3, 4, 5, 6, 7, 8])
    bars.loc[2, "close"] = None
    found = column(I.combine(spark.createDataFrame(bars), [("sma", {"window": 3})]), "sma_3")
    np.testing.assert_allclose(found, [np.nan] * 5 + [5, 6, 7])
