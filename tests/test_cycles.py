"""Cycle indicators on made waves, EMA's seeds, frames from and to pandas and Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from barlume.operators import cycles
from barlume.operators.indicators import by_function, combine
from tests.conftest import made_bars

AT = np.arange(500)


@pytest.mark.parametrize("period", [8, 10, 15, 20.5, 30, 40])
@pytest.mark.parametrize("size, drift", [(5.0, 0.0), (0.4, 0.0), (3.0, 0.01)])
def test_the_period_of_a_wave_is_found(period, size, drift):
    found = cycles.periods(100 + size * np.sin(2 * np.pi * AT / period + 1) + drift * AT)
    assert np.allclose(found[150:], period, rtol=0.05)


@pytest.mark.parametrize("period", [12, 20, 30])
def test_phase_turns_with_the_wave_and_mode_tells_waves_from_trends(period):
    wave = 100 + 0.5 * np.sin(2 * np.pi * AT / period)
    steps = np.diff(cycles.phase(wave)[200:]) % 360
    assert np.allclose(np.median(steps), 360 / period, rtol=0.1)
    assert np.corrcoef(cycles.sines(wave)[0][200:], wave[200:])[0, 1] > 0.9
    assert cycles.trend_mode(wave)[200:].mean() < 0.1 and cycles.trend_mode(100 + AT * 0.5)[60:].mean() == 1
    assert np.allclose(cycles.trend_line(wave)[200:], 100, atol=0.15)


@pytest.mark.parametrize("n", [0, 1, 5, 32, 33])
def test_short_and_flat_series(n):
    for x in (np.full(n, 7.0), made_bars(n or 1)["close"].to_numpy()[:n]):
        for f in (cycles.phase, cycles.trend_line, cycles.trend_mode, lambda v: cycles.sines(v)[1]):
            out = f(x)
            assert len(out) == n and np.isnan(out[:32]).all() and np.isfinite(out[32:]).all()


def test_by_usual_names(spark):
    df = spark.createDataFrame(made_bars(60))
    got = by_function("HT_SINE", df)
    assert got.columns == ["symbol", "timestamp", "HT_SINE_sine", "HT_SINE_leadsine"] and got.filter("HT_SINE_sine IS NULL").count() == 32
    assert by_function("HT_TRENDMODE", df).filter("HT_TRENDMODE_real IN (0, 1)").count() == 28
    with pytest.raises(NotImplementedError):
        by_function("HT_PHASOR", df)


def test_seeds_of_an_exponential_average(spark):
    bars = made_bars(50)
    df = spark.createDataFrame(bars)
    got = by_function("EMA", df, timeperiod=10, seed="mean").orderBy("timestamp").toPandas()["EMA_real"].astype(float).to_numpy()
    y = bars["close"][:10].mean()
    assert np.isnan(got[:9]).all() and np.isclose(got[9], y)
    for t in range(10, 50):
        y += 2 / 11 * (bars["close"][t] - y)
        assert np.isclose(got[t], y)
    assert by_function("EMA", df.limit(5), timeperiod=10, seed="mean").filter("EMA_real IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="seed"):
        combine(df, [("ewma", {"seed": "last"})])


def test_frames_survive_pandas_and_arrow(spark):
    """What indicators add comes back from pandas and Arrow as it went: nulls of warm-ups, times, whole numbers."""
    df = combine(spark.createDataFrame(made_bars(40)), [("rsi", {"window": 14}), ("cdldoji", {}), ("sma", {"window": 5})])
    want = sorted(tuple(r) for r in df.collect())
    by_arrow = spark.createDataFrame(df.toArrow())
    assert by_arrow.dtypes == df.dtypes and sorted(tuple(r) for r in by_arrow.collect()) == want
    frame = df.toPandas()
    by_pandas = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).assign(timestamp=pd.to_datetime(frame["timestamp"])), df.schema)
    assert [str(r) for r in sorted(tuple(r) for r in by_pandas.collect())] == [str(r) for r in want]
