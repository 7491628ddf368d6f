"""One local session for all tests, and seeded bars."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


def made_bars(n: int = 300, seed: int = 5, symbol: str = "AAA", drift: float = 0.0, vol: float = 0.015) -> pd.DataFrame:
    """Seeded daily bars of one symbol, each out of twelve ticks: gaps over night, calm and rough spells, a day in twenty without trade."""
    rng = np.random.default_rng([seed, 1234])
    rough = np.where((np.arange(n) // 45 + seed) % 3 == 0, 1.7, 0.8)
    moves = rng.laplace(0, vol / 5, (n, 12)) * rough[:, None] + drift / 12
    moves[:, 0] += rng.normal(0, vol / 3, n)
    ticks = (35 + 9 * seed) * np.exp(moves.ravel().cumsum()).reshape(n, 12)
    days = pd.bdate_range("2019-03-04", periods=n + n // 19 + 1)
    days = days[np.arange(len(days)) % 20 != 13][:n]
    return pd.DataFrame({
        "symbol": symbol, "timestamp": days, "open": ticks[:, 0], "high": ticks.max(1), "low": ticks.min(1), "close": ticks[:, -1], "volume": rng.lognormal(15, 0.4, n).round(),
    })


def path(closes: list[float], symbol: str = "AAA") -> pd.DataFrame:
    """Bars of given closes: each opens where the last one closed, with wicks of a tenth of its price, on every third day."""
    rows, before = [], float(closes[0])
    for k, close in enumerate(map(float, closes)):
        wick = 0.1 * max(before, close)
        rows.append((symbol, pd.Timestamp("2022-02-01") + pd.Timedelta(days=3 * k), before, max(before, close) + wick, min(before, close) - wick, close, 1000.0 * (k + 1)))
        before = close
    return pd.DataFrame(rows, columns=["symbol", "timestamp", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="session")
def panel(spark):
    return spark.createDataFrame(pd.concat([made_bars(seed=k, symbol=s) for k, s in enumerate(("AAA", "BBB", "SPY"))])).cache()
