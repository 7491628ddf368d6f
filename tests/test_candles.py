"""Candlestick patterns on drawn bars: what they find, what they wait for, what they cost."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlume.operators import candles
from barlume.operators.indicators import add_indicators, by_function

#: Ten bars of body 2 and range 4 go before each drawing, around 100.
USUAL = [(99, 102, 98, 101), (101, 102, 98, 99)] * 5

#: Name: (bars of the pattern as open, high, low, close, its value).
DRAWN = {
    "MARUBOZU": ([(100, 106.1, 99.9, 106)], 100), "SPINNINGTOP": ([(100, 101.5, 98, 99.5)], -100), "DRAGONFLYDOJI": ([(100, 100.2, 96, 100.1)], 100), "GRAVESTONEDOJI": ([(100, 104, 99.9, 100)], 100),
    "LONGLINE": ([(106, 107, 99, 100)], -100), "BELTHOLD": ([(100, 107, 99.9, 104)], 100), "HAMMER": ([(101, 102, 98, 99), (97.5, 98.6, 94, 98.5)], 100), "HANGINGMAN": ([(99, 102, 98, 101), (103, 104.1, 100, 104)], -100),
    "INVERTEDHAMMER": ([(101, 102, 98, 99), (97, 101, 96.9, 98)], 100), "SHOOTINGSTAR": ([(99, 102, 98, 101), (102, 106, 101.9, 103)], -100), "HARAMI": ([(106, 107, 99, 100), (102, 104, 101, 103)], 100),
    "HARAMICROSS": ([(100, 107, 99, 106), (103, 104, 102, 103)], -100), "PIERCING": ([(106, 107, 99, 100), (98, 105, 97, 104)], 100), "DARKCLOUDCOVER": ([(100, 107, 99, 106), (108, 109, 101, 102)], -100),
    "KICKING": ([(104, 104.1, 99.9, 100), (106, 112.1, 105.9, 112)], 100), "DOJISTAR": ([(106, 107, 99, 100), (98, 99, 97, 98.1)], 100), "MATCHINGLOW": ([(104, 105, 99, 100), (102, 103, 99, 100.5)], 100),
    "SEPARATINGLINES": ([(104, 105, 99, 100), (104, 109, 103.9, 108)], 100), "3WHITESOLDIERS": ([(100, 104.1, 99, 104), (103, 107.1, 102, 107), (106, 110.1, 105, 110)], 100),
    "3BLACKCROWS": ([(110, 111, 105.9, 106), (107, 108, 102.9, 103), (104, 105, 99.9, 100)], -100), "MORNINGSTAR": ([(106, 107, 99, 100), (98, 99, 96, 99), (100, 104, 99, 103)], 100),
    "EVENINGSTAR": ([(100, 107, 99, 106), (108, 110, 107, 107), (106, 107, 101, 102)], -100), "MORNINGDOJISTAR": ([(106, 107, 99, 100), (98, 99, 96, 98), (100, 104, 99, 103)], 100),
    "EVENINGDOJISTAR": ([(100, 107, 99, 106), (108, 110, 107, 108), (106, 107, 101, 102)], -100), "3INSIDE": ([(106, 107, 99, 100), (102, 104, 101, 103), (103, 109, 102, 108)], 100),
    "3OUTSIDE": ([(102, 103, 100, 101), (100, 105, 99, 104), (104, 107, 103, 106)], 100), "TRISTAR": ([(100, 101, 99, 100), (104, 105, 103, 104), (100, 101, 99, 100)], -100), "HIKKAKE": ([(100, 106, 94, 101), (100, 104, 96, 101), (100, 103, 95, 101)], 100),
}


def table(bars: list[tuple], symbol: str = "A") -> pd.DataFrame:
    out = pd.DataFrame(bars, columns=["open", "high", "low", "close"]).astype(float)
    return out.assign(symbol=symbol, timestamp=pd.date_range("2024-01-01", periods=len(out)), volume=1.0)


@pytest.fixture(scope="module")
def found(spark):
    """All patterns over all drawings in one plan, each drawing a symbol, once as drawn and once with a bar too few before it."""
    bars = pd.concat([table(before + drawn, f"{name}{kind}") for name, (drawn, _) in DRAWN.items() for kind, before in (("", USUAL), (" early", USUAL[1:]))])
    df = add_indicators(spark.createDataFrame(bars), [(f"CDL{name}", {}) for name in DRAWN])
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # all patterns over one ordering
    return df.toPandas().sort_values(["symbol", "timestamp"]).groupby("symbol")


def test_every_pattern_is_drawn():
    assert DRAWN.keys() == candles.PATTERNS.keys()


@pytest.mark.parametrize("name", DRAWN)
def test_a_pattern_is_found_on_its_last_bar_only(found, name):
    values = found.get_group(name)[f"CDL{name}_integer"].tolist()
    assert values[-1] == DRAWN[name][1] and not any(values[:-1])
    assert not any(found.get_group(f"{name} early")[f"CDL{name}_integer"])  # nothing to measure against


def after(spark, more: list[tuple], name: str = "HIKKAKE") -> list[int]:
    """Values on the pattern's last bar and on the bars after it."""
    out = by_function(f"CDL{name}", spark.createDataFrame(table(USUAL + DRAWN[name][0] + more)))
    return out.orderBy("timestamp").toPandas()[f"CDL{name}_integer"].tolist()[9 + len(DRAWN[name][0]) :]


def test_confirmation(spark):
    still, beyond = (100, 103.5, 94.5, 101), (100, 108, 94.5, 105)  # the second bar's high is 104
    assert after(spark, [beyond, beyond]) == [100, 200, 0]  # confirmed once
    assert after(spark, [still, still, beyond]) == [100, 0, 0, 200]
    assert after(spark, [still, still, still, beyond])[-1] == 0  # too late
    assert after(spark, [(100, 104.5, 94.5, 104)]) == [100, 0]  # at the high is not beyond it


def test_a_null_price_is_no_pattern(spark):
    df = spark.createDataFrame(table(USUAL + DRAWN["HARAMI"][0])).withColumn("open", F.when(F.col("timestamp") != "2024-01-05", F.col("open")))
    assert by_function("CDLHARAMI", df).filter("CDLHARAMI_integer <> 0").count() == 0
