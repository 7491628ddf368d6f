"""Recursive indicators: what a bar's value owes to the one before it.

Pure functions on arrays of one symbol's bars in order, and one grouped Arrow
map that computes any number of them for a panel. Warm-up is NaN here and null
in DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

Series = np.ndarray


def _smooth(x: Series, alpha: float, seed: float, start: int) -> Series:
    """From ``seed`` at ``start`` on, each value moves by alpha towards the next x; NaN before."""
    out = np.full(len(x), np.nan)
    if start >= len(x):
        return out
    y, rest = seed, [seed]
    for v in x[start + 1 :].tolist():
        y += alpha * (v - y)
        rest.append(y)
    out[start:] = rest
    return out


def ewma(x: Series, span: float) -> Series:
    """Exponential average with alpha 2 / (span + 1), seeded with the first value."""
    return _smooth(x, 2 / (span + 1), x[0], 0) if len(x) else np.zeros(0)


def ewma_of_mean(x: Series, span: int) -> Series:
    """The same, seeded with the mean of the first ``span`` values; NaN before those."""
    return _smooth(x, 2 / (span + 1), float(np.mean(x[:span])), span - 1) if len(x) >= span else np.full(len(x), np.nan)


def wilder(x: Series, n: int, start: int = 0) -> Series:
    """Wilder's average: the mean of n values from ``start``, then alpha 1 / n; NaN where there aren't more than n."""
    if len(x) - start < n:
        return np.full(len(x), np.nan)
    return _smooth(x, 1 / n, float(np.mean(x[start : start + n])), start + n - 1)


def rsi(x: Series, n: int = 14) -> Series:
    """Wilder's relative strength; 100 where there is no average loss."""
    if len(x) <= n:
        return np.full(len(x), np.nan)
    step = np.diff(x, prepend=x[0])
    up, down = wilder(np.maximum(step, 0), n, 1), wilder(np.maximum(-step, 0), n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(down), np.nan, np.where(down == 0, 100.0, 100 - 100 / (1 + up / down)))


def true_range(high: Series, low: Series, close: Series) -> Series:
    before = np.concatenate((close[:1], close[:-1]))
    out = np.maximum.reduce([high - low, abs(high - before), abs(low - before)])
    out[:1] = (high - low)[:1]
    return out


def atr(high: Series, low: Series, close: Series, n: int = 14) -> Series:
    """Average true range: exponential with alpha 1 / n from the first bar on."""
    return ewma(true_range(high, low, close), 2 * n - 1)


def wilder_atr(high: Series, low: Series, close: Series, n: int = 14) -> Series:
    """Average true range with Wilder's seed and warm-up."""
    return wilder(true_range(high, low, close), n) if len(close) > n else np.full(len(close), np.nan)


def supertrend(high: Series, low: Series, close: Series, n: int = 10, factor: float = 3.0) -> tuple[Series, Series]:
    """(line, direction): bands around the middle that only tighten until the close crosses one."""
    line, way = np.full(len(close), np.nan), np.ones(len(close))
    if len(close) <= n:
        return line, way
    reach = factor * wilder_atr(high, low, close, n)
    middle = (high + low) / 2
    tops, floors = (middle + reach).tolist(), (middle - reach).tolist()
    closes = close.tolist()
    top, floor, up = tops[n], floors[n], True
    line[n] = floor
    for t in range(n + 1, len(closes)):
        last, now = closes[t - 1], closes[t]
        top = tops[t] if last > top else min(top, tops[t])
        floor = floors[t] if last < floor else max(floor, floors[t])
        up = now > top or (up and now >= floor)
        line[t], way[t] = (floor, 1.0) if up else (top, -1.0)
    return line, way


def chandelier(high: Series, low: Series, close: Series, n: int = 22, factor: float = 3.0) -> Series:
    """Trailing stop of a long position: highest high since bar n less factor ATRs, never falling."""
    out = np.full(len(close), np.nan)
    if len(close) > n:
        out[n:] = np.maximum.accumulate(np.maximum.accumulate(high[n:]) - factor * wilder_atr(high, low, close, n)[n:])
    return out


def macd(x: Series, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[Series, Series, Series]:
    line = ewma(x, fast) - ewma(x, slow)
    average = ewma(line, signal)
    return line, average, line - average


def adx(high: Series, low: Series, close: Series, n: int = 14) -> Series:
    """Average directional index: Wilder averages of both directional moves and the range, then of their contrast."""
    up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
    ranges, plus, minus = (wilder(v, n, 1) for v in (true_range(high, low, close), np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)))
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = 100 * plus / ranges, 100 * minus / ranges
        contrast = np.where(np.isnan(a), np.nan, np.where(a + b == 0, 0.0, 100 * abs(a - b) / (a + b)))
    return wilder(np.nan_to_num(contrast), n, n) if len(close) > 2 * n else np.full(len(close), np.nan)


def sar(high: Series, low: Series, step: float = 0.02, most: float = 0.2) -> Series:
    """Parabolic stop and reverse; starts long at the first low."""
    out = np.full(len(high), np.nan)
    if not len(high):
        return out
    highs, lows = high.tolist(), low.tolist()
    stop, peak, pace, long = lows[0], highs[0], step, True
    out[0] = stop
    for t in range(1, len(highs)):
        stop += pace * (peak - stop)
        if long:
            stop = min(stop, *lows[max(0, t - 2) : t])
        else:
            stop = max(stop, *highs[max(0, t - 2) : t])
        if (lows[t] < stop) if long else (highs[t] > stop):
            long, stop, pace = not long, peak, step
            peak = highs[t] if long else lows[t]
        elif (highs[t] > peak) if long else (lows[t] < peak):
            peak, pace = (highs[t] if long else lows[t]), min(most, pace + step)
        out[t] = stop
    return out


def adosc(high: Series, low: Series, close: Series, volume: Series, fast: int = 3, slow: int = 10) -> Series:
    """Difference of two exponential averages of the accumulation line."""
    wide = high - low
    line = np.cumsum(np.where(wide == 0, 0.0, (2 * close - low - high) / np.where(wide == 0, 1, wide)) * volume)
    return ewma(line, fast) - ewma(line, slow)


Kernel = Callable[[pd.DataFrame], dict[str, Series]]


def apply_kernels(df: DataFrame, kernels: Sequence[tuple[tuple[str, ...], Kernel]], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add the columns of all kernels in one grouped Arrow map: one exchange by the panel's keys.

    Each kernel is its columns' names and a function of one symbol's bars in order.
    """
    names = [n for columns, _ in kernels for n in columns]
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = StructType([*kept, *(StructField(n, DoubleType()) for n in names)])

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("timestamp", kind="stable").reset_index(drop=True)
        out = {}
        for _, kernel in kernels:
            out |= kernel(bars)
        for name, values in out.items():
            bars[name] = pd.array(np.asarray(values, float), dtype="Float64") if np.isnan(values).any() else values
        return bars[[f.name for f in schema.fields]]

    return df.select([f.name for f in kept]).groupBy(*keys).applyInPandas(run, schema)
