"""Recursive indicators over a stream of bars, as keyed state that outlives restarts.

Each indicator is a step from one bar to the next on a few numbers, the same
recursion as the batch kernels'. A symbol's state is those numbers for each
indicator and the time of its last bar; it can start from bars of the past, and
is dropped when a symbol has been silent for long enough.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

State = tuple
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _averaged(k: int, n: int, before: float, x: float) -> float:
    """Wilder's average after its k-th value, counted from 1: a sum until n are there, then the average."""
    return before + x if k < n else (before + x) / n if k == n else before + (x - before) / n


class Rsi:
    """Wilder's relative strength."""

    def __init__(self, window: int = 14) -> None:
        self.n, self.columns = window, (f"rsi_{window}",)

    kinds = (LongType(), DoubleType(), DoubleType(), DoubleType())
    start: State = (0, 0.0, 0.0, 0.0)  # bars, last close, average gain, average loss

    def step(self, state: State, high: float, low: float, close: float) -> tuple[State, tuple]:
        bars, last, up, down = state
        if bars:
            up, down = _averaged(bars, self.n, up, max(close - last, 0.0)), _averaged(bars, self.n, down, max(last - close, 0.0))
        value = None if bars < self.n else 100.0 if down == 0 else 100 - 100 / (1 + up / down)
        return (bars + 1, close, up, down), (value,)


class Supertrend:
    """Bands around the middle that only tighten until the close crosses one: (line, direction)."""

    def __init__(self, period: int = 10, multiplier: float = 3.0) -> None:
        self.n, self.factor, self.columns = period, multiplier, ("supertrend", "supertrend_dir")

    kinds = (LongType(), DoubleType(), DoubleType(), DoubleType(), DoubleType(), BooleanType())
    start: State = (0, 0.0, 0.0, 0.0, 0.0, True)  # bars, last close, average range, upper and lower band, whether up

    def step(self, state: State, high: float, low: float, close: float) -> tuple[State, tuple]:
        bars, last, wide, top, floor, up = state
        wide = _averaged(bars + 1, self.n, wide, max(high - low, abs(high - last), abs(low - last)) if bars else high - low)
        if bars < self.n:
            return (bars + 1, close, wide, 0.0, 0.0, True), (None, 1.0)
        middle, reach = (high + low) / 2, self.factor * wide
        if bars == self.n:
            top, floor = middle + reach, middle - reach
        else:
            top = middle + reach if last > top else min(top, middle + reach)
            floor = middle - reach if last < floor else max(floor, middle - reach)
            up = close > top or (up and close >= floor)
        return (bars + 1, close, wide, top, floor, up), ((floor, 1.0) if up else (top, -1.0))


class _Follow(StatefulProcessor):
    """One symbol's indicators. Bars that aren't after the last one seen are left out; of bars of one time in a batch the last counts."""

    def __init__(self, indicators: Sequence, idle: int | None) -> None:
        self.indicators, self.idle = indicators, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("at", LongType())]))
        self.states = [handle.getValueState(f"of{i}", StructType([StructField(f"x{j}", kind) for j, kind in enumerate(x.kinds)])) for i, x in enumerate(self.indicators)]

    def _advance(self, key: tuple, bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.drop_duplicates("at", keep="last").sort_values("at")
        if self.last.exists():
            bars = bars[bars["at"] > self.last.get()[0]]
        prices = [[float(x) for x in bars[c]] for c in ("high", "low", "close")]
        out = {"symbol": [key[0]] * len(bars), "at": bars["at"].tolist()}
        for x, held in zip(self.indicators, self.states, strict=True):
            state, found = held.get() if held.exists() else x.start, []
            for bar in zip(*prices, strict=True):
                state, values = x.step(state, *bar)
                found.append(values)
            if found:
                held.update(state)
            out |= {c: pd.array([v[i] for v in found], dtype="Float64") for i, c in enumerate(x.columns)}
        if len(bars):
            self.last.update((int(bars["at"].iloc[-1]),))
            if self.idle is not None:
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at if isinstance(at, int) else at[0])
                self.handle.registerTimer(self.last.get()[0] // 1000 + self.idle)
        return pd.DataFrame(out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        yield self._advance(key, pd.concat(list(rows)))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self._advance(key, initialState)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.last, *self.states):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession):
    """Streams that start inside keep their state in the store that several states a key need."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def _numbered(bars: DataFrame) -> DataFrame:
    """Bars with their time as a number, which no zone changes."""
    return bars.filter("symbol IS NOT NULL AND timestamp IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL").select(
        "symbol", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close"))
    )


def stream_indicators(bars: DataFrame, indicators: Sequence, past: DataFrame | None = None, late: str = "0 seconds", idle: int | None = None) -> DataFrame:
    """(symbol, timestamp, the indicators' columns) for each bar of a stream, in append mode.

    ``past`` holds bars from which the states of a new stream start; they give no rows.
    ``idle`` is the milliseconds of event time after a symbol's last bar at which its
    state goes, measured by the watermark, which is ``late`` behind the newest bar; without it
    state stays. Bars of a symbol must come in order from batch to batch. Bars with a
    null symbol, time or price are left out. Start the stream inside ``state_store``.
    """
    if idle is not None:
        bars = bars.withWatermark("timestamp", late)
        rows = bars.filter("symbol IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL").select("symbol", "timestamp", F.unix_micros("timestamp").alias("at"), "high", "low", "close")
    else:
        rows = _numbered(bars)
    schema = StructType([StructField("symbol", StringType()), StructField("at", LongType()), *(StructField(c, DoubleType()) for x in indicators for c in x.columns)])
    start = _numbered(past).groupBy("symbol") if past is not None else None
    out = rows.groupBy("symbol").transformWithStateInPandas(_Follow(list(indicators), idle), schema, "append", "None" if idle is None else "EventTime", initialState=start)
    return out.withColumn("timestamp", F.timestamp_micros("at")).select("symbol", "timestamp", *(c for x in indicators for c in x.columns))
