"""Ticks to bars over a stream, and a recursive indicator as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(ticks: DataFrame, span: str = "1 hour", late: str = "2 hours", sequence: str | None = None) -> DataFrame:
    """OHLCV bars of a stream with columns symbol, timestamp, price, quantity.

    In append mode a bar comes out, and leaves the state, once the watermark has passed
    it. Ticks of one time are ordered by ``sequence``, a column of their order, or
    without one by price, so that a bar doesn't depend on the order of arrival.
    """
    w = F.window("timestamp", span)
    order = F.struct("timestamp", F.col(sequence or "price"))
    return (
        ticks.withWatermark("timestamp", late).groupBy(w.alias("w"), "symbol")
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").alias("volume"))
        .select("symbol", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume")
    )


def stream_ewma(bars: DataFrame, span: int = 20) -> DataFrame:
    """(symbol, timestamp, close, ewma) over a stream of bars; the state of a symbol is one number and a flag."""
    alpha = 2 / (span + 1)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("timestamp")
        out = []
        for c in rows["close"]:
            y = c if y is None else y + alpha * (c - y)
            out.append(y)
        state.update((float(y),))
        yield rows.assign(symbol=key[0], ewma=out)[["symbol", "timestamp", "close", "ewma"]]

    return bars.select("symbol", "timestamp", "close").groupBy("symbol").applyInPandasWithState(step, "symbol string, timestamp timestamp, close double, ewma double", "y double", "append", GroupStateTimeout.NoTimeout)
