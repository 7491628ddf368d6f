"""Ledgers of many strategies over one panel: a bar holds the signals of the whole grid as one array.

The bars are neither repeated by strategy nor sorted again: the panel's partitioning
serves the indicators and the fold, in which each strategy of a symbol is a few
vectors in one grouped Arrow map, one strategy after another.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from barlume.functions import windows as W
from barlume.operators.stats import METRICS


def ledger_stats(r: np.ndarray, periods_per_year: float) -> list[float | int]:
    """The metrics of a return series, in their usual order."""
    n, root = len(r), math.sqrt(periods_per_year)
    equity = np.cumprod(1 + r)
    peak = np.maximum.accumulate(equity)
    with np.errstate(divide="ignore", invalid="ignore"):
        fall = np.where(peak != 0, equity / peak - 1, np.nan)
    growth, worst = float(equity[-1]), float(np.nanmin(fall)) if not np.isnan(fall).all() else math.nan
    cagr = growth ** (periods_per_year / n) - 1 if growth >= 0 else math.nan
    spread = lambda x: float(np.std(x, ddof=1)) if len(x) > 1 else 0.0
    over = lambda a, b: a / b if b else 0.0
    mean, sd, moved = float(r.mean()), spread(r), r != 0
    return [growth - 1, cagr, sd * root, over(mean, sd) * root, over(mean, spread(r[r < 0])) * root, worst, over(cagr, abs(worst)), over(float((r > 0).sum()), float(moved.sum())), n]


def grid_stats(bars: DataFrame, signals: Sequence[Column], settings: DataFrame | Sequence[dict], kinds: str, fees: Sequence[float] | float = 1.0, periods_per_year: float = 252.0, keys: Sequence[str] = W.KEYS, price: str = "close", metrics: Sequence[str] = METRICS) -> DataFrame:
    """A row for each key and strategy: its settings (columns of ``kinds``) and the metrics of its ledger.

    ``signals`` has one column for each of ``settings``; ``fees`` in basis points is one for
    all or one for each. Ledgers are those of ``backtest``: decide on a bar, act on the next.
    """
    names = StructType.fromDDL(kinds).names
    fee = [float(fees)] * len(signals) if isinstance(fees, int | float) else list(map(float, fees))
    held = [[s[n] for n in names] for s in settings]
    rows = bars.select(*keys, "timestamp", F.col(price).cast("double").alias("__price"), F.array(*(F.coalesce(s.cast("double"), F.lit(0.0)) for s in signals)).alias("__signals"))
    own = [rows.schema[k] for k in keys]
    schema = StructType([*own, *StructType.fromDDL(kinds).fields, *StructType.fromDDL(", ".join(f"{m} {'long' if m == 'n_periods' else 'double'}" for m in METRICS)).fields])

    def fold(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("timestamp").combine_chunks()
        p = table.column("__price").to_numpy(zero_copy_only=False).astype(float)
        grid = table.column("__signals").combine_chunks()
        grid = (grid.chunk(0) if isinstance(grid, pa.ChunkedArray) else grid).flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1)
        before = np.concatenate(([np.nan], p[:-1]))
        with np.errstate(divide="ignore", invalid="ignore"):
            ret = np.where(before == 0, np.nan, p / before - 1)
        out = []
        for k, (values, bps) in enumerate(zip(held, fee, strict=True)):
            position = np.concatenate(([0.0], grid[:-1, k]))
            turnover = np.abs(np.diff(position, prepend=0.0))
            out.append([*(x.as_py() for x in key), *values, *ledger_stats(np.nan_to_num(position * ret - turnover * (bps / 1e4), nan=0.0), periods_per_year)])
        return pa.table({f.name: pa.array([row[i] for row in out], to_arrow_type(f.dataType), from_pandas=True) for i, f in enumerate(schema.fields)})

    return rows.groupBy(*keys).applyInArrow(lambda key, table: fold(key, table), schema).select(*keys, *names, *metrics)
