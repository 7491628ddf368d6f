"""Ordered frames of a panel and the aggregates over them.

Every frame of one panel is partitioned and ordered alike, so any number of
window columns costs one exchange. Warm-up is null, never a partial window,
unless a function says so.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("symbol",)


def ordered(keys: Sequence[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("timestamp")


def running(keys: Sequence[str] = KEYS) -> WindowSpec:
    return ordered(keys).rowsBetween(Window.unboundedPreceding, 0)


def trailing(n: int, keys: Sequence[str] = KEYS) -> WindowSpec:
    if n <= 0:
        raise ValueError(f"window must be positive, got {n}")
    return ordered(keys).rowsBetween(-(n - 1), 0)


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full(aggregate: Callable[[Column], Column], x: Column | str, n: int, keys: Sequence[str] = KEYS, least: int | None = None) -> Column:
    """An aggregate over the last n rows, null until ``least`` (n by default) of them have values."""
    x, w = column(x), trailing(n, keys)
    return F.when(F.count(x).over(w) >= (least or n), aggregate(x).over(w))


def mean_in_blocks(x: Column | str, n: int, keys: Sequence[str] = KEYS, block: int = 16) -> Column:
    """The mean over full windows, with each block of 16 rows, counted from a key's first one, added up by itself.

    It differs from ``full(F.avg, ...)`` in the last bits alone. They are those of DuckDB's window
    where a key's rows open its partition (tested up to 252 rows): for comparisons that hang on them.
    """
    x = column(x).cast("double")
    rows, lead = F.collect_list(x).over(trailing(n, keys)), F.pmod(n - F.row_number().over(ordered(keys)), F.lit(block))
    blocks = ((n - lead) / block).cast("int")
    add = lambda start, size, total: F.aggregate(F.slice(rows, start, size), total, lambda a, b: a + b)
    whole = F.aggregate(F.sequence(F.lit(0), blocks - 1), add(1, lead, F.lit(0.0)), lambda a, k: a + add(lead + 1 + k * block, block, F.lit(0.0)))
    return F.when((F.size(rows) == n) & (blocks > 0), add(lead + 1 + blocks * block, n, whole) / n).otherwise(full(F.avg, x, n, keys))


def change(x: Column | str, k: int = 1, keys: Sequence[str] = KEYS) -> Column:
    """The simple return over k rows; null where there is none, or the base is zero."""
    x = column(x)
    return F.try_divide(x, F.lag(x, k).over(ordered(keys))) - 1


def forward_change(x: Column | str, k: int = 1, keys: Sequence[str] = KEYS) -> Column:
    x = column(x)
    return F.try_divide(F.lead(x, k).over(ordered(keys)), x) - 1


def log_change(x: Column | str, k: int = 1, keys: Sequence[str] = KEYS) -> Column:
    x = column(x)
    return F.ln(x) - F.lag(F.ln(x), k).over(ordered(keys))


def carried(x: Column | str, keys: Sequence[str] = KEYS) -> Column:
    """The last value so far that isn't null."""
    return F.last(column(x), ignorenulls=True).over(running(keys))


def compounded(r: Column | str, keys: Sequence[str] = KEYS) -> Column:
    """The running product of 1 + r; null returns count as 0."""
    return F.product(1 + F.coalesce(column(r), F.lit(0.0))).over(running(keys))


def drawdown(equity: Column | str, keys: Sequence[str] = KEYS) -> Column:
    equity = column(equity)
    return F.try_divide(equity, F.max(equity).over(running(keys))) - 1


def zscore(x: Column | str, n: int, ddof: int = 0, keys: Sequence[str] = KEYS, mean: Column | None = None) -> Column:
    """(x - mean) / deviation over full windows; 0 where the window is flat."""
    x = column(x)
    sd = full(F.stddev_pop if ddof == 0 else F.stddev_samp, x, n, keys)
    mean = full(F.avg, x, n, keys) if mean is None else mean
    return F.when(sd == 0, 0.0).otherwise((x - mean) / F.when(sd != 0, sd))


def latest_per(df: DataFrame, keys: Sequence[str] = KEYS, order: str = "timestamp") -> DataFrame:
    """The last row of each key: what a trailing QUALIFY row_number() = 1 asks for."""
    turn = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__turn", F.row_number().over(turn)).filter("__turn = 1").drop("__turn")


def last_rows(df: DataFrame, n: int, keys: Sequence[str] = KEYS, order: str = "timestamp") -> DataFrame:
    """The last n rows of each key."""
    turn = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__turn", F.row_number().over(turn)).filter(F.col("__turn") <= n).drop("__turn")


def edges(signal: Column | str, keys: Sequence[str] = KEYS) -> tuple[Column, Column]:
    """(entry, exit): where a signal rises from none or below, and where it falls back; null counts as none."""
    on = F.coalesce(column(signal), F.lit(0.0)) > 0
    before = F.coalesce(F.lag(on.cast("int")).over(ordered(keys)), F.lit(0)) > 0
    return on & ~before, before & ~on


def true(condition: Column) -> Column:
    """A condition in which null counts as false."""
    return F.coalesce(condition, F.lit(False))
