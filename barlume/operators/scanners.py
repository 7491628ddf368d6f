"""Cross-sectional scans of the latest bars, and the opening-range scan of sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlume.functions import windows as W
from barlume.functions.times import wall_of
from barlume.operators.indicators import combine

# What a scan shows, in this order.
DISPLAY = ("close", "rsi14", "z20", "mom20", "mom60", "gap", "pct_from_high", "rs", "rs_mom60", "rs_pct_from_high", "atr14", "dollar_vol")
YEAR, LEAST = 252, 20
MIN_DOLLAR_VOLUME = 5e7

Setup = Callable[..., Column]
_SETUPS: dict[str, Setup] = {}


def setup(f: Setup) -> Setup:
    _SETUPS[f.__name__] = f
    return f


def available_setups() -> dict[str, Setup]:
    return dict(_SETUPS)


def benchmark_line(panel: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = W.KEYS) -> DataFrame:
    """Adds ``bench``: the benchmark's close at the same timestamp, carried forward along the symbol's own bars.

    ``benchmark`` has timestamp and close, one row a timestamp. Benchmark bars
    between those of a symbol are not seen.
    """
    return panel.join(benchmark.select("timestamp", F.col("close").alias("bench")), "timestamp", "left").withColumn("bench", W.carried("bench", keys))


def own_benchmark_line(panel: DataFrame, symbol: str, keys: tuple[str, ...] = W.KEYS) -> DataFrame:
    """The same with one of the panel's own symbols, without building the panel twice."""
    same = F.max(F.when(F.col("symbol") == symbol, F.col("close"))).over(Window.partitionBy("timestamp"))
    return panel.withColumn("bench", same).withColumn("bench", W.carried("bench", keys))


def features(panel: DataFrame, benchmark: DataFrame | str | None = None) -> DataFrame:
    """The panel with all columns that setups read; relative strength only with a benchmark."""
    df = panel
    if benchmark is not None:
        df = (own_benchmark_line if isinstance(benchmark, str) else benchmark_line)(df, benchmark).withColumn("rs", F.try_divide(F.col("close"), F.col("bench")))
    more = {f"sma{n}": W.full(F.avg, "close", n) for n in (20, 50, 200)}
    more |= {"z20": W.zscore("close", 20), "mom20": W.change("close", 20), "mom60": W.change("close", 60)}
    more["dollar_vol"] = W.full(F.avg, F.col("close") * F.col("volume"), 20)
    more["gap"] = F.try_divide(F.col("open"), F.lag("close").over(W.ordered())) - 1
    more["pct_from_high"] = F.try_divide(F.col("close"), W.full(F.max, "close", YEAR, least=LEAST)) - 1
    if benchmark is not None:
        more["rs_mom60"] = W.change("rs", 60)
        more["rs_pct_from_high"] = F.try_divide(F.col("rs"), W.full(F.max, "rs", YEAR, least=LEAST)) - 1
    found = combine(df.withColumns(more), [("rsi", {"window": 14}), ("atr", {"window": 14})])
    return found.withColumnsRenamed({"rsi_14": "rsi14", "atr_14": "atr14"})


def latest_snapshot(panel: DataFrame, benchmark: str | DataFrame | None = None) -> DataFrame:
    """The last bar of each symbol with all features. A benchmark that isn't in the panel leaves out relative strength."""
    if isinstance(benchmark, str) and panel.filter(F.col("symbol") == benchmark).select("symbol").isEmpty():
        benchmark = None
    return W.latest_per(features(panel, benchmark))


# Setups: null counts as false


def _liquid(least: float) -> Column:
    return F.col("dollar_vol") > least


@setup
def swing_pullback(columns: list[str], min_dollar_vol: float = MIN_DOLLAR_VOLUME) -> Column:
    """Above the long average, short over middle average, strength cooled to 40 to 55."""
    return W.true((F.col("close") > F.col("sma200")) & (F.col("sma20") > F.col("sma50")) & F.col("rsi14").between(40, 55) & _liquid(min_dollar_vol))


@setup
def momentum_breakout(columns: list[str], min_dollar_vol: float = MIN_DOLLAR_VOLUME, min_z: float = 1.0, min_mom: float = 0.10) -> Column:
    return W.true((F.col("sma20") > F.col("sma50")) & (F.col("z20") > min_z) & (F.col("mom60") > min_mom) & _liquid(min_dollar_vol))


@setup
def relative_strength(columns: list[str], min_dollar_vol: float = MIN_DOLLAR_VOLUME, near_high: float = 0.02) -> Column:
    """Near the relative-strength line's high and rising; nothing without a benchmark."""
    if "rs_pct_from_high" not in columns:
        return F.lit(False)
    return W.true((F.col("rs_pct_from_high") >= -abs(near_high)) & (F.col("rs_mom60") > 0) & (F.col("sma20") > F.col("sma50")) & _liquid(min_dollar_vol))


@setup
def gap_up(columns: list[str], min_gap: float = 0.02, min_dollar_vol: float = MIN_DOLLAR_VOLUME) -> Column:
    return W.true((F.col("gap") > min_gap) & (F.col("close") > F.col("sma50")) & _liquid(min_dollar_vol))


@setup
def new_high_breakout(columns: list[str], min_dollar_vol: float = MIN_DOLLAR_VOLUME, tol: float = 0.005, min_mom: float = 0.05) -> Column:
    return W.true((F.col("pct_from_high") >= -abs(tol)) & (F.col("mom60") > min_mom) & _liquid(min_dollar_vol))


def scan_snapshot(snapshot: DataFrame, which: Setup = swing_pullback, rank_by: str = "mom20", ascending: bool = False, top: int | None = None, **settings) -> DataFrame:
    """The hits of a setup with the display columns, ranked, nulls last; an unknown rank column raises ValueError."""
    shown = [c for c in DISPLAY if c in snapshot.columns]
    if rank_by not in shown:
        raise ValueError(f"cannot rank by {rank_by!r}; one of {shown}")
    hits = snapshot.filter(which(snapshot.columns, **settings)).select("symbol", *shown)
    order = F.asc_nulls_last(rank_by) if ascending else F.desc_nulls_last(rank_by)
    hits = hits.orderBy(order, "symbol")
    return hits.limit(top) if top else hits


def scan(panel: DataFrame, which: Setup = swing_pullback, rank_by: str = "mom20", benchmark: str | DataFrame | None = None, top: int | None = None, **settings) -> DataFrame:
    return scan_snapshot(latest_snapshot(panel, benchmark), which, rank_by, top=top, **settings)


def composite_score(snapshot: DataFrame, columns: tuple[str, ...] = ("mom20", "mom60", "z20")) -> DataFrame:
    """(symbol, score): the sum of each column's z-score across the universe."""
    found = snapshot.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    parts = [F.try_divide(F.col(c) - F.col(f"m_{c}"), F.when(F.col(f"s_{c}") != 0, F.col(f"s_{c}"))) for c in columns]
    return snapshot.crossJoin(F.broadcast(found)).select("symbol", sum(parts[1:], parts[0]).alias("score"))  # one row of means


# Opening range


def orb_features(bars: DataFrame, open_bars: int = 6) -> DataFrame:
    """One row a symbol for its latest session (UTC date): the opening range, whether it broke upwards, traded value."""
    rows = bars.withColumn("session", F.to_date(wall_of(bars)))
    rows = rows.withColumn("latest", F.max("session").over(Window.partitionBy("symbol"))).filter("session = latest")
    rows = rows.withColumn("k", F.row_number().over(W.ordered()))
    opening, after = F.col("k") <= open_bars, F.col("k") > open_bars
    found = rows.groupBy("symbol").agg(
        F.max(F.when(opening, F.col("high"))).alias("h"), F.min(F.when(opening, F.col("low"))).alias("l"), F.max(F.when(after, F.col("high"))).alias("later"),
        F.max_by("close", "timestamp").alias("last"), F.sum(F.col("close") * F.col("volume")).alias("session_dollar_vol"), F.count("*").alias("n"),
    )
    enough = F.col("n") > open_bars
    return found.select("symbol", F.when(enough, F.col("h")).alias("or_high"), F.when(enough, F.col("l")).alias("or_low"), "last", W.true(enough & (F.col("later") > F.col("h"))).alias("orb_up"), "session_dollar_vol")


def orb_scan(bars: DataFrame, open_bars: int = 6, min_session_dollar_vol: float = 1e6, top: int | None = None) -> DataFrame:
    hits = orb_features(bars, open_bars).filter(F.col("orb_up") & (F.col("session_dollar_vol") > min_session_dollar_vol)).orderBy(F.desc("session_dollar_vol"), "symbol")
    return hits.limit(top) if top else hits
