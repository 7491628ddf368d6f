"""From rules to signals, positions, costs and returns: decide on a bar, act on the next."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.functions import windows as W
from barlume.operators.indicators import Spec, combine
from barlume.operators.rules import Condition, condition
from barlume.operators.stats import compute_stats
from barlume.sources.bars import resample
from barlume.sources.contract import annualization_factor, resample_factor


@dataclass
class StrategyConfig:
    """A strategy as data. ``signal`` goes before ``entry`` (with ``exit``), that before ``rule``."""

    indicators: list[Spec] = field(default_factory=list)
    rule: Condition | None = None
    entry: Condition | None = None
    exit: Condition | None = None
    signal: Callable[[DataFrame], Column] | None = None
    direction: str = "long"
    fee_bps: float = 1.0
    name: str = "strategy"


def asdict_safe(config: StrategyConfig) -> dict:
    """The configuration for a log: functions and columns by name."""
    show = lambda v: f"<callable {getattr(v, '__name__', type(v).__name__)}>" if callable(v) else str(v) if isinstance(v, Column) else v
    return {k: show(v) for k, v in vars(config).items()}


def build_signal(bars: DataFrame, config: StrategyConfig, keys: Sequence[str] = W.KEYS) -> DataFrame:
    """The bars with the configuration's indicators and a column signal.

    With entry and exit the position is a state: 1 from an entry to the next
    exit, which wins where both hold on one bar. Entry alone holds while it is
    true, like a rule. ``short`` turns the sign, save for signal functions.
    """
    df = combine(bars, config.indicators, keys=keys) if config.indicators else bars
    if config.signal is not None:
        return df.withColumn("signal", config.signal(df).cast("double"))
    if config.entry is not None and config.exit is not None:
        event = F.when(condition(config.exit, df), 0.0).when(condition(config.entry, df), 1.0)
        signal = F.coalesce(W.carried(event, keys), F.lit(0.0))
    elif config.entry is not None or config.rule is not None:
        signal = condition(config.entry if config.entry is not None else config.rule, df).cast("double")
    else:
        raise ValueError("a strategy needs one of signal, entry or rule")
    return df.withColumn("signal", -signal if config.direction == "short" else signal)


def backtest(df: DataFrame, fee_bps: float = 1.0, keys: Sequence[str] = W.KEYS, signal: str = "signal", price: str = "close") -> DataFrame:
    """The ledger: ret, position (the signal a bar later), turnover and strat, the return after costs. One exchange."""
    w = W.ordered(keys)
    df = df.withColumns({"ret": W.change(price, 1, keys), "position": F.coalesce(F.lag(F.coalesce(signal, F.lit(0.0))).over(w), F.lit(0.0))})
    df = df.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))
    return df.withColumn("strat", F.coalesce(F.col("position") * F.col("ret") - F.col("turnover") * (fee_bps / 1e4), F.lit(0.0)))


@dataclass
class Result:
    ledger: DataFrame
    stats: DataFrame
    config: dict
    portfolio: DataFrame | None = None
    portfolio_stats: DataFrame | None = None
    errors: DataFrame | None = None


def run_strategy(bars: DataFrame, config: StrategyConfig, timeframe: str = "1d", resample_rule: str | None = None) -> Result:
    """Bars, perhaps coarsened, to ledger and statistics of every symbol in one plan."""
    per_year = annualization_factor(timeframe)
    if resample_rule:
        bars, per_year = resample(bars, resample_rule), resample_factor(resample_rule)
    ledger = backtest(build_signal(bars, config), config.fee_bps)
    return Result(ledger, compute_stats(ledger, periods_per_year=per_year), asdict_safe(config) | {"timeframe": timeframe, "resample": resample_rule})


def equal_weight(ledger: DataFrame, symbols: int) -> DataFrame:
    """Mean return by timestamp over all symbols; one that has no bar counts as 0."""
    return ledger.groupBy("timestamp").agg((F.sum(F.coalesce("strat", F.lit(0.0))) / symbols).alias("strat"))


def run_strategy_multi(bars: DataFrame, config: StrategyConfig, timeframe: str = "1d", resample_rule: str | None = None, least_bars: int = 2) -> Result:
    """As run_strategy, with an equal-weight portfolio; symbols that break the contract or have too few bars become errors."""
    checked = bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if(F.coalesce((F.col("high") + 1e-9 < F.greatest("open", "close", "low")) | (F.col("low") - 1e-9 > F.least("open", "close", "high")) | (F.col("volume") < 0), F.lit(False))).alias("bad"))
    errors = checked.filter((F.col("bad") > 0) | (F.col("bars") < least_bars)).select("symbol", F.when(F.col("bad") > 0, F.format_string("%d bars break the contract", "bad")).otherwise(F.format_string("only %d bars", "bars")).alias("error"))
    good = bars.join(errors.select("symbol"), "symbol", "left_anti")
    out = run_strategy(good, config, timeframe, resample_rule)
    out.errors = errors
    n = good.select("symbol").distinct().count()
    if n:
        out.portfolio = equal_weight(out.ledger, n).withColumn("symbol", F.lit("portfolio"))
        out.portfolio_stats = compute_stats(out.portfolio, periods_per_year=resample_factor(resample_rule) if resample_rule else annualization_factor(timeframe))
    return out


__all__ = ["Result", "StrategyConfig", "asdict_safe", "backtest", "build_signal", "equal_weight", "run_strategy", "run_strategy_multi"]
