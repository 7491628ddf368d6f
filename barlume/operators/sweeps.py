"""Parameter sweeps, walk-forward evaluation and Pareto fronts: parameters are rows of a small table.

Indicators are computed once a distinct setting; a bar holds the signals of the whole
grid, and ledgers are folded over them (``grids``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlume.functions import windows as W
from barlume.functions.times import wall_of
from barlume.operators.backtest import backtest
from barlume.operators.grids import grid_stats
from barlume.operators.indicators import combine
from barlume.operators.searching import Setting, density_search, front_search
from barlume.operators.stats import compute_stats
from barlume.sources.shared import stored


#: Averages that differ by less are equal: the last bits depend on the order of a sum.
EVEN = 1e-9


def above(a: Column, b: Column) -> Column:
    return a - b > EVEN


@dataclass
class ComboParams:
    """Settings of the combo strategy. The defaults."""

    fast: int = 20
    slow: int = 100
    rsi_window: int = 14
    rsi_floor: float = 40.0
    rsi_ceiling: float = 75.0
    z_window: int = 20
    z_entry: float = 0.5
    fee_bps: float = 1.0


def combo_features(bars: DataFrame, fasts: Iterable[int], slows: Iterable[int], rsi_window: int = 14, z_window: int = 20, keys: Sequence[str] = W.KEYS) -> DataFrame:
    """One column for each distinct setting. Where a close equals its mean, ``z <= 0`` hangs on the mean's last bit, so that is the SQL's."""
    specs = [("sma", {"window": n}) for n in sorted({*fasts, *slows})]
    z = W.zscore("close", z_window, keys=keys, mean=W.mean_in_blocks("close", z_window, keys))
    return combine(bars.withColumn(f"zscore_{z_window}", z), [*specs, ("rsi", {"window": rsi_window})], keys=keys)


def combo_condition(fast: Column, slow: Column, rsi: Column, z: Column, floor: Column | float, ceiling: Column | float, entry: Column | float) -> Column:
    return W.true(above(fast, slow) & (rsi > floor) & (rsi < ceiling) & (z <= entry))


def run_combo(bars: DataFrame, p: ComboParams | None = None, periods_per_year: float = 252.0) -> tuple[DataFrame, DataFrame, dict]:
    """(ledger, stats, parameters) of the combo strategy: trend up, strength in a band, price pulled back."""
    p = p or ComboParams()
    df = combo_features(bars, [p.fast], [p.slow], p.rsi_window, p.z_window)
    hold = combo_condition(F.col(f"sma_{p.fast}"), F.col(f"sma_{p.slow}"), F.col(f"rsi_{p.rsi_window}"), F.col(f"zscore_{p.z_window}"), p.rsi_floor, p.rsi_ceiling, p.z_entry)
    ledger = backtest(df.withColumn("signal", hold.cast("double")), p.fee_bps)
    return ledger, compute_stats(ledger, periods_per_year=periods_per_year), asdict(p)


def _pick(prefix: str, values: Iterable[int], chosen: str) -> Column:
    """The column prefix_<n> where ``chosen`` is n."""
    out = F.lit(None).cast("double")
    for n in sorted(set(values)):
        out = F.when(F.col(chosen) == n, F.col(f"{prefix}_{n}")).otherwise(out)
    return out


SHOWN = ("total_return", "sharpe", "max_drawdown")


def sweep_sma(bars: DataFrame, fasts: Sequence[int] = (10, 20, 30, 40, 50), slows: Sequence[int] = (80, 100, 120, 140, 160, 180, 200), fee_bps: float = 1.0, periods_per_year: float = 252.0, keys: Sequence[str] = W.KEYS) -> DataFrame:
    """total_return, sharpe and max_drawdown of each (fast, slow) with fast < slow, for each symbol."""
    grid = [{"fast": f, "slow": s} for f, s in product(fasts, slows) if f < s]
    df = combine(bars.select(*keys, "timestamp", "close"), [("sma", {"window": n}) for n in sorted({*fasts, *slows})], keys=keys)
    hold = [W.true(above(F.col(f"sma_{g['fast']}"), F.col(f"sma_{g['slow']}"))) for g in grid]
    return grid_stats(df, hold, grid, "fast int, slow int", fee_bps, periods_per_year, keys, metrics=SHOWN)


def sweep_combo(bars: DataFrame, floors: Sequence[float] = (35.0, 40.0, 45.0, 50.0), entries: Sequence[float] = (-0.5, 0.0, 0.5, 1.0), base: ComboParams | None = None, periods_per_year: float = 252.0) -> DataFrame:
    """The same three metrics of each (rsi_floor, z_entry) for each symbol."""
    p = base or ComboParams()
    df = combo_features(bars.select("symbol", "timestamp", "close"), [p.fast], [p.slow], p.rsi_window, p.z_window)
    grid = [{"rsi_floor": f, "z_entry": z} for f, z in product(floors, entries)]
    of = lambda g: combo_condition(F.col(f"sma_{p.fast}"), F.col(f"sma_{p.slow}"), F.col(f"rsi_{p.rsi_window}"), F.col(f"zscore_{p.z_window}"), g["rsi_floor"], p.rsi_ceiling, g["z_entry"])
    return grid_stats(df, [of(g) for g in grid], grid, "rsi_floor double, z_entry double", p.fee_bps, periods_per_year, metrics=SHOWN)


def fee_sensitivity(signals: DataFrame, fees: Sequence[float] = (0.0, 1.0, 5.0, 10.0, 25.0), periods_per_year: float = 252.0) -> DataFrame:
    """Statistics of one signal under several fees, in basis points."""
    return grid_stats(signals, [F.col("signal")] * len(fees), [{"fee_bps": float(f)} for f in fees], "fee_bps double", fees, periods_per_year)


def walk_forward(bars: DataFrame, fasts: Sequence[int] = (10, 20, 30, 50), slow: int = 100, train_years: int = 3, fee_bps: float = 1.0, periods_per_year: float = 252.0) -> tuple[DataFrame, DataFrame]:
    """(choices, out-of-sample ledger): each year trades the fast average that did best by Sharpe in the years before it.

    Positions start flat in each window and indicators warm up inside it, as
    if each window had been run alone.
    """
    keys = ("symbol",)
    years = bars.select("symbol", F.year(wall_of(bars)).alias("year")).distinct()
    order = Window.partitionBy("symbol").orderBy("year")
    numbered = years.withColumn("k", F.row_number().over(order)).withColumn("last", F.max("k").over(Window.partitionBy("symbol")))
    tests = numbered.filter((F.col("k") > train_years) & (F.col("k") < F.col("last"))).select("symbol", F.col("year").alias("fold"), F.col("k").alias("fold_k"))
    spans = numbered.join(tests, "symbol").filter((F.col("k") <= F.col("fold_k")) & (F.col("k") >= F.col("fold_k") - train_years))
    spans = spans.select("symbol", "year", "fold", (F.col("k") == F.col("fold_k")).alias("test"))
    rows = bars.select("symbol", "timestamp", "close", F.year(wall_of(bars)).alias("year")).join(spans, ["symbol", "year"])
    at = (*keys, "fold", "test")
    df = combine(rows, [("sma", {"window": n}) for n in sorted({*fasts, slow})], keys=at)
    grid = F.broadcast(bars.sparkSession.createDataFrame([(f,) for f in fasts], "fast int"))
    crossed = df.crossJoin(grid).withColumn("signal", W.true(above(_pick("sma", fasts, "fast"), F.col(f"sma_{slow}"))).cast("double"))
    ledger = backtest(crossed, fee_bps, (*at, "fast"))
    trained = compute_stats(ledger.filter("NOT test"), (*keys, "fold", "fast"), periods_per_year=periods_per_year)
    best = Window.partitionBy("symbol", "fold").orderBy(F.desc(F.round("sharpe", 9)), "fast")
    choices = trained.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("symbol", "fold", "fast", "sharpe")
    return choices, ledger.filter("test").join(choices.drop("sharpe"), ["symbol", "fold", "fast"])


SETTINGS = "trial int, fast int, slow int, rsi_floor double, z_entry double"
# The search space of the combo strategy; fast is below slow by construction.
SPACE = (Setting("fast", 5, 50, True), Setting("slow", 60, 250, True), Setting("rsi_floor", 30, 55, digits=2), Setting("z_entry", -1, 1.5, digits=3))


def tried(bars: DataFrame, points: Sequence[dict], first: int = 0, periods_per_year: float = 252.0) -> DataFrame:
    """Statistics of trials, numbered from ``first``, for each symbol: one job for the whole batch."""
    grid = [{"trial": first + k, **p} for k, p in enumerate(points)]
    df = combo_features(bars.select("symbol", "timestamp", "close"), [p["fast"] for p in points], [p["slow"] for p in points])
    of = lambda p: combo_condition(F.col(f"sma_{p['fast']}"), F.col(f"sma_{p['slow']}"), F.col("rsi_14"), F.col("zscore_20"), float(p["rsi_floor"]), 75.0, float(p["z_entry"]))
    grid = [{n: float(v) if n in ("rsi_floor", "z_entry") else int(v) for n, v in g.items()} for g in grid]
    return grid_stats(df, [of(p) for p in points], grid, SETTINGS, 1.0, periods_per_year)


def search(bars: DataFrame, trials: int = 50, seed: int = 0, periods_per_year: float = 252.0, aims: int = 1) -> DataFrame:
    """Statistics of all trials and symbols.

    With one aim, the mean Sharpe ratio over the symbols, trials are drawn by ``density_search``;
    with two, that and the mean |drawdown|, by ``front_search``, a generation a job, and
    ``pareto_front`` takes the front. The bars are written once and read by each batch.
    """
    bars = stored(bars.select("symbol", "timestamp", "close"), "search")
    parts: list[DataFrame] = []

    def judge(points: list[dict]) -> list[tuple[float, float]]:
        done = stored(tried(bars, points, sum(map(len, told)), periods_per_year), "trials")
        parts.append(done)
        told.append(points)
        means = done.groupBy("trial").agg(F.round(F.avg("sharpe"), 9).alias("sharpe"), F.round(F.avg(F.abs("max_drawdown")), 9).alias("cost")).orderBy("trial").collect()  # a row a trial
        return [(r["sharpe"], r["cost"]) for r in means] or [(float("nan"), float("nan"))] * len(points)

    told: list[list[dict]] = []
    if aims == 1:
        density_search(SPACE, lambda points: [g for g, _ in judge(points)], trials, first=max(1, min(10, trials // 2)), batch=max(1, trials // 8), seed=seed)
    else:
        front_search(SPACE, judge, trials, size=max(2, min(16, trials // 4)), seed=seed)
    return reduce(DataFrame.unionByName, parts)


def pareto_front(trials: DataFrame, keys: Sequence[str], gain: str = "sharpe", risk: str = "max_drawdown") -> DataFrame:
    """The trials of each key that no other beats in both gain and |risk|: a sort by gain and a running least risk."""
    cost = F.abs(risk)
    level = Window.partitionBy(*keys, gain)
    before = Window.partitionBy(*keys).orderBy(F.desc(gain))
    least_here = F.min(cost).over(level)
    ranked = trials.withColumns({"__here": least_here, "__rank": F.dense_rank().over(before)})
    steps = ranked.groupBy(*keys, "__rank").agg(F.min("__here").alias("__least"))
    above = Window.partitionBy(*keys).orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("__above", F.min("__least").over(above)).drop("__least")
    return ranked.join(steps, [*keys, "__rank"]).filter((cost == F.col("__here")) & (F.col("__above").isNull() | (cost < F.col("__above")))).drop("__here", "__rank", "__above")
