"""Indicators by name: a registry, specs as data, and a planner.

An expression indicator adds window columns to a DataFrame; a kernel indicator
is a recursion on one symbol's bars. ``combine`` adds all expression
indicators of a spec list over one ordering of the panel, and all kernels in
one grouped map.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.functions import windows as W
from barlume.operators import candles, cycles
from barlume.operators import kernels as K

Spec = tuple[str, dict]


@dataclass(frozen=True)
class Indicator:
    columns: Callable[..., tuple[str, ...]]  # their names for given settings
    expression: Callable[..., dict[str, Column]] | None = None
    kernel: Callable[..., K.Kernel] | None = None
    before: Callable[..., dict[str, Column]] | None = None  # columns that the expression's windows read
    group: str = "custom"


_REGISTRY: dict[str, Indicator] = {}


def register(name: str, columns: Callable[..., tuple[str, ...]], *, kernel: bool = False, before: Callable[..., dict[str, Column]] | None = None, group: str = "custom") -> Callable:
    """Enter a function under a name, case ignored; the last one entered counts."""

    def enter(f: Callable) -> Callable:
        _REGISTRY[name.lower()] = Indicator(columns, None if kernel else f, f if kernel else None, before, group)
        return f

    return enter


def available() -> list[str]:
    return sorted(_REGISTRY)


def available_by_group() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name in available():
        out.setdefault(_REGISTRY[name].group, []).append(name)
    return out


def lookup(name: str) -> Indicator:
    if name.lower() not in _REGISTRY:
        raise KeyError(f"no indicator {name!r}; one of {available()}")
    return _REGISTRY[name.lower()]


def combine(df: DataFrame, specs: Sequence[Spec], join_input: bool = True, keys: Sequence[str] = W.KEYS) -> DataFrame:
    """The panel with a column for each indicator of the list, or the keys and those columns alone.

    Two specs that name the same column raise ValueError.
    """
    names: list[str] = []
    plans = []
    for name, settings in specs:
        found = lookup(name)
        columns = found.columns(**settings)
        for c in columns:
            if c in names or c in df.columns:
                raise ValueError(f"column {c!r} is there already")
            names.append(c)
        plans.append((found, settings, columns))
    out = df
    earlier: dict[str, Column] = {}
    later: dict[str, Column] = {}
    for found, settings, _ in plans:
        if found.expression:
            earlier |= found.before(keys=keys, **settings) if found.before else {}
            later |= found.expression(keys=keys, **settings)
    if earlier:
        out = out.withColumns(earlier)
    if later:
        out = out.withColumns(later)
    out = out.drop(*earlier)
    kernels = [(columns, found.kernel(**settings)) for found, settings, columns in plans if found.kernel]
    if kernels:
        out = K.apply_kernels(out, kernels, keys)
    return out if join_input else out.select(*keys, "timestamp", *names)


def make(name: str, df: DataFrame, **settings) -> DataFrame:
    return combine(df, [(name, settings)], join_input=False)


def _named(stem: str, *settings: str) -> Callable[..., tuple[str, ...]]:
    """Column names like stem_<value of the first setting>, with defaults written as name=value."""
    defaults = dict(s.split("=") for s in settings)

    def names(**given) -> tuple[str, ...]:
        return ("_".join([stem, *(str(given.get(k, v)) for k, v in defaults.items())]),)

    return names


def _fixed(*names: str) -> Callable[..., tuple[str, ...]]:
    return lambda **_: names


# Averages, deviations, returns


@register("sma", _named("sma", "window=20"), group="overlap")
def _sma(keys=W.KEYS, window: int = 20, source: str = "close"):
    return {f"sma_{window}": W.full(F.avg, source, window, keys)}


@register("std", _named("std", "window=20"), group="statistic")
def _std(keys=W.KEYS, window: int = 20, ddof: int = 0, source: str = "close"):
    return {f"std_{window}": W.full(F.stddev_pop if ddof == 0 else F.stddev_samp, source, window, keys)}


@register("zscore", _named("zscore", "window=20"), group="statistic")
def _zscore(keys=W.KEYS, window: int = 20, source: str = "close"):
    return {f"zscore_{window}": W.zscore(source, window, 0, keys)}


@register("ret", _named("ret", "periods=1"), group="momentum")
def _ret(keys=W.KEYS, periods: int = 1, source: str = "close"):
    return {f"ret_{periods}": W.change(source, periods, keys)}


@register("hl_range", _named("hl_range", "window=20"), group="volatility")
def _hl_range(keys=W.KEYS, window: int = 20):
    return {f"hl_range_{window}": W.full(F.avg, F.try_divide(F.col("high") - F.col("low"), F.col("close")), window, keys)}


@register("donchian", lambda window=20: (f"donchian_high_{window}", f"donchian_low_{window}"), group="overlap")
def _donchian(keys=W.KEYS, window: int = 20):
    return {f"donchian_high_{window}": W.full(F.max, "high", window, keys), f"donchian_low_{window}": W.full(F.min, "low", window, keys)}


@register("bbands", _fixed("BBANDS_upperband", "BBANDS_middleband", "BBANDS_lowerband"), group="overlap")
def _bbands(keys=W.KEYS, timeperiod: int = 20, nbdevup: float = 2.0, nbdevdn: float = 2.0):
    middle, sd = W.full(F.avg, "close", timeperiod, keys), W.full(F.stddev_pop, "close", timeperiod, keys)
    return {"BBANDS_upperband": middle + nbdevup * sd, "BBANDS_middleband": middle, "BBANDS_lowerband": middle - nbdevdn * sd}


@register("wma", _named("wma", "window=20"), group="overlap")
def _wma(keys=W.KEYS, window: int = 20, source: str = "close"):
    w, x = W.ordered(keys), F.col(source)
    total = sum(((window - k) * F.lag(x, k).over(w) for k in range(1, window)), window * x)
    return {f"wma_{window}": F.when(F.count(x).over(W.trailing(window, keys)) >= window, total / (window * (window + 1) / 2))}


# Ranges, flows, patterns


def true_range(keys=W.KEYS) -> Column:
    before = F.lag("close").over(W.ordered(keys))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


@register("trange", _fixed("TRANGE"), group="volatility")
def _trange(keys=W.KEYS):
    return {"TRANGE": true_range(keys)}


def _fast_k(keys=W.KEYS, fastk_period: int = 14, **_):
    low, high = W.full(F.min, "low", fastk_period, keys), W.full(F.max, "high", fastk_period, keys)
    return {f"__k{fastk_period}": F.try_divide(100 * (F.col("close") - low), high - low)}


def _slow_k(keys=W.KEYS, fastk_period: int = 14, slowk_period: int = 3, **_):
    return {f"__k{fastk_period}": _fast_k(keys, fastk_period)[f"__k{fastk_period}"]}


@register("stoch", _fixed("STOCH_slowk", "STOCH_slowd"), before=_slow_k, group="momentum")
def _stoch(keys=W.KEYS, fastk_period: int = 14, slowk_period: int = 3, slowd_period: int = 3):
    """%K smoothed once and twice. The second average of averages is one weighted sum, so it needs no window over a window."""
    k = f"__k{fastk_period}"
    reach = slowk_period + slowd_period - 1
    weights = [sum(0 <= j - i < slowk_period for i in range(slowd_period)) for j in range(reach)]
    twice = sum((w * F.lag(k, j).over(W.ordered(keys)) for j, w in enumerate(weights)), F.lit(0.0)) / (slowk_period * slowd_period)
    return {"STOCH_slowk": W.full(F.avg, k, slowk_period, keys), "STOCH_slowd": F.when(F.count(k).over(W.trailing(reach, keys)) >= reach, twice)}


def _typical(keys=W.KEYS, **_):
    return {"__tp": (F.col("high") + F.col("low") + F.col("close")) / 3}


@register("cci", _named("CCI", "timeperiod=14"), before=_typical, group="momentum")
def _cci(keys=W.KEYS, timeperiod: int = 14):
    w = W.trailing(timeperiod, keys)
    mean = F.avg("__tp").over(w)
    spread = F.aggregate(F.collect_list("__tp").over(w), F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / timeperiod
    return {f"CCI_{timeperiod}": F.when(F.count("__tp").over(w) >= timeperiod, F.try_divide(F.col("__tp") - mean, 0.015 * spread))}


def _flows(keys=W.KEYS, **_):
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    before = F.lag(typical).over(W.ordered(keys))
    flow = typical * F.col("volume")
    return {"__up": F.when(typical > before, flow).when(before.isNotNull(), 0.0), "__down": F.when(typical < before, flow).when(before.isNotNull(), 0.0)}


@register("mfi", _named("MFI", "timeperiod=14"), before=_flows, group="momentum")
def _mfi(keys=W.KEYS, timeperiod: int = 14):
    up, down = W.full(F.sum, "__up", timeperiod, keys), W.full(F.sum, "__down", timeperiod, keys)
    return {f"MFI_{timeperiod}": F.try_divide(100 * up, up + down)}


def _signed_volume(keys=W.KEYS, **_):
    return {"__sv": F.coalesce(F.signum(F.col("close") - F.lag("close").over(W.ordered(keys))), F.lit(0.0)) * F.col("volume")}


@register("obv", _fixed("OBV"), before=_signed_volume, group="volume")
def _obv(keys=W.KEYS):
    return {"OBV": F.sum("__sv").over(W.running(keys))}


def _money_flow(keys=W.KEYS, **_):
    wide = F.col("high") - F.col("low")
    return {"__mf": F.coalesce(F.try_divide(2 * F.col("close") - F.col("low") - F.col("high"), wide), F.lit(0.0)) * F.col("volume")}


@register("ad", _fixed("AD"), before=_money_flow, group="volume")
def _ad(keys=W.KEYS):
    return {"AD": F.sum("__mf").over(W.running(keys))}


@register("cdlengulfing", _fixed("CDLENGULFING"), group="pattern")
def _engulfing(keys=W.KEYS):
    w = W.ordered(keys)
    o, c, bo, bc = F.col("open"), F.col("close"), F.lag("open").over(w), F.lag("close").over(w)
    up = (c > o) & (bc < bo) & (c >= bo) & (o <= bc) & ((c > bo) | (o < bc))
    down = (c < o) & (bc > bo) & (o >= bc) & (c <= bo) & ((o > bc) | (c < bo))
    return {"CDLENGULFING": F.when(up, 100).when(down, -100).otherwise(0)}


@register("cdldoji", _fixed("CDLDOJI"), group="pattern")
def _doji(keys=W.KEYS, share: float = 0.1):
    wide = F.col("high") - F.col("low")
    return {"CDLDOJI": F.when((wide > 0) & (F.abs(F.col("close") - F.col("open")) <= share * wide), 100).otherwise(0)}


def _enter_pattern(name: str) -> None:
    register(f"cdl{name}", _fixed(f"CDL{name}"), before=lambda keys=W.KEYS: candles.before([name], keys), group="pattern")(lambda keys=W.KEYS: {f"CDL{name}": candles.column(name, keys)})


for _pattern in candles.PATTERNS:
    _enter_pattern(_pattern)


@register("rolling_mdd", _named("rolling_mdd", "window=20"), group="statistic")
def _rolling_mdd(keys=W.KEYS, window: int = 20, source: str = "close"):
    """The worst drawdown inside each window: a fold with the running peak."""
    w = W.trailing(window, keys)
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))
    step = lambda s, x: F.struct(F.greatest(s["peak"], x).alias("peak"), F.least(s["worst"], x / F.greatest(s["peak"], x) - 1).alias("worst"))
    fold = F.aggregate(F.collect_list(source).over(w), start, step)["worst"]
    return {f"rolling_mdd_{window}": F.when(F.count(source).over(w) >= window, fold)}


def _line(keys=W.KEYS, timeperiod: int = 14, source: str = "close"):
    """Each bar's number: what a line through a window's values goes along."""
    return {"__i": F.row_number().over(W.ordered(keys)).cast("double")}


def _through(y: str, x: str, n: int, keys) -> tuple[Column, Column, Column]:
    """Slope, intercept and correlation over full windows, by central moments."""
    w = W.trailing(n, keys)
    whole = lambda c: F.when(F.count(F.col(y) + F.col(x)).over(w) >= n, c)
    alike = F.try_divide(F.covar_pop(y, x).over(w), F.stddev_pop(y).over(w) * F.stddev_pop(x).over(w))  # null where either is flat
    return whole(F.regr_slope(y, x).over(w)), whole(F.regr_intercept(y, x).over(w)), whole(alike)


def _of_line(name: str, value: Callable[[Column, Column, int], Column]) -> None:
    """Enter a figure of the line through each window: a function of its slope, its intercept and the window's length."""

    def figure(keys=W.KEYS, timeperiod: int = 14, source: str = "close"):
        slope, start, _ = _through(source, "__i", timeperiod, keys)
        return {f"{name}_{timeperiod}": value(slope, start, timeperiod)}

    register(name, _named(name, "timeperiod=14"), before=_line, group="statistic")(figure)


_of_line("LINEARREG", lambda slope, start, n: start + slope * F.col("__i"))
_of_line("TSF", lambda slope, start, n: start + slope * (F.col("__i") + 1))
_of_line("LINEARREG_SLOPE", lambda slope, start, n: slope)
_of_line("LINEARREG_ANGLE", lambda slope, start, n: F.degrees(F.atan(slope)))
_of_line("LINEARREG_INTERCEPT", lambda slope, start, n: start + slope * (F.col("__i") - (n - 1)))  # the line at the window's first bar


@register("correl", _named("CORREL", "timeperiod=30"), group="statistic")
def _correl(keys=W.KEYS, timeperiod: int = 30, source: str = "high", other: str = "low"):
    return {f"CORREL_{timeperiod}": _through(source, other, timeperiod, keys)[2]}


def _two_returns(keys=W.KEYS, timeperiod: int = 5, source: str = "high", other: str = "low"):
    return {"__ra": W.change(source, 1, keys), "__rb": W.change(other, 1, keys)}


@register("beta", _named("BETA", "timeperiod=5"), before=_two_returns, group="statistic")
def _beta(keys=W.KEYS, timeperiod: int = 5, source: str = "high", other: str = "low"):
    """The slope of one series' returns on the other's."""
    return {f"BETA_{timeperiod}": _through("__rb", "__ra", timeperiod, keys)[0]}


# Recursions


def _array(bars: pd.DataFrame, *columns: str):
    return [bars[c].to_numpy(float) for c in columns]


def _kernel(name: str, columns: Callable[..., tuple[str, ...]], group: str) -> Callable:
    return register(name, columns, kernel=True, group=group)


@_kernel("ewma", _named("ewma", "span=20"), "overlap")
def _ewma(span: int = 20, source: str = "close", seed: str = "first"):
    """Seeded with the first value, or with the mean of the first ``span`` ones (``seed="mean"``), null before."""
    if seed not in ("first", "mean"):
        raise ValueError(f"seed must be first or mean, got {seed!r}")
    average = K.ewma if seed == "first" else K.ewma_of_mean
    return lambda bars: {f"ewma_{span}": average(*_array(bars, source), span)}


@_kernel("rsi", _named("rsi", "window=14"), "momentum")
def _rsi(window: int = 14, source: str = "close"):
    return lambda bars: {f"rsi_{window}": K.rsi(*_array(bars, source), window)}


@_kernel("atr", _named("atr", "window=14"), "volatility")
def _atr(window: int = 14):
    return lambda bars: {f"atr_{window}": K.atr(*_array(bars, "high", "low", "close"), window)}


@_kernel("wilder_atr", _named("wilder_atr", "window=14"), "volatility")
def _wilder_atr(window: int = 14):
    return lambda bars: {f"wilder_atr_{window}": K.wilder_atr(*_array(bars, "high", "low", "close"), window)}


@_kernel("natr", _named("NATR", "timeperiod=14"), "volatility")
def _natr(timeperiod: int = 14):
    return lambda bars: {f"NATR_{timeperiod}": 100 * K.wilder_atr(*_array(bars, "high", "low", "close"), timeperiod) / bars["close"].to_numpy(float)}


@_kernel("supertrend", _fixed("supertrend", "supertrend_dir"), "overlap")
def _supertrend(period: int = 10, multiplier: float = 3.0):
    return lambda bars: dict(zip(("supertrend", "supertrend_dir"), K.supertrend(*_array(bars, "high", "low", "close"), period, multiplier), strict=True))


@_kernel("chandelier", _named("chandelier", "period=22"), "overlap")
def _chandelier(period: int = 22, multiplier: float = 3.0):
    return lambda bars: {f"chandelier_{period}": K.chandelier(*_array(bars, "high", "low", "close"), period, multiplier)}


@_kernel("macd", _fixed("MACD_macd", "MACD_macdsignal", "MACD_macdhist"), "momentum")
def _macd(fast: int = 12, slow: int = 26, signal: int = 9):
    return lambda bars: dict(zip(("MACD_macd", "MACD_macdsignal", "MACD_macdhist"), K.macd(*_array(bars, "close"), fast, slow, signal), strict=True))


@_kernel("adx", _named("ADX", "timeperiod=14"), "momentum")
def _adx(timeperiod: int = 14):
    return lambda bars: {f"ADX_{timeperiod}": K.adx(*_array(bars, "high", "low", "close"), timeperiod)}


@_kernel("sar", _fixed("SAR"), "overlap")
def _sar(acceleration: float = 0.02, maximum: float = 0.2):
    return lambda bars: {"SAR": K.sar(*_array(bars, "high", "low"), acceleration, maximum)}


@_kernel("adosc", _fixed("ADOSC"), "volume")
def _adosc(fastperiod: int = 3, slowperiod: int = 10):
    return lambda bars: {"ADOSC": K.adosc(*_array(bars, "high", "low", "close", "volume"), fastperiod, slowperiod)}


@_kernel("ht_dcperiod", _fixed("HT_DCPERIOD"), "cycle")
def _dcperiod(source: str = "close"):
    return lambda bars: {"HT_DCPERIOD": cycles._warm(cycles.periods(*_array(bars, source)))}


@_kernel("ht_dcphase", _fixed("HT_DCPHASE"), "cycle")
def _dcphase(source: str = "close"):
    return lambda bars: {"HT_DCPHASE": cycles.phase(*_array(bars, source))}


@_kernel("ht_sine", _fixed("HT_SINE_sine", "HT_SINE_leadsine"), "cycle")
def _ht_sine(source: str = "close"):
    return lambda bars: dict(zip(("HT_SINE_sine", "HT_SINE_leadsine"), cycles.sines(*_array(bars, source)), strict=True))


@_kernel("ht_trendline", _fixed("HT_TRENDLINE"), "cycle")
def _ht_trendline(source: str = "close"):
    return lambda bars: {"HT_TRENDLINE": cycles.trend_line(*_array(bars, source))}


@_kernel("ht_trendmode", _fixed("HT_TRENDMODE"), "cycle")
def _ht_trendmode(source: str = "close"):
    return lambda bars: {"HT_TRENDMODE": cycles.trend_mode(*_array(bars, source))}


#: Named spec lists.
BUNDLES: dict[str, list[Spec]] = {
    "trend": [("sma", {"window": 20}), ("sma", {"window": 50}), ("ewma", {"span": 20})],
    "momentum": [("rsi", {"window": 14}), ("zscore", {"window": 20}), ("macd", {})],
    "volatility": [("std", {"window": 20}), ("atr", {"window": 14}), ("bbands", {})],
}

# Usual names of functions, of their settings and of their outputs.
FUNCTIONS: dict[str, tuple[str, dict[str, str], tuple[str, ...]]] = {
    "SMA": ("sma", {"timeperiod": "window"}, ("real",)), "EMA": ("ewma", {"timeperiod": "span"}, ("real",)), "WMA": ("wma", {"timeperiod": "window"}, ("real",)),
    "BBANDS": ("bbands", {}, ("upperband", "middleband", "lowerband")), "SAR": ("sar", {}, ("real",)), "RSI": ("rsi", {"timeperiod": "window"}, ("real",)),
    "MACD": ("macd", {"fastperiod": "fast", "slowperiod": "slow", "signalperiod": "signal"}, ("macd", "macdsignal", "macdhist")), "STOCH": ("stoch", {}, ("slowk", "slowd")),
    "ADX": ("adx", {}, ("real",)), "CCI": ("cci", {}, ("real",)), "MFI": ("mfi", {}, ("real",)), "OBV": ("obv", {}, ("real",)), "AD": ("ad", {}, ("real",)), "ADOSC": ("adosc", {}, ("real",)),
    "ATR": ("wilder_atr", {"timeperiod": "window"}, ("real",)), "NATR": ("natr", {}, ("real",)), "TRANGE": ("trange", {}, ("real",)),
    "LINEARREG": ("linearreg", {}, ("real",)), "LINEARREG_SLOPE": ("linearreg_slope", {}, ("real",)), "LINEARREG_ANGLE": ("linearreg_angle", {}, ("real",)), "TSF": ("tsf", {}, ("real",)),
    "LINEARREG_INTERCEPT": ("linearreg_intercept", {}, ("real",)), "CORREL": ("correl", {}, ("real",)), "BETA": ("beta", {}, ("real",)),
    "HT_DCPERIOD": ("ht_dcperiod", {}, ("real",)), "HT_DCPHASE": ("ht_dcphase", {}, ("real",)), "HT_SINE": ("ht_sine", {}, ("sine", "leadsine")),
    "HT_TRENDLINE": ("ht_trendline", {}, ("real",)), "HT_TRENDMODE": ("ht_trendmode", {}, ("real",)),
    "CDLENGULFING": ("cdlengulfing", {}, ("integer",)), "CDLDOJI": ("cdldoji", {}, ("integer",)),
}
FUNCTIONS |= {f"CDL{name}": (f"cdl{name.lower()}", {}, ("integer",)) for name in candles.PATTERNS}


def _by_function(name: str, settings: dict) -> tuple[Spec, dict[str, str]]:
    """The indicator behind a function's usual name, and how its columns are to be called."""
    name = name.upper()
    if name.startswith(("CDL", "HT_")) and name not in FUNCTIONS:
        raise NotImplementedError(f"{name} is not supported")
    if name not in FUNCTIONS:
        raise KeyError(f"no function {name}; one of {sorted(FUNCTIONS)}")
    own, names, outputs = FUNCTIONS[name]
    settings = {names.get(k, k): v for k, v in settings.items()}
    return (own, settings), dict(zip(lookup(own).columns(**settings), (f"{name}_{o}" for o in outputs), strict=True))


def by_function(name: str, df: DataFrame, **settings) -> DataFrame:
    """A function of the catalogue by its usual name and settings; its columns are NAME_output, like RSI_real.

    EMA is seeded with the first value, or with an average by seed="mean".
    """
    (own, settings), names = _by_function(name, settings)
    return make(own, df, **settings).withColumnsRenamed(names)


def add_indicators(df: DataFrame, specs: Sequence[Spec], keys: Sequence[str] = W.KEYS) -> DataFrame:
    """The panel with the columns of all functions of a list of (usual name, settings), in one plan.

    Two that would give the same column, such as one function twice, raise ValueError.
    """
    found = [_by_function(name, settings) for name, settings in specs]
    names = [new for _, columns in found for new in columns.values()]
    if len({*names, *df.columns}) < len(names) + len(df.columns):
        raise ValueError(f"columns would repeat: {names}")
    return combine(df, [spec for spec, _ in found], keys=keys).withColumnsRenamed({old: new for _, columns in found for old, new in columns.items()})
