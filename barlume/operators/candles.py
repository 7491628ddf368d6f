"""Candlestick patterns as data: a table of rules, compiled to columns.

A rule is a condition on the last few bars, given from the first to the last. A
bar knows its body, shadows and range, and the usual size of each: the mean of
the ten bars before the pattern's first one, so that a pattern is measured
against what went before it. Earlier bars and usual sizes are columns that all
patterns of a list share, over one ordering of the panel; the patterns themselves
are plain expressions on them.

A pattern gives 100 where it promises a rise, -100 a fall, and 0 elsewhere, also
where fewer than ten bars are before it or one of its prices is null. Confirmed
patterns give 200 or -200 besides, on the first bar that closes beyond the
pattern's second-last bar, up to three bars later.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barlume.functions import windows as W

#: Bars of the averages, and bars within which a pattern may be confirmed.
USUAL, CONFIRM = 10, 3
# Shares that tell sizes apart: fixed values, the usual ones.
LONG, SHORT, DOJI, NEAR, NO_SHADOW, INTO = 1.0, 1.0, 0.1, 0.2, 0.1, 0.3


@dataclass(frozen=True)
class Bar:
    """One bar of a pattern of ``n`` bars as columns, ``back`` bars before its last."""

    back: int
    n: int

    def _at(self, name: str) -> Column:
        return F.col(f"__bar{self.back}")[name] if self.back else F.col(name)

    def _usual(self, name: str) -> Column:
        return F.col(f"__usual_{name}{self.n}")

    @property
    def open(self) -> Column:
        return self._at("open")

    @property
    def high(self) -> Column:
        return self._at("high")

    @property
    def low(self) -> Column:
        return self._at("low")

    @property
    def close(self) -> Column:
        return self._at("close")

    @property
    def body(self) -> Column:
        return F.abs(self.close - self.open)

    @property
    def top(self) -> Column:
        return F.greatest(self.open, self.close)

    @property
    def bottom(self) -> Column:
        return F.least(self.open, self.close)

    @property
    def middle(self) -> Column:
        return (self.open + self.close) / 2

    @property
    def far(self) -> Column:
        """Three tenths of the body, back from the close."""
        return self.close + INTO * (self.open - self.close)

    @property
    def up(self) -> Column:
        return self.close > self.open

    @property
    def down(self) -> Column:
        return self.close < self.open

    @property
    def long(self) -> Column:
        return self.body > LONG * self._usual("body")

    @property
    def short(self) -> Column:
        return self.body < SHORT * self._usual("body")

    @property
    def doji(self) -> Column:
        return self.body <= DOJI * self._usual("range")

    @property
    def upper(self) -> Column:
        return self.high - self.top

    @property
    def lower(self) -> Column:
        return self.bottom - self.low

    @property
    def shaved_top(self) -> Column:
        return self.upper < NO_SHADOW * self._usual("range")

    @property
    def shaved_bottom(self) -> Column:
        return self.lower < NO_SHADOW * self._usual("range")

    @property
    def bare(self) -> Column:
        return self.long & self.shaved_top & self.shaved_bottom

    def near(self, x: Column, y: Column) -> Column:
        """Whether two prices are alike, measured by usual ranges."""
        return F.abs(x - y) <= NEAR * self._usual("range")


Rule = Callable[..., Column]


@dataclass(frozen=True)
class Pattern:
    bars: int
    rise: Rule | None = None
    fall: Rule | None = None
    confirmed: bool = False


def _all(*conditions: Column) -> Column:
    return reduce(Column.__and__, conditions)


def _soldiers(a: Bar, b: Bar, c: Bar) -> Column:
    return _all(a.up, b.up, c.up, a.long, b.close > a.close, c.close > b.close, b.open > a.open, b.open <= a.close, c.open > b.open, c.open <= b.close, a.shaved_top, b.shaved_top, c.shaved_top)


def _crows(a: Bar, b: Bar, c: Bar) -> Column:
    return _all(a.down, b.down, c.down, a.long, b.close < a.close, c.close < b.close, b.open < a.open, b.open >= a.close, c.open < b.open, c.open >= b.close, a.shaved_bottom, b.shaved_bottom, c.shaved_bottom)


def _inside(outer: Bar, inner: Bar) -> Column:
    return (inner.top < outer.top) & (inner.bottom > outer.bottom)


def _gap_up(before: Bar, after: Bar) -> Column:
    return after.bottom > before.top


def _gap_down(before: Bar, after: Bar) -> Column:
    return after.top < before.bottom


#: Each pattern's rules take its bars from the first to the last.
PATTERNS: dict[str, Pattern] = {
    # one bar
    "MARUBOZU": Pattern(1, lambda a: a.up & a.bare, lambda a: a.down & a.bare),
    "SPINNINGTOP": Pattern(1, lambda a: _all(a.up, a.short, a.upper > a.body, a.lower > a.body), lambda a: _all(a.down, a.short, a.upper > a.body, a.lower > a.body)),
    "DRAGONFLYDOJI": Pattern(1, lambda a: _all(a.doji, a.shaved_top, ~a.shaved_bottom)),
    "GRAVESTONEDOJI": Pattern(1, lambda a: _all(a.doji, a.shaved_bottom, ~a.shaved_top)),
    "LONGLINE": Pattern(1, lambda a: _all(a.up, a.long, a.upper < a.body / 2, a.lower < a.body / 2), lambda a: _all(a.down, a.long, a.upper < a.body / 2, a.lower < a.body / 2)),
    "BELTHOLD": Pattern(1, lambda a: _all(a.up, a.long, a.shaved_bottom), lambda a: _all(a.down, a.long, a.shaved_top)),
    # two bars
    "HAMMER": Pattern(2, lambda a, b: _all(b.short, b.lower > 2 * b.body, b.shaved_top, b.bottom <= a.low + NEAR * b._usual("range"))),
    "HANGINGMAN": Pattern(2, fall=lambda a, b: _all(b.short, b.lower > 2 * b.body, b.shaved_top, b.bottom >= a.high - NEAR * b._usual("range"))),
    "INVERTEDHAMMER": Pattern(2, lambda a, b: _all(b.short, b.upper > 2 * b.body, b.shaved_bottom, _gap_down(a, b))),
    "SHOOTINGSTAR": Pattern(2, fall=lambda a, b: _all(b.short, b.upper > 2 * b.body, b.shaved_bottom, _gap_up(a, b))),
    "HARAMI": Pattern(2, lambda a, b: _all(a.down, a.long, b.short, _inside(a, b)), lambda a, b: _all(a.up, a.long, b.short, _inside(a, b))),
    "HARAMICROSS": Pattern(2, lambda a, b: _all(a.down, a.long, b.doji, _inside(a, b)), lambda a, b: _all(a.up, a.long, b.doji, _inside(a, b))),
    "PIERCING": Pattern(2, lambda a, b: _all(a.down, a.long, b.up, b.long, b.open < a.low, b.close > a.middle, b.close < a.open)),
    "DARKCLOUDCOVER": Pattern(2, fall=lambda a, b: _all(a.up, a.long, b.down, b.open > a.high, b.close < a.middle, b.close > a.open)),
    "KICKING": Pattern(2, lambda a, b: _all(a.down, b.up, a.bare, b.bare, b.low > a.high), lambda a, b: _all(a.up, b.down, a.bare, b.bare, b.high < a.low)),
    "DOJISTAR": Pattern(2, lambda a, b: _all(a.down, a.long, b.doji, _gap_down(a, b)), lambda a, b: _all(a.up, a.long, b.doji, _gap_up(a, b))),
    "MATCHINGLOW": Pattern(2, lambda a, b: _all(a.down, b.down, b.near(a.close, b.close))),
    "SEPARATINGLINES": Pattern(2, lambda a, b: _all(a.down, b.up, b.near(a.open, b.open), b.long, b.shaved_bottom), lambda a, b: _all(a.up, b.down, b.near(a.open, b.open), b.long, b.shaved_top)),
    # three bars
    "3WHITESOLDIERS": Pattern(3, _soldiers),
    "3BLACKCROWS": Pattern(3, fall=_crows),
    "MORNINGSTAR": Pattern(3, lambda a, b, c: _all(a.down, a.long, b.short, _gap_down(a, b), c.up, c.close > a.far)),
    "EVENINGSTAR": Pattern(3, fall=lambda a, b, c: _all(a.up, a.long, b.short, _gap_up(a, b), c.down, c.close < a.far)),
    "MORNINGDOJISTAR": Pattern(3, lambda a, b, c: _all(a.down, a.long, b.doji, _gap_down(a, b), c.up, c.close > a.far)),
    "EVENINGDOJISTAR": Pattern(3, fall=lambda a, b, c: _all(a.up, a.long, b.doji, _gap_up(a, b), c.down, c.close < a.far)),
    "3INSIDE": Pattern(3, lambda a, b, c: _all(a.down, a.long, b.short, _inside(a, b), c.up, c.close > a.open), lambda a, b, c: _all(a.up, a.long, b.short, _inside(a, b), c.down, c.close < a.open)),
    "3OUTSIDE": Pattern(
        3,
        lambda a, b, c: _all(a.down, b.up, b.close > a.open, b.open < a.close, c.close > b.close),
        lambda a, b, c: _all(a.up, b.down, b.close < a.open, b.open > a.close, c.close < b.close),
    ),
    "TRISTAR": Pattern(3, lambda a, b, c: _all(a.doji, b.doji, c.doji, _gap_down(a, b), c.bottom > b.top), lambda a, b, c: _all(a.doji, b.doji, c.doji, _gap_up(a, b), c.top < b.bottom)),
    "HIKKAKE": Pattern(
        3,
        lambda a, b, c: _all(b.high < a.high, b.low > a.low, c.high < b.high, c.low < b.low),
        lambda a, b, c: _all(b.high < a.high, b.low > a.low, c.high > b.high, c.low > b.low),
        confirmed=True,
    ),
}


def before(names: Sequence[str], keys: Sequence[str]) -> dict[str, Column]:
    """The columns that the patterns' rules read: earlier bars, and usual sizes before patterns of their lengths."""
    reach = max(PATTERNS[name].bars for name in names)
    bar = F.struct("open", "high", "low", "close")
    out = {f"__bar{k}": F.lag(bar, k).over(W.ordered(keys)) for k in range(1, reach)}
    for n in sorted({PATTERNS[name].bars for name in names}):
        frame = Window.partitionBy(*keys).orderBy("timestamp").rowsBetween(-(USUAL + n - 1), -n)
        for name, size in (("body", F.abs(F.col("close") - F.col("open"))), ("range", F.col("high") - F.col("low"))):
            out[f"__usual_{name}{n}"] = F.when(F.count(size).over(frame) >= USUAL, F.avg(size).over(frame))
    return out


def column(name: str, keys: Sequence[str]) -> Column:
    """A pattern's value on each bar, from the columns of ``before``."""
    pattern = PATTERNS[name]
    bars = [Bar(back, pattern.bars) for back in reversed(range(pattern.bars))]
    value = F.lit(0)
    for rule, sign in ((pattern.fall, -100), (pattern.rise, 100)):
        if rule:
            value = F.when(rule(*bars), sign).otherwise(value)
    value = F.when(F.col(f"__usual_range{pattern.bars}").isNotNull(), value).otherwise(0)  # rules that read no sizes wait as well
    return _confirmed(value, keys) if pattern.confirmed else value


def _confirmed(value: Column, keys: Sequence[str]) -> Column:
    """The value itself, or twice that of the latest pattern on the first bar that closes beyond it."""
    w = W.ordered(keys)
    out = F.lit(0)
    for k in reversed(range(1, CONFIRM + 1)):  # patterns k bars ago, later ones over earlier ones
        top, bottom = F.lag("high", k + 1).over(w), F.lag("low", k + 1).over(w)
        closes = [F.lag("close", j).over(w) for j in range(1, k)]  # between the pattern and this bar
        rises = _all(F.col("close") > top, *(c <= top for c in closes))
        falls = _all(F.col("close") < bottom, *(c >= bottom for c in closes))
        then = F.lag(value, k).over(w)
        out = F.when(then == 100, F.when(rises, 200).otherwise(0)).when(then == -100, F.when(falls, -200).otherwise(0)).otherwise(out)
    return F.when(value != 0, value).otherwise(out)
