"""The bar contract: schema, forgiving normalisation, strict validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampType

from barlume.functions.times import instant

FIELDS = ("open", "high", "low", "close", "volume")
BARS_SCHEMA = StructType([StructField("symbol", StringType(), False), StructField("timestamp", TimestampType(), False), *(StructField(f, DoubleType()) for f in FIELDS)])
# Other names of columns, timeframes, and bars a year of each.
ALIASES = {"adj close": "close", "adj_close": "close", "adjclose": "close", "vol": "volume", "datetime": "timestamp", "date": "timestamp", "time": "timestamp"}
TIMEFRAMES = frozenset("1m 2m 5m 15m 30m 60m 1h 1d 1wk 1mo".split())
PER_YEAR = {"1d": 252.0, "1wk": 52.0, "1mo": 12.0, "1h": 1638.0, "60m": 1638.0, "30m": 3276.0, "15m": 6552.0, "5m": 19656.0, "1m": 98280.0}
PER_YEAR_BY_LETTER = {"W": 52.0, "M": 12.0, "Q": 4.0, "Y": 1.0, "A": 1.0, "D": 252.0, "B": 252.0, "H": 1638.0}
SLACK = 1e-9


def annualization_factor(timeframe: str) -> float:
    return PER_YEAR.get(timeframe, 252.0)


def resample_factor(rule: str | None) -> float:
    """Bars a year after resampling, by the rule's first letter."""
    return PER_YEAR_BY_LETTER.get(rule[0].upper(), 252.0) if rule else 252.0


def check_timeframe(timeframe: str) -> str:
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"unsupported timeframe {timeframe!r}; one of {sorted(TIMEFRAMES)}")
    return timeframe


def normalize(df: DataFrame, symbol: str | None = None, adjust: bool = True, some: bool = True) -> DataFrame:
    """Bars in the contract's shape from columns of any case and with usual aliases.

    The last of rows that repeat (symbol, timestamp) is kept, by a column
    ``_seq`` if there is one, else in reading order. NaN becomes null. Times
    without a zone are in UTC. An adjusted close stands in for the close where
    there is none, and where there is one if ``adjust``. A missing column raises
    ValueError, as does a frame without rows if ``some`` (a job of its own).
    """
    names: dict[str, str] = {}
    for c in df.columns:
        low = c.strip().lower()
        names.setdefault(low, c)
    found: dict[str, str] = {}
    for low, c in names.items():
        if low in ("symbol", "timestamp", *FIELDS):
            found[low] = c
    for low, c in names.items():
        if low in ALIASES and (ALIASES[low] not in found or low.startswith("adj") and adjust):
            found[ALIASES[low]] = c
    missing = [f for f in ("timestamp", *FIELDS) if f not in found]
    if missing:
        raise ValueError(f"missing columns {missing} of {df.columns}")
    if symbol is None and "symbol" not in found:
        raise ValueError("no symbol given and no such column")
    name = F.lit(symbol) if symbol is not None else F.col(f"`{found['symbol']}`").cast("string")
    seq = F.col("_seq") if "_seq" in df.columns else F.monotonically_increasing_id()
    value = lambda f: F.nanvl(F.col(f"`{found[f]}`").cast("double"), F.lit(None).cast("double")).alias(f)
    out = df.select(name.alias("symbol"), instant(F.col(f"`{found['timestamp']}`"), dict(df.dtypes)[found["timestamp"]]).alias("timestamp"), *map(value, FIELDS), seq.alias("_seq"))
    if some and out.isEmpty():
        raise ValueError("no bars")
    return keep_last(out).drop("_seq")


def keep_last(df: DataFrame, keys: tuple[str, ...] = ("symbol", "timestamp"), order: str = "_seq") -> DataFrame:
    """Of rows with the same keys, the one with the highest ``order``."""
    turn = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__turn", F.row_number().over(turn)).filter("__turn = 1").drop("__turn")


def breaches(df: DataFrame) -> DataFrame:
    """One row: how many bars, and how many break each clause of the contract."""
    bad = {
        "bad_high": F.col("high") + SLACK < F.greatest("open", "close", "low"),
        "bad_low": F.col("low") - SLACK > F.least("open", "close", "high"),
        "bad_volume": F.col("volume") < 0,
    }
    return df.agg(
        F.count("*").alias("bars"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in bad.items()),
        (F.count("*") - F.count_distinct("symbol", "timestamp")).alias("repeated"), F.count_if(F.col("timestamp").isNull() | F.col("symbol").isNull()).alias("unkeyed"),
    )


def validate(df: DataFrame, name: str = "", some: bool = False) -> DataFrame:
    """The bars, or AssertionError with what is wrong with them; without any ValueError if ``some``."""
    columns = [c for c in df.columns if c not in ("symbol", "timestamp")]
    if columns != list(FIELDS):
        raise AssertionError(f"{name}: columns are {columns}, not {list(FIELDS)}")
    found = breaches(df).first().asDict()
    if some and not found["bars"]:
        raise ValueError(f"{name}: no bars")
    wrong = {k: v for k, v in found.items() if k != "bars" and v}
    if wrong:
        raise AssertionError(f"{name}: {wrong} in {found['bars']} bars")
    return df


def validate_rows(rows: list[tuple]) -> None:
    """That (symbol, timestamp) rises along a list of rows: a DataFrame has no order of its own."""
    keys = [tuple(r[:2]) for r in rows]
    if any(a >= b for a, b in zip(keys, keys[1:], strict=False)):
        raise AssertionError("timestamps are not sorted and unique")
