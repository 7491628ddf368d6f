"""Providers of bars, by name, and a cache of their requests."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlume.functions.times import instant
from barlume.functions.windows import ordered, running
from barlume.sources.contract import BARS_SCHEMA, check_timeframe, normalize, validate


@dataclass(frozen=True)
class Request:
    symbols: tuple[str, ...]
    start: str | None = None
    end: str | None = None
    timeframe: str = "1d"
    adjust: bool = True

    def digest(self) -> str:
        return hashlib.sha1("|".join(map(str, (",".join(self.symbols), self.start, self.end, self.timeframe, self.adjust))).encode()).hexdigest()


class Provider(ABC):
    """One method finds bars; this class checks requests, and shapes and validates what comes back."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    @abstractmethod
    def fetch(self, request: Request) -> DataFrame:
        """Bars of all the request's symbols, with a column symbol."""

    def get_ohlcv(self, symbol: str, start: str | None = None, end: str | None = None, timeframe: str = "1d", adjust: bool = True) -> DataFrame:
        found = normalize(self.fetch(Request((symbol,), start, end, check_timeframe(timeframe), adjust)), adjust=adjust, some=False)
        return validate(found, symbol, some=True)

    def get_ohlcv_multi(self, symbols: Sequence[str], start: str | None = None, end: str | None = None, timeframe: str = "1d", adjust: bool = True) -> DataFrame:
        """The panel of several symbols, in one plan; without symbols an empty one."""
        check_timeframe(timeframe)
        if not symbols:
            return self.spark.createDataFrame([], BARS_SCHEMA)
        found = normalize(self.fetch(Request(tuple(symbols), start, end, timeframe, adjust)), adjust=adjust, some=False)
        return validate(found, ",".join(symbols), some=True)

    def get_options_chain(self, symbol: str, expiry: str | None = None) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} has no option chains")


def between(df: DataFrame, request: Request) -> DataFrame:
    """Both ends inclusive, in UTC; pushed down to a file scan."""
    df = df.filter(F.col("symbol").isin(*request.symbols))
    kind = dict(df.dtypes)["timestamp"]
    bound = (lambda x: instant(x, "string")) if kind == "timestamp" else lambda x: x.cast(kind)
    for end, keep in ((request.start, lambda t, x: t >= x), (request.end, lambda t, x: t <= x)):
        if end is not None:
            df = df.filter(keep(F.col("timestamp"), bound(F.lit(end))))
    return df


class FrameProvider(Provider):
    """Serves a DataFrame of bars, and option chains given as (calls, puts) by expiry."""

    def __init__(self, spark: SparkSession, frame: DataFrame, chains: dict[str, dict[str, tuple[DataFrame, DataFrame]]] | None = None) -> None:
        super().__init__(spark)
        self.frame, self.chains = frame, chains or {}

    def fetch(self, request: Request) -> DataFrame:
        return between(self.frame, request)

    def get_options_chain(self, symbol: str, expiry: str | None = None) -> DataFrame:
        chains = self.chains.get(symbol)
        if not chains:
            raise ValueError(f"no options for {symbol}")
        expiry = expiry or min(chains)
        if expiry not in chains:
            raise ValueError(f"no expiry {expiry} for {symbol}; one of {sorted(chains)}")
        return option_chain(*chains[expiry], expiry)


def option_chain(calls: DataFrame, puts: DataFrame, expiry: str) -> DataFrame:
    """Calls and puts as one tidy table with lower-case columns, option_type and expiry."""
    legs = (leg.toDF(*(c.lower() for c in leg.columns)).withColumns({"option_type": F.lit(kind), "expiry": F.lit(expiry)}) for kind, leg in (("call", calls), ("put", puts)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), legs)


class ParquetProvider(Provider):
    """Serves bars from a Parquet table, perhaps partitioned by timeframe and symbol."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark)
        self.path = path

    def fetch(self, request: Request) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        if "timeframe" in df.columns:
            df = df.filter(F.col("timeframe") == request.timeframe)
        return between(df, request)


class SyntheticProvider(Provider):
    """Serves made-up bars of any length: a level of each symbol's own, a slow swing and hashed daily steps.

    Made on the executors from a hash of symbol and day, so the same for every plan.
    """

    def __init__(self, spark: SparkSession, days: int = 260, first: str = "2020-01-01", seed: int = 1) -> None:
        super().__init__(spark)
        self.days, self.first, self.seed = days, first, seed

    def _draw(self, what: str, *of: str) -> Column:
        """Between 0 and 1."""
        return F.pmod(F.xxhash64(F.lit(f"{self.seed}/{what}"), *of), F.lit(1 << 24)) / F.lit(float(1 << 24))

    def fetch(self, request: Request) -> DataFrame:
        names = self.spark.createDataFrame([(s,) for s in request.symbols], "symbol string")
        days = names.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(self.days - 1))))
        level, period = 20 + 180 * self._draw("level", "symbol"), 40 + F.floor(80 * self._draw("period", "symbol"))
        steps = F.sum(self._draw("step", "symbol", "day") - 0.5).over(running()) * 0.05
        days = days.withColumn("timestamp", instant(F.date_add(F.lit(self.first).cast("date"), F.col("day")), "date"))
        days = days.withColumn("close", level * F.exp(steps + 0.1 * F.sin(F.col("day") * F.lit(6.283185) / period)))
        days = days.withColumn("open", F.coalesce(F.lag("close").over(ordered()) * (0.995 + 0.01 * self._draw("gap", "symbol", "day")), level))
        reach = lambda what: 1 + 0.02 * self._draw(what, "symbol", "day")
        high, low = F.greatest("open", "close") * reach("high"), F.least("open", "close") / reach("low")
        volume = F.round(2e5 * F.exp(2 * self._draw("volume", "symbol", "day")))
        return between(days.select("symbol", "timestamp", "open", high.alias("high"), low.alias("low"), "close", volume.alias("volume")), request)


class CachedProvider(Provider):
    """Writes what another provider fetched to Parquet, keyed by the request's digest, and reads it from there next time."""

    def __init__(self, inner: Provider, root: str | None) -> None:
        super().__init__(inner.spark)
        self.inner, self.root = inner, root

    def path(self, request: Request) -> str:
        return f"{self.root}/{request.digest()}.parquet"

    def fetch(self, request: Request) -> DataFrame:
        if self.root is None:
            return self.inner.fetch(request)
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path(request)}/_SUCCESS")
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            self.inner.fetch(replace(request)).write.mode("overwrite").parquet(self.path(request))
        return self.spark.read.parquet(self.path(request))


_FACTORIES: dict[str, Callable[..., Provider]] = {}


def register_provider(name: str, factory: Callable[..., Provider]) -> None:
    _FACTORIES[name.lower()] = factory


def get_provider(name: str = "synthetic", **settings) -> Provider:
    """The provider of that name, case ignored; KeyError lists the known ones."""
    if name.lower() not in _FACTORIES:
        raise KeyError(f"no provider {name!r}; one of {sorted(_FACTORIES)}")
    return _FACTORIES[name.lower()](**settings)


for _name, _factory in (("frame", FrameProvider), ("parquet", ParquetProvider), ("lake", ParquetProvider), ("synthetic", SyntheticProvider)):
    register_provider(_name, _factory)
