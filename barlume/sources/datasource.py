"""Synthetic bars as a Spark data source: ``spark.read.format("bars").option("symbols", "A,B").load()``.

One partition a symbol; days and seed are options. ``register`` enters it into
a session.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barlume.sources.contract import BARS_SCHEMA

FIRST = datetime(2020, 1, 1, tzinfo=timezone.utc)


class SymbolPartition(InputPartition):
    def __init__(self, symbol: str) -> None:
        self.symbol = symbol


class BarsReader(DataSourceReader):
    """Each symbol's logarithmic price is drawn back to a level of its own, faster or slower, in calm or rough steps."""

    def __init__(self, options: dict) -> None:
        self.symbols = [s.strip() for s in options.get("symbols", "ONE").split(",") if s.strip()]
        self.days, self.seed = int(options.get("days", 260)), int(options.get("seed", 1))

    def partitions(self) -> list[SymbolPartition]:
        return [SymbolPartition(s) for s in self.symbols]

    def read(self, partition: SymbolPartition) -> Iterator[tuple]:
        rng = np.random.default_rng([self.seed, *partition.symbol.encode()])
        level, pull, rough = rng.uniform(2.5, 5.5), rng.uniform(0.01, 0.08), rng.uniform(0.006, 0.03)
        shocks = rng.laplace(0, rough, (self.days, 2))  # over night, over the day
        reach = rng.exponential(rough / 2, (self.days, 2))
        traded = np.exp(rng.normal(11, 0.4, self.days)).round()
        away = 0.0
        for day in range(self.days):
            opened = away * (1 - pull) + shocks[day, 0] / 3
            away = opened + shocks[day, 1]
            top, floor = max(opened, away) + reach[day, 0], min(opened, away) - reach[day, 1]
            prices = np.exp(level + np.array([opened, top, floor, away])).tolist()
            yield partition.symbol, FIRST + timedelta(days=day), *prices, float(traded[day])


class BarsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bars"

    def schema(self) -> str:
        return BARS_SCHEMA.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def reader(self, schema) -> BarsReader:
        return BarsReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BarsDataSource)
