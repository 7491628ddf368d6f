"""Functions of this library for SQL: indicators as a table function, the normal distribution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from barlume.functions.scalar import norm_cdf_sql
from barlume.operators.indicators import lookup


def _settings(given: dict[str, AnalyzeArgument]) -> dict:
    for name, x in given.items():
        if not x.isConstantExpression:
            raise ValueError(f"{name} must be a constant")
    return {name: x.value if isinstance(x.value, (int, str)) else float(x.value) for name, x in given.items()}


class IndicatorTable:
    """indicator(TABLE(bars), name => 'rsi', window => 14): the table with the columns of a recursive indicator of the registry.

    The function asks for the table by symbol and in order of time itself. An unknown
    name, a setting that the indicator doesn't have and a column that is there already
    are errors of analysis; so are indicators that are plain windows, for which SQL has its own.
    """

    def __init__(self, *_) -> None:
        self.rows: list = []

    @staticmethod
    def analyze(table: AnalyzeArgument, name: AnalyzeArgument, **settings: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument must be a table, as TABLE(bars)")
        found, chosen = lookup(str(name.value)), _settings(settings)
        if not found.kernel:
            raise ValueError(f"{name.value} is no recursion: write it as a window")
        found.kernel(**chosen)
        columns = found.columns(**chosen)
        there = {f.name.lower() for f in table.dataType.fields}
        for c in columns:
            if c.lower() in there:
                raise ValueError(f"column {c!r} is there already")
        schema = StructType([*table.dataType.fields, *(StructField(c, DoubleType()) for c in columns)])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("symbol")], orderBy=[OrderingColumn("timestamp")])

    def eval(self, table, name: str, **settings) -> None:
        self.rows.append(table)
        self.name, self.settings = name, settings

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        bars = pd.DataFrame.from_records([tuple(row) for row in self.rows], columns=self.rows[0].__fields__)
        settings = {k: v if isinstance(v, (int, str)) else float(v) for k, v in self.settings.items()}
        found = [np.asarray(x, float) for x in lookup(self.name).kernel(**settings)(bars).values()]
        for row, *values in zip(self.rows, *found, strict=True):
            yield (*row, *(None if np.isnan(x) else float(x) for x in values))


# The normal density's factor: a fixed value.
_DENSITY = "exp(-x * x / 2) / 2.5066282746310002D"


def register(spark: SparkSession) -> None:
    """Enter ``indicator``, ``norm_cdf`` and ``norm_pdf`` into the session; the latter two are expanded into the plan."""
    spark.udtf.register("indicator", udtf(IndicatorTable))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION norm_cdf(x DOUBLE) RETURNS DOUBLE RETURN {norm_cdf_sql('x')}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION norm_pdf(x DOUBLE) RETURNS DOUBLE RETURN {_DENSITY}")
