"""A lake of bars: Parquet partitioned by timeframe and symbol, with upserts and SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlume.sources import lake_functions
from barlume.sources.contract import BARS_SCHEMA, FIELDS, check_timeframe, keep_last
from barlume.sources.providers import Provider

_QUALIFY = re.compile(r"\bQUALIFY\b(?P<rule>.*?)(?P<rest>\bORDER\s+BY\b[^()]*)?;?\s*\Z", re.I | re.S)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' bars; where (symbol, timestamp) repeats, the new one's."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    return keep_last(both).drop("_seq")


def without_qualify(sql: str) -> str:
    """A query whose last clause (before ORDER BY) is QUALIFY, as a filter over a subquery.

    Only the outermost, trailing clause is rewritten; its window goes into a column.
    """
    m = _QUALIFY.search(sql)
    if not m:
        return sql
    head = sql[: m.start()]
    depth, at = 0, None
    for word in re.finditer(r"[()]|\bSELECT\b", head, re.I):
        if word[0] in "()":
            depth += 1 if word[0] == "(" else -1
        elif depth == 0:
            at = word.end()
    if at is None:
        raise ValueError("QUALIFY without a SELECT")
    inner = f"{head[:at]} ({m['rule'].strip()}) AS __qualify, {head[at:].strip()}"
    begin = 0
    if re.match(r"\s*WITH\b", head, re.I):  # the common table expressions stay outermost
        begin = at - len(re.search(r"\bSELECT\b$", head[:at], re.I)[0])
    return f"{head[:begin]}SELECT * EXCEPT (__qualify) FROM ({inner[begin:]}) WHERE __qualify {m['rest'] or ''}".strip()


_ORDERED = re.compile(r"\b(?P<which>first|last)\s*\(\s*(?P<value>[^()]*?)\s+ORDER\s+BY\s+(?P<order>[^(),]*?)(?P<turn>\s+(?:ASC|DESC))?\s*\)", re.I)


def without_ordered(sql: str) -> str:
    """first(x ORDER BY y) and last(x ORDER BY y) as min_by and max_by; x and y are free of parentheses."""

    def instead(m: re.Match) -> str:
        up = (m["which"].lower() == "first") != ((m["turn"] or "").strip().upper() == "DESC")
        return f"{'min' if up else 'max'}_by({m['value']}, {m['order']})"

    return _ORDERED.sub(instead, sql)


class Lake:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, timeframe: str) -> str:
        return f"{self.root}/timeframe={check_timeframe(timeframe)}"

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def scan(self, timeframe: str = "1d") -> DataFrame:
        """Bars with their partition columns; symbols of digits stay strings."""
        schema = "timestamp timestamp, open double, high double, low double, close double, volume double, timeframe string, symbol string"
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(self.path(timeframe))

    def write(self, bars: DataFrame, timeframe: str = "1d") -> int:
        """Upsert: new bars win over old ones with the same symbol and timestamp. Returns the number of rows given.

        Only the partitions of the given symbols are read and rewritten, by way of a staging folder.
        """
        staged = f"{self.root}/_staging/{uuid.uuid4().hex}"
        bars.select("symbol", "timestamp", *FIELDS).write.parquet(f"{staged}/given")  # the source is read once
        bars = self.spark.read.schema(BARS_SCHEMA).parquet(f"{staged}/given")
        given = bars.count()
        if self._exists(self.path(timeframe)):
            old = self.scan(timeframe).select(bars.columns)
            bars = merged(old.join(bars.select("symbol").distinct(), "symbol", "left_semi"), bars)
            bars.write.parquet(f"{staged}/merged")
            bars = self.spark.read.schema(BARS_SCHEMA).parquet(f"{staged}/merged")
        (
            bars.withColumn("timeframe", F.lit(timeframe)).repartition("symbol").sortWithinPartitions("symbol", "timestamp")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("timeframe", "symbol").parquet(self.root)
        )
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return given

    def ingest(self, provider: Provider, symbols: Sequence[str], start: str | None = None, end: str | None = None, timeframe: str = "1d") -> int:
        return self.write(provider.get_ohlcv_multi(symbols, start, end, timeframe), timeframe)

    def query(self, sql: str, timeframe: str = "1d") -> DataFrame:
        """SQL over a view named lake; a trailing QUALIFY, ordered first() and last(), and the functions of ``lake_functions`` are understood."""
        lake_functions.register(self.spark)
        self.scan(timeframe).createOrReplaceTempView("lake")
        return self.spark.sql(without_qualify(without_ordered(sql)))
