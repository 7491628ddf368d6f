"""Performance statistics of a return ledger, one row for each key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.functions import windows as W
from barlume.functions.times import wall_of

METRICS = ("total_return", "cagr", "ann_volatility", "sharpe", "sortino", "max_drawdown", "calmar", "win_rate", "n_periods")


def _ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0 or there is none."""
    return F.coalesce(F.try_divide(a, F.when(b != 0, b)), F.lit(0.0))


def with_equity(ledger: DataFrame, keys: Sequence[str] = W.KEYS, returns: str = "strat") -> DataFrame:
    """Adds equity (compounded from 1) and drawdown (from the highest equity so far)."""
    return ledger.withColumn("equity", W.compounded(returns, keys)).withColumn("drawdown", W.drawdown("equity", keys))


def compute_stats(ledger: DataFrame, keys: Sequence[str] = W.KEYS, returns: str = "strat", periods_per_year: float = 252.0, risk_free: float = 0.0) -> DataFrame:
    """The nine metrics; null returns count as 0. Sortino divides by the deviation of the negative excess returns."""
    rows = with_equity(ledger.select(*keys, "timestamp", F.coalesce(returns, F.lit(0.0)).alias("r")), keys, "r")
    r, excess, root = F.col("r"), F.col("r") - risk_free / periods_per_year, math.sqrt(periods_per_year)
    n, growth = F.count("r"), F.product(1 + r)
    cagr = F.pow(growth, periods_per_year / n) - 1
    out = rows.groupBy(*keys).agg(
        (growth - 1).alias("total_return"), cagr.alias("cagr"), (F.coalesce(F.stddev_samp("r"), F.lit(0.0)) * root).alias("ann_volatility"),
        (_ratio(F.avg(excess), F.stddev_samp("r")) * root).alias("sharpe"), (_ratio(F.avg(excess), F.stddev_samp(F.when(excess < 0, excess))) * root).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"), _ratio(F.count_if(r > 0).cast("double"), F.count_if(r != 0).cast("double")).alias("win_rate"), n.alias("n_periods"),
    )
    return out.withColumn("calmar", _ratio(F.col("cagr"), F.abs("max_drawdown"))).select(*keys, *METRICS)


def monthly_table(ledger: DataFrame, keys: Sequence[str] = W.KEYS, returns: str = "strat") -> DataFrame:
    """Compounded returns by year and month, months as columns: the heart of a tearsheet."""
    months = ledger.withColumns({"year": F.year(wall_of(ledger)), "month": F.month(wall_of(ledger))})
    return months.groupBy(*keys, "year").pivot("month", list(range(1, 13))).agg(F.product(1 + F.coalesce(returns, F.lit(0.0))) - 1).orderBy(*keys, "year")


def html_report(ledger: DataFrame, path: str, title: str = "Strategy", keys: Sequence[str] = W.KEYS, returns: str = "strat", periods_per_year: float = 252.0, most: int = 100) -> str:
    """A small self-contained HTML page: statistics of the ``most`` keys with the best Sharpe ratios, and their months; returns its path.

    It goes through the file system that the path names, so a cluster's store will do.
    """
    import html

    def table(df: DataFrame) -> str:
        cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else html.escape(str(v))
        rows = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in row) + "</tr>" for row in df.collect())
        return f"<table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>{rows}</table>"

    found = compute_stats(ledger, keys, returns, periods_per_year).orderBy(F.desc("sharpe")).limit(most)
    months = monthly_table(ledger.join(F.broadcast(found.select(*keys)), list(keys), "left_semi"), keys, returns)  # at most ``most`` keys
    page = f"<!DOCTYPE html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{table(found)}<h2>Monthly returns</h2>{table(months)}"
    context = ledger.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(context._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(page.encode("utf-8")))
    finally:
        out.close()
    return path
