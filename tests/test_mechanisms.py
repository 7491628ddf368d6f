"""The lake's data source, running totals by ranges, ledgers of a grid, ties in streams, zones in walk-forward, ordered aggregates in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlume.functions.totals import running_totals
from barlume.operators import backtest as B
from barlume.operators import grids, learning, sweeps
from barlume.operators.stats import METRICS, compute_stats
from barlume.sources import lake_source
from barlume.sources.lake import Lake, without_ordered
from barlume.streaming.bars import stream_bars
from tests.conftest import made_bars


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- the data source

@pytest.fixture
def lake(spark, tmp_path):
    lake_source.register(spark)
    bars = spark.createDataFrame(pd.concat([made_bars(600, seed=k, symbol=s) for k, s in enumerate(("AAA", "B C", "123", "x/y"))]))
    lake_source.write_bars(bars, str(tmp_path))
    return str(tmp_path), bars


def rows(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("symbol", "timestamp", "close").collect())


def test_source_round_trip_and_layout(spark, lake, tmp_path):
    root, bars = lake
    found = spark.read.format("barlake").load(root)
    assert rows(found) == rows(bars) and found.filter("timeframe = '1d'").count() == bars.count() and found.filter("timeframe = '1h'").count() == 0
    assert not (tmp_path / "_staged").exists() and len(list(tmp_path.glob("timeframe=1d/symbol=AAA/year20*.parquet"))) == 3
    assert spark.read.format("barlake").load(root + "/none").count() == 0


def test_filters_choose_the_files_that_are_opened(spark, lake, tmp_path):
    root, bars = lake
    for at in tmp_path.glob("timeframe=1d/symbol=*/*.parquet"):  # whatever is opened beside these two symbols' files of 2020 breaks the read
        if not ("symbol=AAA" in str(at) or "symbol=123" in str(at)) or "year2020" not in at.name:
            at.write_bytes(b"broken")
    found = spark.read.format("barlake").load(root).filter("symbol IN ('AAA', '123') AND timestamp >= '2020-03-01' AND timestamp < '2020-06-03'")
    assert rows(found) == rows(bars.filter("symbol IN ('AAA', '123') AND timestamp >= '2020-03-01' AND timestamp < '2020-06-03'")) and found.count() > 50
    assert found.filter("symbol = 'AAA' AND symbol = '123'").count() == 0
    assert "PythonScan" not in plan_of(found) or "Filter (symbol" not in plan_of(found)  # what was pushed isn't filtered again
    with pytest.raises(Exception):
        spark.read.format("barlake").load(root).filter("symbol = 'B C'").collect()


def test_other_filters_stay_with_spark(spark, lake):
    root, bars = lake
    where = "close > 50 AND symbol LIKE '%A' AND timestamp > '2020-01-02' AND year(timestamp) = 2020 AND (symbol = 'AAA' OR volume > 1)"
    assert rows(spark.read.format("barlake").load(root).filter(where)) == rows(bars.filter(where))


def test_a_failed_write_leaves_nothing(spark, lake, tmp_path):
    root, bars = lake
    before = sorted(str(p) for p in tmp_path.rglob("*.parquet"))
    broken = bars.select("symbol", F.when(F.col("symbol") == "B C", None).otherwise(F.col("timestamp")).alias("timestamp"), "open", "high", "low", "close", "volume").repartition(3, "symbol")
    with pytest.raises(Exception, match="without symbol"):
        broken.write.format("barlake").mode("append").save(root)
    assert sorted(str(p) for p in tmp_path.rglob("*.parquet")) == before and not (tmp_path / "_staged").exists()
    assert rows(spark.read.format("barlake").load(root)) == rows(bars)


def test_append_and_overwrite(spark, lake):
    root, bars = lake
    one = bars.filter("symbol = 'AAA'").withColumn("close", F.col("close") + 1)
    lake_source.write_bars(one, root, mode="overwrite")  # the folders that it writes are replaced, others stay
    assert rows(spark.read.format("barlake").load(root)) == rows(bars.filter("symbol <> 'AAA'").unionByName(one))
    lake_source.write_bars(one, root, timeframe="1h")
    assert rows(spark.read.format("barlake").load(root).filter("timeframe = '1h'")) == rows(one)
    with pytest.raises(Exception):
        lake_source.write_bars(one, root, timeframe="7q")


def test_source_reads_what_spark_wrote(spark, tmp_path):
    lake_source.register(spark)
    bars = spark.createDataFrame(made_bars(300, symbol="AAA"))
    Lake(spark, str(tmp_path)).write(bars)
    where = "symbol = 'AAA' AND timestamp BETWEEN '2019-05-01' AND '2019-07-01'"
    assert rows(spark.read.format("barlake").load(str(tmp_path)).filter(where)) == rows(bars.filter(where))


# --- running totals

@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_running_totals(spark, ranges):
    rng = np.random.default_rng(ranges)
    x = rng.permutation(500)
    df = spark.createDataFrame([(float(v), int(v) % 7, None if v % 5 else int(v)) for v in x] + [(None, 3, 4)], "x double, a long, b long").repartition(5)
    found = {r["x"]: (r["sa"], r["sb"]) for r in running_totals(df, "x", {"sa": "a", "sb": "b"}, ranges).collect()}
    assert found[None] == (3, 4)
    assert all(found[float(v)] == (3 + sum(k % 7 for k in range(v + 1)), 4 + sum(k for k in range(v + 1) if k % 5 == 0)) for v in range(500))


def test_scores_of_distinct_probabilities_use_no_single_task(spark):
    df = spark.range(20_000).selectExpr("(id * 7919 % 20011) / 20011D AS proba", "CAST(pmod(xxhash64(id), 3) = 0 AS DOUBLE) AS label")
    found = learning.scores(df)
    assert "Window" in plan_of(found) and all("Exchange SinglePartition" not in part.split("Window")[-1] for part in plan_of(found).split("\n") if "Window" in part)
    assert plan_of(found).count("SinglePartition") <= 2  # the final sums, already added up in each task
    pdf = df.toPandas().sort_values("proba")
    ones = pdf["label"] == 1
    won = (~ones).cumsum()[ones].sum()
    assert abs(found.first()["auc"] - won / (ones.sum() * (~ones).sum())) < 1e-12


def test_dates_are_numbered_by_ranges(spark, panel):
    dates, n = learning.numbered_dates(panel)
    found = dates.orderBy("timestamp").collect()
    assert [r["row"] for r in found] == list(range(n)) and n == panel.select("timestamp").distinct().count()


# --- grids

def test_grid_ledgers_are_backtests(spark, panel):
    holes = panel.withColumn("close", F.when(F.col("volume") % 17 == 0, None).when(F.col("volume") % 19 == 0, 0.0).otherwise(F.col("close")))
    for bars in (panel, holes):
        rules = {"up": F.col("close") > F.col("open"), "never": F.lit(False), "half": F.when(F.col("high") > 50, 0.5), "short": F.when(F.col("low") < 80, -1.0).otherwise(1.0)}
        settings = [{"name": n} for n in rules]
        found = {(r["symbol"], r["name"]): r for r in grids.grid_stats(bars, list(rules.values()), settings, "name string", [0, 1, 5, 10]).collect()}
        for (name, rule), fee in zip(rules.items(), (0, 1, 5, 10), strict=True):
            for want in compute_stats(B.backtest(bars.withColumn("signal", rule.cast("double")), fee)).collect():
                got = found[want["symbol"], name]
                assert all(want[m] is None and got[m] is None or abs(want[m] - got[m]) < 1e-8 * max(1, abs(want[m])) for m in METRICS), (name, want, got)


def test_sweep_repeats_no_bars(spark, panel):
    plan = plan_of(sweeps.sweep_sma(panel, (5, 10), (20, 30)))
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan and plan.count("Exchange hashpartitioning") == 1


# --- zones, ties, ordered aggregates

def test_walk_forward_is_the_same_in_every_zone(spark):
    bars = spark.createDataFrame(made_bars(1500, seed=2)).withColumn("timestamp", F.expr("timestamp + INTERVAL '2' HOUR")).cache()
    found = []
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            found.append(sorted(map(tuple, sweeps.walk_forward(bars, (5, 10), 20)[0].collect())))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found[0] and found[0] == found[1] == found[2]


def test_ticks_of_one_time(spark, tmp_path):
    ticks = [("A", "2024-01-01 10:00:00", 9.0, 1.0, 2), ("A", "2024-01-01 10:00:00", 1.0, 1.0, 1), ("A", "2024-01-01 10:00:00", 5.0, 1.0, 3)]
    for k, order in enumerate(([0, 1, 2], [2, 1, 0], [1, 2, 0])):
        at = str(tmp_path / str(k))
        schema = "symbol string, timestamp timestamp, price double, quantity double, n long"
        late = [("", "2025-01-01 00:00:00", 0.0, 0.0, 0)]
        for part in ([ticks[i] for i in order], late):
            spark.createDataFrame(part, "symbol string, t string, price double, quantity double, n long").selectExpr("symbol", "CAST(t AS TIMESTAMP) AS timestamp", "price", "quantity", "n").coalesce(1).write.mode("append").parquet(f"{at}/in")
            stream = stream_bars(spark.readStream.schema(schema).parquet(f"{at}/in"), sequence="n")
            stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        assert [(r["open"], r["high"], r["low"], r["close"]) for r in spark.read.parquet(f"{at}/out").collect()] == [(1.0, 9.0, 1.0, 5.0)]


def test_ordered_aggregates():
    assert without_ordered("SELECT last(close ORDER BY timestamp), FIRST( open order by timestamp desc ) FROM lake ORDER BY 1") == "SELECT max_by(close, timestamp), max_by(open, timestamp) FROM lake ORDER BY 1"
    assert without_ordered("SELECT first(a ORDER BY b ASC), last(c ORDER BY d DESC), last(e) FROM t") == "SELECT min_by(a, b), min_by(c, d), last(e) FROM t"
