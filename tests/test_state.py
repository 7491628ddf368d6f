"""Indicators from SQL, and as the state of a stream, against the batch kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlume.operators.indicators import combine
from barlume.sources import lake_functions
from barlume.streaming.state import Rsi, Supertrend, state_store, stream_indicators
from tests.conftest import made_bars

SCHEMA = "symbol string, timestamp timestamp, open double, high double, low double, close double, volume double"
COLUMNS = ["rsi_14", "supertrend", "supertrend_dir"]


@pytest.fixture
def bars(spark, panel):
    lake_functions.register(spark)
    panel.createOrReplaceTempView("bars")
    return panel


def same(got, want) -> bool:
    a, b = (x.select("symbol", "timestamp", *COLUMNS).toPandas().sort_values(["symbol", "timestamp"]) for x in (got, want))
    return a.iloc[:, :2].to_numpy().tolist() == b.iloc[:, :2].to_numpy().tolist() and np.allclose(a[COLUMNS].astype(float), b[COLUMNS].astype(float), equal_nan=True, rtol=0, atol=1e-9)


def batch(df):
    return combine(df, [("rsi", {"window": 14}), ("supertrend", {})])


def test_table_function_gives_the_kernels_columns(spark, bars):
    got = spark.sql("SELECT * FROM indicator(TABLE(SELECT * FROM indicator(TABLE(bars), name => 'RSI', window => 14)), name => 'supertrend', multiplier => 3.0)")
    assert got.columns == [*bars.columns, *COLUMNS] and same(got, batch(bars))
    one = spark.sql("SELECT * FROM indicator(TABLE(SELECT timestamp, symbol, close FROM bars WHERE symbol = 'AAA'), name => 'ewma', span => 5)")
    assert one.columns == ["timestamp", "symbol", "close", "ewma_5"] and one.filter("ewma_5 IS NULL").count() == 0 and one.count() == 300
    assert spark.sql("SELECT * FROM indicator(TABLE(SELECT * FROM bars WHERE false), name => 'rsi')").count() == 0


@pytest.mark.parametrize("arguments, message", [("name => 'nothing'", "no indicator"), ("name => 'sma'", "window"), ("name => 'rsi', length => 3", "length"), ("name => 'rsi', window => length(symbol)", "constant")])
def test_table_function_refuses(spark, bars, arguments, message):
    with pytest.raises(Exception, match=message):
        spark.sql(f"SELECT * FROM indicator(TABLE(bars), {arguments})").count()
    with pytest.raises(Exception, match="there already"):
        spark.sql("SELECT * FROM indicator(TABLE(SELECT *, 1 AS RSI_14 FROM bars), name => 'rsi')").count()


def test_normal_functions_stay_in_the_plan(spark, bars):
    got = spark.sql("SELECT norm_cdf(1.959963984540054D) AS p, norm_pdf(0D) AS d, norm_cdf(CAST(NULL AS DOUBLE)) AS n").first()
    assert abs(got["p"] - 0.975) < 1e-14 and abs(got["d"] - (2 * np.pi) ** -0.5) < 1e-15 and got["n"] is None
    assert "Python" not in spark.sql("SELECT norm_cdf(close) FROM bars")._jdf.queryExecution().executedPlan().toString()


def run(spark, root, parts: list[pd.DataFrame], **settings):
    """Each part in a run of its own, from one checkpoint."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/bars")
        with state_store(spark):
            found = stream_indicators(spark.readStream.schema(SCHEMA).parquet(f"{root}/bars"), [Rsi(), Supertrend()], **settings)
            found.writeStream.format("parquet").option("path", f"{root}/found").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/found")


@pytest.fixture(scope="module")
def two():
    return pd.concat([made_bars(90, seed=k, symbol=s) for k, s in enumerate(("AAA", "B C"))]).sort_values("timestamp", kind="stable")


def test_state_survives_restarts_and_late_bars_do_no_harm(spark, tmp_path, two):
    cuts = [two.iloc[:15], two.iloc[15:110].sample(frac=1, random_state=3), pd.concat([two.iloc[40:60].assign(close=1.0), two.iloc[110:]])]
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    got = run(spark, tmp_path, cuts)
    assert same(got, batch(spark.createDataFrame(two, SCHEMA)))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == store


def test_a_stream_starts_from_the_past(spark, tmp_path, two):
    past = spark.createDataFrame(two.iloc[:100], SCHEMA)
    got = run(spark, tmp_path, [two.iloc[100:150], two.iloc[150:]], past=past)
    whole = batch(spark.createDataFrame(two, SCHEMA))
    assert got.count() == 80 and same(got, whole.join(got, ["symbol", "timestamp"], "left_semi"))


def test_a_silent_symbol_starts_anew(spark, tmp_path):
    first, other = made_bars(40, symbol="AAA"), made_bars(120, seed=2, symbol="BBB")
    again = made_bars(40, seed=3, symbol="AAA").assign(timestamp=lambda x: x["timestamp"] + pd.Timedelta(days=400))
    end = other.tail(1).assign(timestamp=other["timestamp"].max() + pd.Timedelta(days=100))
    day = 86_400_000
    got = run(spark, tmp_path, [pd.concat([first, other.iloc[:40]]), pd.concat([other.iloc[40:], end]), end.assign(timestamp=end["timestamp"] + pd.Timedelta(days=1)), again], idle=30 * day).filter("symbol = 'AAA'")
    want = batch(spark.createDataFrame(again, SCHEMA))
    assert same(got.filter(F.col("timestamp") >= again["timestamp"].min()), want) and got.count() == 80
