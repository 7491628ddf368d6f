"""Closes that equal their mean: a comparison then hangs on the mean's last bit, which is that of the SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlume.functions import windows as W
from barlume.plans import catalogue


@pytest.mark.parametrize("n", [14, 20, 32, 60])
def test_mean_in_blocks_is_the_sqls_bit_for_bit(spark, n):
    closes = np.random.default_rng(4).integers(9000, 10000, 600) / 10.0
    bars = pd.DataFrame({"symbol": "A", "timestamp": pd.date_range("2000-01-01", periods=600), "close": closes})
    bars["close"] = bars["close"].astype(object).where(bars.index != 300, None)
    df = spark.createDataFrame(bars, "symbol string, timestamp timestamp, close double")
    found = [r["m"] for r in df.select("timestamp", W.mean_in_blocks("close", n).alias("m")).orderBy("timestamp").collect()]
    plain = [r["m"] for r in df.select("timestamp", W.full(F.avg, "close", n).alias("m")).orderBy("timestamp").collect()]
    c = duckdb.connect()
    c.execute("CREATE TABLE bars (day INT, close DOUBLE)")
    c.executemany("INSERT INTO bars VALUES (?, ?)", [(k, x) for k, x in enumerate(bars["close"])])
    want = c.execute(f"SELECT CASE WHEN count(close) OVER w >= {n} THEN avg(close) OVER w END FROM bars WINDOW w AS (ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) ORDER BY day").fetchall()
    assert found == [x for (x,) in want]
    assert (found != plain) == (n > 16)


def tie(seed: int, first: int = 109, after: int = 12) -> np.ndarray:
    """Low closes, then 20 high ones of which the last is the mean of all, then some more."""
    rng = np.random.default_rng(seed)
    high = rng.integers(9300, 9700, 19)
    high[0] -= high.sum() % 19
    return np.concatenate((rng.integers(9000, 9100, first), high, [high.sum() // 19], rng.integers(9300, 9700, after))) / 10.0


@pytest.mark.parametrize("seed", [3, 12])
def test_sweep_combo_decides_a_tie_as_its_sql(spark, tmp_path, seed):
    closes = tie(seed)
    key = np.arange(len(closes))
    items = pd.DataFrame({"l_orderkey": key, "l_partkey": key, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 1.0, "l_shipdate": pd.date_range("2000-01-01", periods=len(key))})
    parts = pd.DataFrame({"p_partkey": key, "p_brand": "Brand#1", "p_retailprice": closes})
    c = duckdb.connect()
    for name, table, kinds in (("lineitem", items, "* REPLACE (l_shipdate::TIMESTAMP AS l_shipdate)"), ("part", parts, "*")):
        c.register("made", table)
        c.execute(f"COPY (SELECT {kinds} FROM made) TO '{tmp_path}/{name}.parquet'")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    found = sorted(tuple(r) for r in catalogue.queries()["sweep_combo"](spark, str(tmp_path)).collect())
    want = sorted(c.execute(catalogue.oracle_sql()["sweep_combo"]).fetchall())
    assert len(want) == 16 and [r[:3] for r in found] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in found], [r[3:] for r in want], rtol=0, atol=2e-6)
