"""More of the catalogue: providers, the lake, streams, and what works on whole panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlume.functions import windows as W
from barlume.functions.scalar import norm_cdf_sql
from barlume.functions.times import instant, wall_of
from barlume.operators import backtest as B
from barlume.operators import learning, options
from barlume.operators.indicators import add_indicators, by_function, combine
from barlume.plans.catalogue import BAR_COLUMNS, RATE, REVERSION, RUN, STATE, W_SQL, full, lagged, oracle_sql, panel_sql, query, r
from barlume.plans.tables import BARS, HOURS, SPOT, daily, hourly, read
from barlume.sources import lake_source
from barlume.sources.contract import FIELDS, normalize
from barlume.sources.lake import Lake
from barlume.sources.providers import CachedProvider, FrameProvider, get_provider, register_provider
from barlume.sources.shared import fresh_folder
from barlume.streaming.bars import stream_bars
from barlume.streaming.state import Rsi, Supertrend, state_store, stream_indicators

START, END = "1995-01-01", "1996-12-31"


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily bars as instants, as providers and the lake have them."""
    return daily(spark, sf_dir).withColumn("timestamp", instant(F.col("timestamp"), "timestamp_ntz"))


def _walls(bars: DataFrame) -> DataFrame:
    return bars.withColumn("timestamp", wall_of(bars)).select("symbol", "timestamp", *FIELDS)


BETWEEN = f"timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"


@query(f"WITH {BARS} SELECT {BAR_COLUMNS} FROM bars WHERE symbol = 'Brand#12' AND {BETWEEN}")
def provider_symbol(spark, sf_dir):
    register_provider("catalogue", lambda **settings: FrameProvider(**settings))
    return _walls(get_provider("Catalogue", spark=spark, frame=_instants(spark, sf_dir)).get_ohlcv("Brand#12", START, END))


@query(f"WITH {BARS} SELECT {BAR_COLUMNS} FROM bars WHERE symbol IN ('Brand#12', 'Brand#13') AND {BETWEEN}")
def provider_panel_cached(spark, sf_dir):
    provider = CachedProvider(get_provider("frame", spark=spark, frame=_instants(spark, sf_dir)), fresh_folder(spark, "bars-cache"))
    provider.get_ohlcv_multi(["Brand#12", "Brand#13"], START, END)
    provider.inner = None  # the second request is answered from the cache
    return _walls(provider.get_ohlcv_multi(["Brand#12", "Brand#13"], START, END))


@query(f"WITH {BARS} SELECT {BAR_COLUMNS} FROM bars WHERE false")
def provider_panel_empty(spark, sf_dir):
    return _walls(get_provider("frame", spark=spark, frame=_instants(spark, sf_dir)).get_ohlcv_multi([]))


@query("""SELECT p_brand AS strike_of, option_type, '2024-01-19' AS expiry, count(*) AS n, round(max(p_retailprice), 6) + 0.0::DOUBLE AS top FROM part, (VALUES ('call'), ('put')) AS o(option_type) GROUP BY ALL""")
def provider_chain(spark, sf_dir):
    legs = read(spark, sf_dir, "part").select(F.col("p_brand").alias("Brand"), F.col("p_retailprice").alias("Strike"))
    provider = FrameProvider(spark, legs, {"X": {"2024-02-16": (legs.limit(0), legs), "2024-01-19": (legs, legs)}})
    return provider.get_options_chain("X").groupBy(F.col("brand").alias("strike_of"), "option_type", "expiry").agg(F.count("*").alias("n"), F.max("strike").alias("top"))


#: Bars as a vendor would send them: other names, text for dates, a repeated day whose later row counts, an adjusted close.
VENDOR = f"""WITH {BARS} SELECT symbol, timestamp, {r('open', 'open')}, {r('high + 1', 'high')}, {r('low', 'low')}, {r('close + 0.5::DOUBLE', 'close')}, {r('volume', 'volume')} FROM bars"""


def _vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily(spark, sf_dir).select(
        F.col("symbol").alias("Symbol"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("Date"), F.col("open").alias("Open"), (F.col("high") + 1).alias(" High "), F.col("low").alias("LOW"),
        F.col("close").alias("Close"), (F.col("close") + 0.5).alias("Adj Close"), F.col("volume").cast("long").alias("Vol"),
    )
    return rows.withColumn("_seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("Open", F.when(F.col("_seq") == 1, -1.0).otherwise(F.col("Open")))


@query(VENDOR)
def normalize_vendor(spark, sf_dir):
    return _walls(normalize(_vendor(spark, sf_dir)))


@query(VENDOR.replace("close + 0.5::DOUBLE", "close"))
def normalize_vendor_unadjusted(spark, sf_dir):
    return _walls(normalize(_vendor(spark, sf_dir), adjust=False))


NEW = "new AS (SELECT symbol, timestamp + INTERVAL 7 DAYS AS timestamp, open + 1 AS open, high + 1 AS high, low + 1 AS low, close + 1 AS close, volume FROM bars WHERE symbol < 'Brand#3')"
LAKE = f"WITH {BARS}, {NEW}, lake AS (SELECT * FROM new UNION ALL SELECT * FROM bars ANTI JOIN new USING (symbol, timestamp))"


def _filled(spark: SparkSession, sf_dir: str) -> Lake:
    """A lake that was written to twice; the later rows count."""
    lake, bars = Lake(spark, fresh_folder(spark, "bars-lake")), _instants(spark, sf_dir)
    lake.write(bars)
    lake.write(bars.filter("symbol < 'Brand#3'").withColumns({c: F.col(c) + 1 for c in FIELDS[:4]} | {"timestamp": F.expr("timestamp + INTERVAL '7' DAY")}))
    return lake


@query(f"{LAKE} SELECT {BAR_COLUMNS} FROM lake")
def lake_upsert_scan(spark, sf_dir):
    return _walls(_filled(spark, sf_dir).scan("1d"))


LAST = "SELECT symbol, close, volume FROM lake QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1"


@query(f"{LAKE}, q AS ({LAST}) SELECT symbol, {r('close', 'close')}, {r('volume', 'volume')} FROM q")
def lake_sql_latest(spark, sf_dir):
    return _filled(spark, sf_dir).query(LAST)


@query(f"WITH {BARS} SELECT symbol, count(*) AS bars, {r('sum(close)', 'total')} FROM bars WHERE symbol IN ('Brand#12', 'Brand#13') AND {BETWEEN} GROUP BY symbol")
def lake_ingest(spark, sf_dir):
    lake = Lake(spark, fresh_folder(spark, "bars-ingest"))
    lake.ingest(FrameProvider(spark, _instants(spark, sf_dir)), ["Brand#12", "Brand#13"], START, END)
    return lake.scan().groupBy("symbol").agg(F.count("*").alias("bars"), F.sum("close").alias("total"))


@query(f"WITH {HOURS} SELECT {BAR_COLUMNS} FROM bars")
def stream_bars_hourly(spark, sf_dir):
    """The ticks as a stream of files, then one tick a year later, which moves the watermark past all bars and is in none that comes out."""
    at = fresh_folder(spark, "bars-stream")
    ticks = read(spark, sf_dir, "events")
    last = ticks.agg(F.max("ts").alias("ts")).select(F.expr("ts + INTERVAL '365' DAY").alias("ts"), F.lit(0).cast("long").alias("event_id"), F.lit("").alias("event_type"), F.lit(0.0).alias("value"))
    names = ["ts", "event_id", "event_type", "value"]
    for part in (ticks.select(names), last.select(names)):  # two files after another, a batch each
        part.write.mode("append").parquet(f"{at}/ticks")
        found = spark.readStream.schema(last.select(names).schema).parquet(f"{at}/ticks")
        found = found.select(F.col("event_type").alias("symbol"), instant(F.col("ts"), "timestamp_ntz").alias("timestamp"), "event_id", (F.col("value") + 1).alias("price"), F.lit(1.0).alias("quantity"))
        bars = stream_bars(found, sequence="event_id").writeStream.outputMode("append").format("parquet").option("path", f"{at}/bars")
        bars.trigger(availableNow=True).option("checkpointLocation", f"{at}/state").start().awaitTermination()
    return _walls(spark.read.parquet(f"{at}/bars"))


@query(f"WITH {BARS} SELECT {BAR_COLUMNS} FROM bars WHERE symbol IN ('Brand#12', 'Brand#13', 'Brand#55') AND timestamp >= TIMESTAMP '{START}' AND timestamp < TIMESTAMP '{END}'")
def lake_source_pushdown(spark, sf_dir):
    """The bars through the data source: written by its writer, read with filters that choose its files."""
    lake_source.register(spark)
    root = fresh_folder(spark, "bars-source")
    lake_source.write_bars(_instants(spark, sf_dir), root)
    at = lambda day: instant(F.lit(day), "string")
    rows = spark.read.format("barlake").load(root).filter(F.col("symbol").isin("Brand#12", "Brand#13", "Brand#55") & (F.col("timeframe") == "1d"))
    return _walls(rows.filter((F.col("timestamp") >= at(START)) & (F.col("timestamp") < at(END))))


SPANS = "SELECT symbol, last(close ORDER BY timestamp) AS last_close, count(*) AS bars, first(open ORDER BY timestamp) AS first_open FROM lake GROUP BY symbol"


@query(f"{LAKE}, q AS ({SPANS}) SELECT symbol, {r('last_close', 'last_close')}, bars, {r('first_open', 'first_open')} FROM q")
def lake_sql_ordered_last(spark, sf_dir):
    return _filled(spark, sf_dir).query(SPANS)


# Labels, edges, last rows, functions by their usual names

LABEL = f"lead(close, 5) OVER ({W_SQL}) / nullif(close, 0) - 1"


@query(f"WITH {BARS}, l AS (SELECT symbol, {LABEL} AS ahead FROM bars) SELECT symbol, count(ahead) AS n, {r('avg((ahead > 0)::INT::DOUBLE)', 'base_rate')} FROM l GROUP BY symbol")
def base_rate(spark, sf_dir):
    return learning.base_rate(daily(spark, sf_dir).select("symbol", learning.binary_label(5).alias("label")))


@query(f"WITH {BARS}{STATE}, e AS (SELECT symbol, timestamp, signal > 0 AS now, coalesce({lagged('signal')}, 0) > 0 AS before FROM sig) SELECT symbol, timestamp, now AS entry FROM e WHERE now <> before")
def signal_edges(spark, sf_dir):
    df = B.build_signal(daily(spark, sf_dir), REVERSION)
    entry, exit_ = W.edges("signal")
    return df.withColumns({"entry": entry, "exit": exit_}).filter("entry OR exit").select("symbol", "timestamp", "entry")


@query(f"WITH {BARS} SELECT {BAR_COLUMNS} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) <= 5")
def tail_bars(spark, sf_dir):
    return W.last_rows(daily(spark, sf_dir), 5)


_K = f"100 * (close - {full('min', 'low', 14)}) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0)"


@query(panel_sql(f"""{r(full('avg', 'close', 10), '"SMA_real"')}, {r('sk', '"STOCH_slowk"')}, {r(full('avg', 'sk', 3), '"STOCH_slowd"')}, {r(f'sum(sv) OVER {RUN}', '"OBV_real"')}""", "g",
  f", f AS (SELECT *, {_K} AS k, coalesce(sign(close - {lagged('close')}), 0) * volume AS sv FROM bars), g AS (SELECT *, {full('avg', 'k', 3)} AS sk FROM f)"))
def functions_by_name(spark, sf_dir):
    df = add_indicators(daily(spark, sf_dir), [("SMA", {"timeperiod": 10}), ("STOCH", {"fastk_period": 14}), ("obv", {})])
    return df.select("symbol", "timestamp", "SMA_real", "STOCH_slowk", "STOCH_slowd", "OBV_real")


def _through(f: str, y: str, x: str, n: int) -> str:
    return f"CASE WHEN count({y} + {x}) OVER w{n} >= {n} THEN {f}({y}, {x}) OVER w{n} END"


_SLOPE, _START = _through("regr_slope", "close", "i", 14), _through("regr_intercept", "close", "i", 14)
_FRAMES = " WINDOW " + ", ".join(f"w{n} AS ({W_SQL} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 14, 30))


@query(panel_sql(", ".join([
    r(f"{_START} + {_SLOPE} * i", '"LINEARREG_real"'), r(_SLOPE, '"LINEARREG_SLOPE_real"'), r(f"degrees(atan({_SLOPE}))", '"LINEARREG_ANGLE_real"'), r(f"{_START} + {_SLOPE} * (i - 13)", '"LINEARREG_INTERCEPT_real"'),
    r(f"{_START} + {_SLOPE} * (i + 1)", '"TSF_real"'), r(_through("corr", "high", "low", 30), '"CORREL_real"'), r(_through("regr_slope", "rb", "ra", 5), '"BETA_real"'),
]), "f" + _FRAMES, f", f AS (SELECT *, (row_number() OVER ({W_SQL}))::DOUBLE AS i, high / nullif({lagged('high')}, 0) - 1 AS ra, low / nullif({lagged('low')}, 0) - 1 AS rb FROM bars)"))
def window_statistics_by_name(spark, sf_dir):
    names = ["LINEARREG", "LINEARREG_SLOPE", "LINEARREG_ANGLE", "LINEARREG_INTERCEPT", "TSF", "CORREL", "BETA"]
    return add_indicators(daily(spark, sf_dir), [(n, {}) for n in names]).select("symbol", "timestamp", *(f"{n}_real" for n in names))


# Folds over a whole panel, scores, covered calls

FOLDS = f"""WITH {BARS}, d AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM bars)),
  f AS (SELECT timestamp, i, n, k, k * (n // 5) + least(k, n % 5) AS a, k * (n // 5) + least(k, n % 5) + n // 5 + CASE WHEN k < n % 5 THEN 1 ELSE 0 END AS b, CAST(floor(n * 0.01::DOUBLE) AS BIGINT) AS gap FROM d, range(5) AS r(k)),
  roles AS (SELECT timestamp, k, CASE WHEN i >= a AND i < b THEN 'test' WHEN i < a AND i >= a - 10 THEN 'purged' WHEN i >= b AND i < b + gap THEN 'embargoed' ELSE 'train' END AS role FROM f)"""


@query(f"{FOLDS} SELECT CAST(k AS INTEGER) AS fold, role, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM bars JOIN roles USING (timestamp) GROUP BY k, role")
def panel_folds(spark, sf_dir):
    rows = learning.panel_folds(daily(spark, sf_dir).select("symbol", "timestamp"))
    return rows.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query("""WITH s AS (SELECT l_discount AS p, (l_returnflag = 'R')::INT AS y FROM lineitem),
  c AS (SELECT p, count(*) FILTER (WHERE y = 1) AS ones, count(*) FILTER (WHERE y = 0) AS zeros FROM s GROUP BY p),
  w AS (SELECT sum(a.ones * b.zeros * CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0 END) AS won FROM c a, c b)
  SELECT count(*) AS n, round(avg(((p > 0.5) = (y = 1))::INT::DOUBLE), 6) AS accuracy, round((SELECT won FROM w) / (sum(y)::DOUBLE * sum(1 - y)::DOUBLE), 6) AS auc FROM s""")
def model_scores(spark, sf_dir):
    """The scores of a made-up model: the discount says whether a line came back."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_discount").cast("double").alias("proba"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return learning.scores(rows)


_YEARS, _SIGMA = "days / 365.0::DOUBLE", "(0.1::DOUBLE + days / 100.0::DOUBLE)"
_D1 = f"(ln({SPOT}::DOUBLE / strike) + ({RATE}::DOUBLE + {_SIGMA} * {_SIGMA} / 2) * {_YEARS}) / ({_SIGMA} * sqrt({_YEARS}))"


@query(f"""WITH c AS (SELECT p_brand AS symbol, p_retailprice AS strike, p_size AS days, p_retailprice / 50 AS mid FROM part WHERE p_size BETWEEN 20 AND 40), d AS (SELECT *, {_D1} AS d1 FROM c),
  g AS (SELECT *, {norm_cdf_sql('d1')} AS delta FROM d) SELECT symbol, {r('strike', 'strike')}, days, {r('delta', 'delta')}, {r('mid', 'mid')}, {r(f'mid / {SPOT}::DOUBLE / ({_YEARS})', 'annual_yield')} FROM g
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(abs(delta - 0.3::DOUBLE), 9), strike, days) = 1""")
def covered_calls(spark, sf_dir):
    calls = read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("symbol"), F.col("p_retailprice").alias("strike"), F.col("p_size").alias("days"), (F.lit(0.1) + F.col("p_size") / 100).alias("sigma"), (F.col("p_retailprice") / 50).alias("mid"),
    )
    return options.covered_calls(calls, SPOT)


# Candlestick patterns, by the number of their bars

# For bar i before the last: o h l c, body, top and bottom of it, shadows u and d; for patterns of n bars the usual body ub and range ur.
_BARS_BACK = ", ".join(f"lag({x}, {i}) OVER w AS {x[0]}{i}" for i in range(3) for x in ("open", "high", "low", "close"))
_USUAL = ", ".join(f"CASE WHEN count(*) OVER n{n} = 10 THEN avg({x}) OVER n{n} END AS {name}{n}" for n in (1, 2, 3) for x, name in (("abs(close - open)", "ub"), ("high - low", "ur")))
_FRAMES = ", ".join(f"n{n} AS ({W_SQL} ROWS BETWEEN {9 + n} PRECEDING AND {n} PRECEDING)" for n in (1, 2, 3))
_PARTS = ", ".join(f"abs(c{i} - o{i}) AS body{i}, greatest(o{i}, c{i}) AS t{i}, least(o{i}, c{i}) AS b{i}, h{i} - greatest(o{i}, c{i}) AS u{i}, least(o{i}, c{i}) - l{i} AS d{i}" for i in range(3))
CANDLES = f"""WITH {BARS}, back AS (SELECT *, {_BARS_BACK}, {_USUAL} FROM bars WINDOW w AS ({W_SQL}), {_FRAMES}), x AS (SELECT *, {_PARTS} FROM back)"""
# Name: (rises, falls).
_CANDLE_SQL = {
    1: {
        "MARUBOZU": ("c0 > o0 AND body0 > ub1 AND u0 < 0.1 * ur1 AND d0 < 0.1 * ur1", "c0 < o0 AND body0 > ub1 AND u0 < 0.1 * ur1 AND d0 < 0.1 * ur1"),
        "SPINNINGTOP": ("c0 > o0 AND body0 < ub1 AND u0 > body0 AND d0 > body0", "c0 < o0 AND body0 < ub1 AND u0 > body0 AND d0 > body0"),
        "DRAGONFLYDOJI": ("body0 <= 0.1 * ur1 AND u0 < 0.1 * ur1 AND d0 >= 0.1 * ur1", None),
        "GRAVESTONEDOJI": ("body0 <= 0.1 * ur1 AND d0 < 0.1 * ur1 AND u0 >= 0.1 * ur1", None),
        "LONGLINE": ("c0 > o0 AND body0 > ub1 AND u0 < body0 / 2 AND d0 < body0 / 2", "c0 < o0 AND body0 > ub1 AND u0 < body0 / 2 AND d0 < body0 / 2"),
        "BELTHOLD": ("c0 > o0 AND body0 > ub1 AND d0 < 0.1 * ur1", "c0 < o0 AND body0 > ub1 AND u0 < 0.1 * ur1"),
    },
    2: {
        "HAMMER": ("body0 < ub2 AND d0 > 2 * body0 AND u0 < 0.1 * ur2 AND b0 <= l1 + 0.2 * ur2", None),
        "HANGINGMAN": (None, "body0 < ub2 AND d0 > 2 * body0 AND u0 < 0.1 * ur2 AND b0 >= h1 - 0.2 * ur2"),
        "INVERTEDHAMMER": ("body0 < ub2 AND u0 > 2 * body0 AND d0 < 0.1 * ur2 AND t0 < b1", None),
        "SHOOTINGSTAR": (None, "body0 < ub2 AND u0 > 2 * body0 AND d0 < 0.1 * ur2 AND b0 > t1"),
        "HARAMI": ("c1 < o1 AND body1 > ub2 AND body0 < ub2 AND t0 < o1 AND b0 > c1", "c1 > o1 AND body1 > ub2 AND body0 < ub2 AND t0 < c1 AND b0 > o1"),
        "HARAMICROSS": ("c1 < o1 AND body1 > ub2 AND body0 <= 0.1 * ur2 AND t0 < o1 AND b0 > c1", "c1 > o1 AND body1 > ub2 AND body0 <= 0.1 * ur2 AND t0 < c1 AND b0 > o1"),
        "PIERCING": ("c1 < o1 AND body1 > ub2 AND c0 > o0 AND body0 > ub2 AND o0 < l1 AND c0 > (o1 + c1) / 2 AND c0 < o1", None),
        "DARKCLOUDCOVER": (None, "c1 > o1 AND body1 > ub2 AND c0 < o0 AND o0 > h1 AND c0 < (o1 + c1) / 2 AND c0 > o1"),
        "KICKING": (
            "c1 < o1 AND c0 > o0 AND l0 > h1 AND least(body0, body1) > ub2 AND greatest(u0, u1, d0, d1) < 0.1 * ur2",
            "c1 > o1 AND c0 < o0 AND h0 < l1 AND least(body0, body1) > ub2 AND greatest(u0, u1, d0, d1) < 0.1 * ur2",
        ),
        "DOJISTAR": ("c1 < o1 AND body1 > ub2 AND body0 <= 0.1 * ur2 AND t0 < c1", "c1 > o1 AND body1 > ub2 AND body0 <= 0.1 * ur2 AND b0 > c1"),
        "MATCHINGLOW": ("c1 < o1 AND c0 < o0 AND abs(c1 - c0) <= 0.2 * ur2", None),
        "SEPARATINGLINES": ("c1 < o1 AND c0 > o0 AND abs(o1 - o0) <= 0.2 * ur2 AND body0 > ub2 AND d0 < 0.1 * ur2", "c1 > o1 AND c0 < o0 AND abs(o1 - o0) <= 0.2 * ur2 AND body0 > ub2 AND u0 < 0.1 * ur2"),
    },
    3: {
        "3WHITESOLDIERS": ("least(c2 - o2, c1 - o1, c0 - o0) > 0 AND body2 > ub3 AND c2 < c1 AND c1 < c0 AND o1 > o2 AND o1 <= c2 AND o0 > o1 AND o0 <= c1 AND greatest(u0, u1, u2) < 0.1 * ur3", None),
        "3BLACKCROWS": (None, "greatest(c2 - o2, c1 - o1, c0 - o0) < 0 AND body2 > ub3 AND c2 > c1 AND c1 > c0 AND o1 < o2 AND o1 >= c2 AND o0 < o1 AND o0 >= c1 AND greatest(d0, d1, d2) < 0.1 * ur3"),
        "MORNINGSTAR": ("c2 < o2 AND body2 > ub3 AND body1 < ub3 AND t1 < c2 AND c0 > o0 AND c0 > c2 + 0.3 * body2", None),
        "EVENINGSTAR": (None, "c2 > o2 AND body2 > ub3 AND body1 < ub3 AND b1 > c2 AND c0 < o0 AND c0 < c2 - 0.3 * body2"),
        "MORNINGDOJISTAR": ("c2 < o2 AND body2 > ub3 AND body1 <= 0.1 * ur3 AND t1 < c2 AND c0 > o0 AND c0 > c2 + 0.3 * body2", None),
        "EVENINGDOJISTAR": (None, "c2 > o2 AND body2 > ub3 AND body1 <= 0.1 * ur3 AND b1 > c2 AND c0 < o0 AND c0 < c2 - 0.3 * body2"),
        "3INSIDE": ("c2 < o2 AND body2 > ub3 AND body1 < ub3 AND t1 < o2 AND b1 > c2 AND c0 > o0 AND c0 > o2", "c2 > o2 AND body2 > ub3 AND body1 < ub3 AND t1 < c2 AND b1 > o2 AND c0 < o0 AND c0 < o2"),
        "3OUTSIDE": ("c2 < o2 AND c1 > o1 AND c1 > o2 AND o1 < c2 AND c0 > c1", "c2 > o2 AND c1 < o1 AND c1 < o2 AND o1 > c2 AND c0 < c1"),
        "TRISTAR": ("greatest(body0, body1, body2) <= 0.1 * ur3 AND t1 < b2 AND t1 < b0", "greatest(body0, body1, body2) <= 0.1 * ur3 AND b1 > t2 AND b1 > t0"),
    },
}


def _enter_candles(n: int, word: str) -> None:
    of = _CANDLE_SQL[n]
    cases = ", ".join(f"""CASE WHEN ur{n} IS NULL THEN 0{f' WHEN {up} THEN 100' if up else ''}{f' WHEN {down} THEN -100' if down else ''} ELSE 0 END AS "CDL{name}_integer\"""" for name, (up, down) in of.items())

    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return add_indicators(daily(spark, sf_dir), [(f"CDL{name}", {}) for name in of]).select("symbol", "timestamp", *(f"CDL{name}_integer" for name in of))

    found.__name__ = f"candles_of_{word}"
    query(f"{CANDLES} SELECT symbol, timestamp, {cases} FROM x")(found)


for _n, _word in ((1, "one_bar"), (2, "two_bars"), (3, "three_bars")):
    _enter_candles(_n, _word)

_HIKKAKE = """f AS (SELECT *, CASE WHEN ur3 IS NULL THEN 0 WHEN h1 < h2 AND l1 > l2 AND h0 < h1 AND l0 < l1 THEN 100 WHEN h1 < h2 AND l1 > l2 AND h0 > h1 AND l0 > l1 THEN -100 ELSE 0 END AS v,
  row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS i FROM x),
latest AS (SELECT b.symbol, b.i, b.close, b.v, p.v AS was, p.h1 AS top, p.l1 AS bottom, p.i AS since FROM f b LEFT JOIN f p ON p.symbol = b.symbol AND p.v <> 0 AND p.i BETWEEN b.i - 3 AND b.i - 1
  QUALIFY row_number() OVER (PARTITION BY b.symbol, b.i ORDER BY p.i DESC NULLS LAST) = 1),
beyond AS (SELECT l.symbol, l.i, l.was FROM latest l WHERE (l.was = 100 AND l.close > l.top OR l.was = -100 AND l.close < l.bottom)
  AND NOT EXISTS (SELECT 1 FROM f m WHERE m.symbol = l.symbol AND m.i > l.since AND m.i < l.i AND (l.was = 100 AND m.close > l.top OR l.was = -100 AND m.close < l.bottom)))"""


@query(f"""{CANDLES}, {_HIKKAKE} SELECT f.symbol, f.timestamp, (CASE WHEN f.v <> 0 THEN f.v ELSE coalesce(2 * beyond.was, 0) END)::INTEGER AS "CDLHIKKAKE_integer" FROM f LEFT JOIN beyond USING (symbol, i)""")
def candle_confirmed(spark, sf_dir):
    return add_indicators(daily(spark, sf_dir), [("CDLHIKKAKE", {})]).select("symbol", "timestamp", "CDLHIKKAKE_integer")


# Recursive indicators from SQL and over streams


def _over(bars: str, name: str) -> str:
    """The SQL of a query over daily bars, over other bars."""
    return oracle_sql()[name].replace(BARS, bars)


_LAKE_BARS = f"{BARS.replace('bars AS', 'base AS', 1)}, {NEW.replace('FROM bars', 'FROM base')}, bars AS (SELECT * FROM new UNION ALL SELECT * FROM base ANTI JOIN new USING (symbol, timestamp))"
INDICATORS = "SELECT symbol, timestamp, rsi_14, supertrend, supertrend_dir FROM indicator(TABLE(SELECT * FROM indicator(TABLE(SELECT symbol, timestamp, high, low, close FROM lake), name => 'rsi')), name => 'supertrend', period => 10)"


@query(f"SELECT * FROM ({_over(_LAKE_BARS, 'rsi')}) a JOIN ({_over(_LAKE_BARS, 'supertrend')}) b USING (symbol, timestamp)")
def lake_sql_indicators(spark, sf_dir):
    found = _filled(spark, sf_dir).query(INDICATORS)
    return found.withColumn("timestamp", wall_of(found))


CHANCES = "SELECT symbol, norm_cdf(avg(close) / 1500 - 1) AS p, norm_pdf(avg(close) / 1500 - 1) AS density FROM lake GROUP BY symbol"


@query(f"{LAKE}, q AS (SELECT symbol, avg(close) / 1500 - 1 AS x FROM lake GROUP BY symbol) SELECT symbol, {r(norm_cdf_sql('x'), 'p')}, {r('exp(-x * x / 2) / sqrt(2 * pi())', 'density')} FROM q")
def lake_sql_normal(spark, sf_dir):
    return _filled(spark, sf_dir).query(CHANCES)


@query(f"SELECT * FROM ({_over(HOURS, 'rsi')}) a JOIN ({_over(HOURS, 'supertrend')}) b USING (symbol, timestamp)")
def stream_state_indicators(spark, sf_dir):
    """Hourly bars as a stream that stops half-way and goes on from its checkpoint."""
    at = fresh_folder(spark, "bars-state")
    bars = hourly(spark, sf_dir).withColumn("timestamp", instant(F.col("timestamp"), "timestamp_ntz"))
    bars.write.parquet(f"{at}/all")
    bars = spark.read.schema(bars.schema).parquet(f"{at}/all")
    at_micros = F.unix_micros("timestamp")
    middle = bars.agg(((F.min(at_micros) + F.max(at_micros)) / 2).cast("long")).first()[0]
    first = F.coalesce(at_micros <= F.lit(middle), F.lit(True))
    for part in (bars.filter(first), bars.filter(~first)):
        part.write.mode("append").parquet(f"{at}/bars")
        with state_store(spark):
            found = stream_indicators(spark.readStream.schema(bars.schema).parquet(f"{at}/bars"), [Rsi(), Supertrend()])
            found.writeStream.format("parquet").option("path", f"{at}/found").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{at}/found")
    return out.withColumn("timestamp", wall_of(out))


# Cycles

_H = "(0.0962::DOUBLE * ({0} - {3}) + 0.5769::DOUBLE * ({1} - {2}))"
_SMOOTH = f"f AS (SELECT *, first_value(close) OVER ({W_SQL}) AS c0, row_number() OVER ({W_SQL}) AS i FROM bars), sm AS (SELECT symbol, timestamp, i, close, (4 * close + 3 * coalesce({lagged('close')}, c0) + 2 * coalesce({lagged('close', 2)}, c0) + coalesce({lagged('close', 3)}, c0)) / 10.0::DOUBLE AS s FROM f)"
_FILTERED = f"num AS (SELECT *, {_H.format('s', *(f'coalesce(lag(s, {k}) OVER ({W_SQL}), first_value(s) OVER ({W_SQL}))' for k in (2, 4, 6)))} AS hs FROM sm)"
_ZEROS = "[" + ", ".join(["0.0::DOUBLE"] * 10) + "]"
# Lists have the newest value first: d the filtered price, q that filtered again.
_CYCLE_STEP = f"""SELECT symbol, i, d, q, i2, q2, re, im, period, 0.33::DOUBLE * period + 0.67::DOUBLE * slow AS slow FROM (
  SELECT * EXCLUDE (period), 0.2::DOUBLE * greatest(least(greatest(least(CASE WHEN re <> 0 AND im <> 0 THEN 2 * pi() / atan(im / re) ELSE period END, 1.5::DOUBLE * period), 0.67::DOUBLE * period), 50), 6) + 0.8::DOUBLE * period AS period FROM (
  SELECT symbol, i, d, q, ni AS i2, nq AS q2, 0.2::DOUBLE * (ni * i2 + nq * q2) + 0.8::DOUBLE * re AS re, 0.2::DOUBLE * (ni * q2 - nq * i2) + 0.8::DOUBLE * im AS im, period, slow FROM (
  SELECT *, 0.2::DOUBLE * (d[4] - gain * {_H.format('q[1]', 'q[3]', 'q[5]', 'q[7]')}) + 0.8::DOUBLE * i2 AS ni, 0.2::DOUBLE * (q[1] + gain * {_H.format('d[4]', 'd[6]', 'd[8]', 'd[10]')}) + 0.8::DOUBLE * q2 AS nq FROM (
  SELECT * EXCLUDE (q), list_prepend(gain * {_H.format('d[1]', 'd[3]', 'd[5]', 'd[7]')}, q[1:9]) AS q FROM (
  SELECT c.symbol, c.i, list_prepend((0.075::DOUBLE * p.period + 0.54::DOUBLE) * c.hs, p.d[1:9]) AS d, p.q, p.i2, p.q2, p.re, p.im, p.period, p.slow, 0.075::DOUBLE * p.period + 0.54::DOUBLE AS gain
  FROM cyc p JOIN num c ON c.symbol = p.symbol AND c.i = p.i + 1)))))"""
_Z8 = ", ".join(f"0.0::DOUBLE AS {c}" for c in ("i2", "q2", "re", "im", "period", "slow"))
_CYCLES = f"WITH RECURSIVE {BARS}, {_SMOOTH}, {_FILTERED}, cyc AS (SELECT DISTINCT symbol, 0::BIGINT AS i, {_ZEROS} AS d, {_ZEROS} AS q, {_Z8} FROM bars UNION ALL {_CYCLE_STEP}), per AS (SELECT num.*, slow AS p, floor(slow + 0.5::DOUBLE)::BIGINT AS n FROM num JOIN cyc USING (symbol, i))"


@query(f"{_CYCLES} SELECT symbol, timestamp, {r('CASE WHEN i > 32 THEN p END', 'real')} FROM per".replace(" AS real", ' AS "HT_DCPERIOD_real"'))
def cycle_period(spark, sf_dir):
    return by_function("HT_DCPERIOD", daily(spark, sf_dir))


_BACK = "list(s) OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
_PHASE = f"""b AS (SELECT *, list_reverse({_BACK})[1:n] AS xs, list_reverse({_BACK.replace('list(s)', 'list(close)')})[1:greatest(n, 1)] AS cs FROM per),
ri AS (SELECT *, list_sum(list_transform(xs, lambda x, k: x * sin(2 * pi() * (k - 1) / n))) AS re, list_sum(list_transform(xs, lambda x, k: x * cos(2 * pi() * (k - 1) / n))) AS im, list_avg(cs) AS mean FROM b),
ang AS (SELECT *, CASE WHEN abs(im) > 0.001 THEN degrees(atan(re / im)) WHEN re >= 0 THEN 90.0::DOUBLE ELSE -90.0::DOUBLE END + 90 + 360 / p + CASE WHEN im < 0 THEN 180 ELSE 0 END AS a FROM ri),
ph AS (SELECT *, CASE WHEN a > 315 THEN a - 360 ELSE a END AS phase, first_value(mean) OVER ({W_SQL}) AS m0 FROM ang),
md AS (SELECT *, (4 * mean + 3 * coalesce({lagged('mean')}, m0) + 2 * coalesce({lagged('mean', 2)}, m0) + coalesce({lagged('mean', 3)}, m0)) / 10.0::DOUBLE AS line, sin(radians(phase)) - sin(radians(phase + 45)) > 0 AS over, phase - {lagged('phase')} AS pace FROM ph),
cr AS (SELECT *, coalesce(max(i) FILTER (WHERE turned) OVER ({W_SQL} ROWS UNBOUNDED PRECEDING), 1) AS since FROM (SELECT *, over <> {lagged('over')} AS turned FROM md))"""
_MODE = "CASE WHEN abs((s - line) / line) >= 0.015::DOUBLE THEN 1 WHEN i - since < p / 2 OR (pace > 0.67::DOUBLE * 360 / p AND pace < 1.5::DOUBLE * 360 / p) THEN 0 ELSE 1 END"
_SHOWN = {"HT_TRENDLINE": "line", "HT_SINE_sine": "sin(radians(phase))", "HT_SINE_leadsine": "sin(radians(phase + 45))", "HT_TRENDMODE": f"({_MODE})::DOUBLE"}


@query(f"""{_CYCLES}, {_PHASE} SELECT symbol, timestamp, {", ".join(r(f"CASE WHEN i > 32 THEN {x} END", f'"{name}"') for name, x in _SHOWN.items())} FROM cr""")
def cycle_mode(spark, sf_dir):
    return combine(daily(spark, sf_dir), [("ht_trendline", {}), ("ht_sine", {}), ("ht_trendmode", {})], join_input=False)


@query(f"SELECT symbol, timestamp, ewma_20 AS \"EMA_real\" FROM (WITH RECURSIVE {BARS}, num AS (SELECT *, row_number() OVER ({W_SQL}) AS i, avg(close) OVER ({W_SQL} ROWS 19 PRECEDING) AS mean FROM bars), rec AS (SELECT symbol, i, mean AS y FROM num WHERE i = 20 UNION ALL SELECT c.symbol, c.i, p.y + 2 / 21.0::DOUBLE * (c.close - p.y) FROM rec p JOIN num c ON c.symbol = p.symbol AND c.i = p.i + 1) SELECT n.symbol, n.timestamp, {r('y', 'ewma_20')} FROM num n LEFT JOIN rec USING (symbol, i))")
def ema_of_mean(spark, sf_dir):
    return by_function("EMA", daily(spark, sf_dir), timeperiod=20, seed="mean")
