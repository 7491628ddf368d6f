"""The query catalogue: one query for each operator, over whole tables, with its DuckDB SQL beside it.

Doubles are rounded to six places in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlume.functions import windows as W
from barlume.functions.scalar import norm_cdf_sql
from barlume.operators import backtest as B
from barlume.operators import learning, options, scanners, sweeps
from barlume.operators.indicators import combine
from barlume.operators.stats import METRICS, compute_stats, monthly_table, with_equity
from barlume.plans.tables import BARS, BENCHMARK, CHAIN, HOURS, SPOT, daily, hourly, read
from barlume.plans.tables import options as chain_table
from barlume.sources.bars import resample
from barlume.sources.contract import breaches, keep_last
from barlume.sources.lake import merged, without_qualify
from barlume.sources.providers import option_chain

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
PLACES = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zeros."""
    return df.select(*((F.round(c, PLACES) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def enter(f: Query) -> Query:
        _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return enter


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r(x: str, name: str = "") -> str:
    """SQL for a rounded double."""
    return f"round({x}, {PLACES}) + 0.0::DOUBLE" + (f" AS {name}" if name else "")


W_SQL = "PARTITION BY symbol ORDER BY timestamp"


def frame(n: int) -> str:
    return f"({W_SQL} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} >= {least or n} THEN {agg}({x}) OVER {frame(n)} END"


def panel_sql(columns: str, source: str = "bars", extra: str = "") -> str:
    return f"WITH {BARS}{extra} SELECT symbol, timestamp, {columns} FROM {source}"


def added(name: str, value: Callable[[], Column]) -> Query:
    """The daily bars' keys and one more column, built once a session is there."""
    return lambda spark, sf_dir: daily(spark, sf_dir).withColumn(name, value()).select("symbol", "timestamp", name)


def indicator(*specs: tuple[str, dict]) -> Query:
    return lambda spark, sf_dir: combine(daily(spark, sf_dir), specs, join_input=False)


def enter(name: str, f: Query, sql: str | None = None) -> None:
    f.__name__ = name
    query(sql)(f)


# Bars and their contract

BAR_COLUMNS = "symbol, timestamp, " + ", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume"))
enter("bars_daily", daily, f"WITH {BARS} SELECT {BAR_COLUMNS} FROM bars")
enter("bars_hourly", hourly, f"WITH {HOURS} SELECT {BAR_COLUMNS} FROM bars")

RESAMPLED = """coarse AS (SELECT symbol, {0} AS timestamp, first(open ORDER BY timestamp) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY timestamp) AS close, sum(volume) AS volume
  FROM bars GROUP BY 1, 2)"""
FRIDAY = "(CAST(timestamp AS DATE) + CAST((12 - isodow(timestamp)) % 7 AS INTEGER))::TIMESTAMP"
MONTH_END = "last_day(timestamp)::TIMESTAMP"
HALF_DAY = "time_bucket(INTERVAL 12 HOURS, timestamp, TIMESTAMP '1970-01-01')"
enter("resample_weekly", lambda s, d: resample(daily(s, d), "W-FRI"), f"WITH {BARS}, {RESAMPLED.format(FRIDAY)} SELECT {BAR_COLUMNS} FROM coarse")
enter("resample_monthly", lambda s, d: resample(daily(s, d), "ME"), f"WITH {BARS}, {RESAMPLED.format(MONTH_END)} SELECT {BAR_COLUMNS} FROM coarse")
enter("resample_intraday", lambda s, d: resample(hourly(s, d), "12h"), f"WITH {HOURS}, {RESAMPLED.format(HALF_DAY)} SELECT {BAR_COLUMNS} FROM coarse")


@query(f"WITH {BARS} SELECT symbol, date_trunc('month', timestamp)::TIMESTAMP AS month, count(*) AS bars, {r('avg(close)', 'avg_close')}, {r('max(high) - min(low)', 'spread')} FROM bars GROUP BY 1, 2")
def month_rollup(spark, sf_dir):
    rows = daily(spark, sf_dir).groupBy("symbol", F.date_trunc("month", "timestamp").cast("timestamp_ntz").alias("month"))
    return rows.agg(F.count("*").alias("bars"), F.avg("close").alias("avg_close"), (F.max("high") - F.min("low")).alias("spread"))


@query(f"""WITH {BARS} SELECT count(*) AS bars, count(*) FILTER (WHERE high + 1e-9 < greatest(open, close, low)) AS bad_high, count(*) FILTER (WHERE low - 1e-9 > least(open, close, high)) AS bad_low,
  count(*) FILTER (WHERE volume < 0) AS bad_volume, count(*) - count(DISTINCT (symbol, timestamp)) AS repeated, count(*) FILTER (WHERE timestamp IS NULL OR symbol IS NULL) AS unkeyed FROM bars""")
def validate_contract(spark, sf_dir):
    return breaches(daily(spark, sf_dir))


@query("""SELECT symbol, timestamp, price, seq FROM (SELECT p_brand AS symbol, l_shipdate AS timestamp, p_retailprice AS price, l_orderkey * 100 + l_linenumber AS seq, l_suppkey, l_partkey,
  row_number() OVER (PARTITION BY p_brand, l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_partkey DESC) AS k FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE k = 1""")
def keep_last_dedupe(spark, sf_dir):
    items, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    rows = items.join(parts, items["l_partkey"] == parts["p_partkey"]).select(
        F.col("p_brand").alias("symbol"), F.col("l_shipdate").alias("timestamp"), F.col("p_retailprice").alias("price"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("_seq"),
    )
    return keep_last(rows).drop("_seq")


@query(f"""WITH {BARS}, new AS (SELECT symbol, timestamp + INTERVAL 7 DAYS AS timestamp, open + 1 AS open, high + 1 AS high, low + 1 AS low, close + 1 AS close, volume FROM bars WHERE symbol < 'Brand#3')
  SELECT {BAR_COLUMNS} FROM (SELECT * FROM new UNION ALL SELECT * FROM bars ANTI JOIN new USING (symbol, timestamp))""")
def upsert_merge(spark, sf_dir):
    old = daily(spark, sf_dir)
    new = old.filter("symbol < 'Brand#3'").select("symbol", F.expr("timestamp + INTERVAL '7' DAY").alias("timestamp"), *((F.col(c) + 1).alias(c) for c in ("open", "high", "low", "close")), "volume")
    return merged(old, new)


# Ordered windows

enter("sma_full", indicator(("sma", {"window": 20}), ("sma", {"window": 50})), panel_sql(f"{r(full('avg', 'close', 20), 'sma_20')}, {r(full('avg', 'close', 50), 'sma_50')}"))
enter("std_pop", indicator(("std", {"window": 20})), panel_sql(r(full("stddev_pop", "close", 20), "std_20")))
enter("std_samp", indicator(("std", {"window": 20, "ddof": 1})), panel_sql(r(full("stddev_samp", "close", 20), "std_20")))
Z = f"CASE WHEN {full('stddev_pop', 'close', 20)} = 0 THEN 0.0::DOUBLE ELSE (close - {full('avg', 'close', 20)}) / nullif({full('stddev_pop', 'close', 20)}, 0) END"
enter("zscore_full", indicator(("zscore", {"window": 20})), panel_sql(r(Z, "zscore_20")))
Z_PARTIAL = "SELECT symbol, timestamp, (close - avg(close) OVER w20) / nullif(stddev_pop(close) OVER w20, 0) AS z FROM {0} WINDOW w20 AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
enter("zscore_sql_partial", lambda s, d: s.sql(Z_PARTIAL.format("{bars}"), bars=daily(s, d)), f"WITH {BARS}, z AS ({Z_PARTIAL.format('bars')}) SELECT symbol, timestamp, {r('z', 'z')} FROM z")


def lagged(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({W_SQL})"


RET = f"close / nullif({lagged('close')}, 0) - 1"
enter("simple_return", indicator(("ret", {"periods": 1}), ("ret", {"periods": 5})), panel_sql(f"{r(RET, 'ret_1')}, {r(f'close / nullif({lagged("close", 5)}, 0) - 1', 'ret_5')}"))
enter("log_return", added("log_ret", lambda: W.log_change("close")), panel_sql(r(f"ln(close) - ln({lagged('close')})", "log_ret")))
AHEAD = "lead(close, 5) OVER (PARTITION BY symbol ORDER BY timestamp) / nullif(close, 0) - 1"
enter("forward_return", added("fwd_5", lambda: W.forward_change("close", 5)), panel_sql(r(AHEAD, "fwd_5")))
RUN = f"({W_SQL} ROWS UNBOUNDED PRECEDING)"
RETURNS = f", rets AS (SELECT *, {RET} AS ret FROM bars), eq AS (SELECT *, product(1 + coalesce(ret, 0)) OVER {RUN} AS equity FROM rets)"


@query(panel_sql(r("equity - 1", "cum_return"), "eq", RETURNS))
def cum_return(spark, sf_dir):
    df = daily(spark, sf_dir).withColumn("ret", W.change("close"))
    return df.select("symbol", "timestamp", (W.compounded("ret") - 1).alias("cum_return"))


@query(panel_sql(f"{r('equity', 'equity')}, {r(f'equity / max(equity) OVER {RUN} - 1', 'drawdown')}", "eq", RETURNS))
def drawdown(spark, sf_dir):
    df = daily(spark, sf_dir).withColumn("ret", W.change("close"))
    return with_equity(df, returns="ret").select("symbol", "timestamp", "equity", "drawdown")


TR = f"greatest(high - low, abs(high - {lagged('close')}), abs(low - {lagged('close')}))"
enter("true_range", indicator(("trange", {})), panel_sql(r(TR, '"TRANGE"')))
enter("donchian", indicator(("donchian", {"window": 20})), panel_sql(f"{r(full('max', 'high', 20), 'donchian_high_20')}, {r(full('min', 'low', 20), 'donchian_low_20')}"))
_MID, _SD = full("avg", "close", 20), full("stddev_pop", "close", 20)
enter("bollinger", indicator(("bbands", {})), panel_sql(f'{r(f"{_MID} + 2 * {_SD}", chr(34) + "BBANDS_upperband" + chr(34))}, {r(_MID, chr(34) + "BBANDS_middleband" + chr(34))}, {r(f"{_MID} - 2 * {_SD}", chr(34) + "BBANDS_lowerband" + chr(34))}'))
_WMA = " + ".join(f"{10 - k} * lag(close, {k}) OVER ({W_SQL})" if k else "10 * close" for k in range(10))
enter("wma", indicator(("wma", {"window": 10})), panel_sql(r(f"CASE WHEN count(close) OVER {frame(10)} >= 10 THEN ({_WMA}) / 55.0::DOUBLE END", "wma_10")))
_FAST = f"100 * (close - {full('min', 'low', 14)}) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0)"
enter("stoch", indicator(("stoch", {})), panel_sql(f"""{r('sk', '"STOCH_slowk"')}, {r(full('avg', 'sk', 3), '"STOCH_slowd"')}""", "g", f", f AS (SELECT *, {_FAST} AS k FROM bars), g AS (SELECT *, {full('avg', 'k', 3)} AS sk FROM f)"))
_CCI = f"CASE WHEN len(tps) = 14 THEN (tp - list_avg(tps)) / nullif(0.015::DOUBLE * list_sum(list_transform(tps, lambda x: abs(x - list_avg(tps)))) / 14, 0) END"
enter("cci", indicator(("cci", {"timeperiod": 14})), panel_sql(r(_CCI, '"CCI_14"'), "g", f", f AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), g AS (SELECT *, list(tp) OVER {frame(14)} AS tps FROM f)"))
_MFI = f""", f AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), g AS (SELECT *, {lagged("tp")} AS btp FROM f),
  h AS (SELECT *, CASE WHEN tp > btp THEN tp * volume WHEN btp IS NOT NULL THEN 0 END AS up, CASE WHEN tp < btp THEN tp * volume WHEN btp IS NOT NULL THEN 0 END AS down FROM g)"""
enter("mfi", indicator(("mfi", {"timeperiod": 14})), panel_sql(r(f"100 * ({full('sum', 'up', 14)}) / nullif(({full('sum', 'up', 14)}) + ({full('sum', 'down', 14)}), 0)", '"MFI_14"'), "h", _MFI))
enter("obv", indicator(("obv", {})), panel_sql(r(f"sum(sv) OVER {RUN}", '"OBV"'), "f", f", f AS (SELECT *, coalesce(sign(close - {lagged('close')}), 0) * volume AS sv FROM bars)"))
enter("ad_line", indicator(("ad", {})), panel_sql(r(f"sum(coalesce((2 * close - low - high) / nullif(high - low, 0), 0) * volume) OVER {RUN}", '"AD"')))
_ENGULF = """CASE WHEN close > open AND bc < bo AND close >= bo AND open <= bc AND (close > bo OR open < bc) THEN 100
  WHEN close < open AND bc > bo AND open >= bc AND close <= bo AND (open > bc OR close < bo) THEN -100 ELSE 0 END AS "CDLENGULFING\""""
enter("candle_engulfing", indicator(("cdlengulfing", {})), panel_sql(_ENGULF, "f", f", f AS (SELECT *, {lagged('open')} AS bo, {lagged('close')} AS bc FROM bars)"))
enter("candle_doji", indicator(("cdldoji", {})), panel_sql('CASE WHEN high > low AND abs(close - open) <= 0.1::DOUBLE * (high - low) THEN 100 ELSE 0 END AS "CDLDOJI"'))
enter("hl_range", indicator(("hl_range", {"window": 20})), panel_sql(r(full("avg", "hl", 20), "hl_range_20"), "f", ", f AS (SELECT *, (high - low) / nullif(close, 0) AS hl FROM bars)"))
enter("dollar_volume", added("dollar_vol", lambda: W.full(F.avg, F.col("close") * F.col("volume"), 20)), panel_sql(r(full("avg", "dv", 20), "dollar_vol"), "f", ", f AS (SELECT *, close * volume AS dv FROM bars)"))
enter("gap", added("gap", lambda: F.try_divide(F.col("open"), F.lag("close").over(W.ordered())) - 1), panel_sql(r(f"open / nullif({lagged('close')}, 0) - 1", "gap")))
enter("pct_from_high", added("pct_from_high", lambda: F.try_divide(F.col("close"), W.full(F.max, "close", 252, least=20)) - 1), panel_sql(r(f"close / nullif({full('max', 'close', 252, 20)}, 0) - 1", "pct_from_high")))
_MDD = "list_reduce(list_prepend({'peak': 0.0::DOUBLE, 'worst': 0.0::DOUBLE}, list_transform(xs, lambda x: {'peak': x, 'worst': 0.0::DOUBLE})), lambda a, b: {'peak': greatest(a.peak, b.peak), 'worst': least(a.worst, b.peak / greatest(a.peak, b.peak) - 1)}).worst"
enter("rolling_drawdown", indicator(("rolling_mdd", {"window": 20})), panel_sql(r(f"CASE WHEN len(xs) = 20 THEN {_MDD} END", "rolling_mdd_20"), "f", f", f AS (SELECT *, list(close) OVER {frame(20)} AS xs FROM bars)"))


@query("SELECT user_id, ts AS timestamp, round(avg(value) OVER w + 0.0::DOUBLE, 6) AS mean_3, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def user_windows(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(-2, 0)
    return read(spark, sf_dir, "events").select("user_id", F.col("ts").alias("timestamp"), F.avg("value").over(w).alias("mean_3"), F.count("*").over(w).alias("n"))


# Latest rows, joins, tallies


@query(f"WITH {BARS} SELECT symbol, {r('last(close ORDER BY timestamp)', 'last_close')}, count(*) AS bars FROM bars GROUP BY symbol")
def last_close_bars(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "timestamp").alias("last_close"), F.count("*").alias("bars"))


LATEST = """SELECT symbol, timestamp, close, close / lag(close, 20) OVER w - 1 AS mom20 FROM {0} WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1"""


@query(f"WITH {BARS}, l AS ({LATEST.format('bars')}) SELECT symbol, timestamp, {r('close', 'close')}, {r('mom20', 'mom20')} FROM l")
def latest_momentum_snapshot(spark, sf_dir):
    return spark.sql(without_qualify(LATEST.format("{bars}")), bars=daily(spark, sf_dir))


@query(f"WITH {BARS} SELECT symbol, timestamp, {r('close', 'close')} FROM bars WHERE timestamp = (SELECT max(timestamp) FROM bars)")
def latest_date_rows(spark, sf_dir):
    bars = daily(spark, sf_dir)
    last = bars.agg(F.max("timestamp").alias("timestamp"))
    return bars.join(F.broadcast(last), "timestamp").select("symbol", "timestamp", "close")  # one row


@query(f"""WITH {BARS}, b AS (SELECT timestamp, close AS bench FROM bars WHERE symbol = '{BENCHMARK}'), j AS (SELECT symbol, timestamp, close / nullif(bench, 0) AS rs FROM bars JOIN b USING (timestamp) WHERE symbol <> '{BENCHMARK}')
  SELECT symbol, timestamp, {r('rs', 'rs')} FROM j QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1""")
def rel_strength_latest(spark, sf_dir):
    bars = daily(spark, sf_dir)
    bench = bars.filter(F.col("symbol") == BENCHMARK).select("timestamp", F.col("close").alias("bench"))
    joined = bars.filter(F.col("symbol") != BENCHMARK).join(bench, "timestamp").select("symbol", "timestamp", F.try_divide(F.col("close"), F.col("bench")).alias("rs"))
    return W.latest_per(joined)


BENCH = f""", b AS (SELECT timestamp, close AS bench0 FROM bars WHERE symbol = '{BENCHMARK}'), j AS (SELECT bars.*, bench0 FROM bars LEFT JOIN b USING (timestamp)),
  l AS (SELECT *, last_value(bench0 IGNORE NULLS) OVER {RUN} AS bench FROM j)"""


@query(panel_sql(f"{r('bench', 'bench')}, {r('close / nullif(bench, 0)', 'rs')}", "l", BENCH))
def rel_strength_line_ffill(spark, sf_dir):
    bars = daily(spark, sf_dir)
    line = scanners.benchmark_line(bars, bars.filter(F.col("symbol") == BENCHMARK))
    return line.select("symbol", "timestamp", "bench", F.try_divide(F.col("close"), F.col("bench")).alias("rs"))


@query(f"""WITH {BARS}, z AS (SELECT symbol, timestamp, {Z} AS z FROM bars) SELECT symbol, count(*) FILTER (WHERE z > 2) AS overbought, count(*) AS bars FROM z
  WHERE timestamp > (SELECT max(timestamp) FROM bars) - INTERVAL 1 YEAR GROUP BY symbol""")
def overbought_tally(spark, sf_dir):
    df = combine(daily(spark, sf_dir), [("zscore", {"window": 20})])
    last = df.agg(F.max("timestamp").alias("last"))
    recent = df.join(F.broadcast(last), F.expr("timestamp > last - INTERVAL '1' YEAR"))  # one row
    return recent.groupBy("symbol").agg(F.count_if(F.col("zscore_20") > 2).alias("overbought"), F.count("*").alias("bars"))


@query(f"""WITH {BARS}, m AS (SELECT symbol, timestamp, close / nullif({lagged('close', 20)}, 0) - 1 AS mom20 FROM bars)
  SELECT symbol, timestamp, {r('mom20', 'mom20')}, row_number() OVER (PARTITION BY timestamp ORDER BY mom20 DESC, symbol) AS rank FROM m WHERE mom20 IS NOT NULL""")
def xs_rank_momentum(spark, sf_dir):
    df = daily(spark, sf_dir).select("symbol", "timestamp", W.change("close", 20).alias("mom20")).dropna(subset=["mom20"])
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("timestamp").orderBy(F.desc("mom20"), "symbol")).cast("long"))


@query(f"""WITH {BARS}, m AS (SELECT symbol, timestamp, {RET} AS ret FROM bars)
  SELECT symbol, timestamp, {r('(ret - avg(ret) OVER (PARTITION BY timestamp)) / nullif(stddev_samp(ret) OVER (PARTITION BY timestamp), 0)', 'xs_z')} FROM m""")
def xs_zscore_score(spark, sf_dir):
    df = daily(spark, sf_dir).select("symbol", "timestamp", W.change("close").alias("ret"))
    day = Window.partitionBy("timestamp")
    sd = F.stddev_samp("ret").over(day)
    return df.select("symbol", "timestamp", F.try_divide(F.col("ret") - F.avg("ret").over(day), F.when(sd != 0, sd)).alias("xs_z"))


@query(f"WITH {BARS}{RETURNS} SELECT symbol, {r('avg(ret)', 'mean_ret')}, {r('stddev_samp(ret)', 'std_ret')}, {r('min(ret)', 'min_ret')}, {r('max(ret)', 'max_ret')}, {r('product(1 + ret) - 1', 'compounded')} FROM rets GROUP BY symbol")
def return_summary(spark, sf_dir):
    df = daily(spark, sf_dir).withColumn("ret", W.change("close"))
    return df.groupBy("symbol").agg(F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("std_ret"), F.min("ret").alias("min_ret"), F.max("ret").alias("max_ret"), (F.product(1 + F.col("ret")) - 1).alias("compounded"))


@query(f"WITH {BARS} SELECT DISTINCT symbol, CAST(year(timestamp) AS INTEGER) AS year FROM bars")
def distinct_years(spark, sf_dir):
    return daily(spark, sf_dir).select("symbol", F.year("timestamp").alias("year")).distinct()


@query(f"""WITH {BARS}, a AS (SELECT timestamp, close AS x FROM bars WHERE symbol = 'Brand#12'), b AS (SELECT timestamp, close AS y FROM bars WHERE symbol = '{BENCHMARK}')
  SELECT timestamp, {r('x + y', 'total')} FROM a FULL JOIN b USING (timestamp)""")
def outer_alignment(spark, sf_dir):
    bars = daily(spark, sf_dir)
    leg = lambda s, n: bars.filter(F.col("symbol") == s).select("timestamp", F.col("close").alias(n))
    return leg("Brand#12", "x").join(leg(BENCHMARK, "y"), "timestamp", "full_outer").select("timestamp", (F.col("x") + F.col("y")).alias("total"))


@query(f"WITH {BARS}, f AS (SELECT * FROM bars WHERE volume >= 100) SELECT {BAR_COLUMNS} FROM bars SEMI JOIN f USING (symbol, timestamp)")
def index_subset(spark, sf_dir):
    bars = daily(spark, sf_dir)
    return bars.join(bars.filter("volume >= 100").select("symbol", "timestamp"), ["symbol", "timestamp"], "left_semi")


# Signals and backtests


def _crossing(spark, sf_dir, fast: int = 20, slow: int = 50) -> DataFrame:
    return combine(daily(spark, sf_dir), [("sma", {"window": fast}), ("sma", {"window": slow})])


@query(f"""WITH {BARS}, f AS (SELECT symbol, timestamp, {full('avg', 'close', 20)} AS f, {full('avg', 'close', 50)} AS s FROM bars), g AS (SELECT *, {lagged('f')} AS bf, {lagged('s')} AS bs FROM f)
  SELECT symbol, timestamp, CASE WHEN f - s > 1e-9 THEN 1 ELSE -1 END AS crossing FROM g WHERE (f - s > 1e-9 AND bf - bs <= 1e-9) OR (s - f > 1e-9 AND bs - bf <= 1e-9)""")
def crossover_events(spark, sf_dir):
    w = W.ordered()
    df = _crossing(spark, sf_dir).withColumns({"bf": F.lag("sma_20").over(w), "bs": F.lag("sma_50").over(w)})
    up, down = W.true(F.expr("sma_20 - sma_50 > 1e-9 AND bf - bs <= 1e-9")), W.true(F.expr("sma_50 - sma_20 > 1e-9 AND bs - bf <= 1e-9"))
    return df.filter(up | down).select("symbol", "timestamp", F.when(up, 1).otherwise(-1).alias("crossing"))


STATE = f""", f AS (SELECT *, {full('avg', 'close', 20)} AS sma_20, {Z} AS z FROM bars),
  g AS (SELECT *, CASE WHEN coalesce(z > 1, false) THEN 0.0::DOUBLE WHEN coalesce(z < -1, false) THEN 1.0::DOUBLE END AS event FROM f),
  sig AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER {RUN}, 0.0::DOUBLE) AS signal FROM g)"""
REVERSION = B.StrategyConfig(indicators=[("zscore", {"window": 20})], entry="zscore_20 < -1", exit="zscore_20 > 1")


@query(panel_sql(r("signal", "signal"), "sig", STATE))
def state_machine(spark, sf_dir):
    return B.build_signal(daily(spark, sf_dir), REVERSION).select("symbol", "timestamp", "signal")


def ledger_sql(signals: str, fee: str = "1.0::DOUBLE", keys: str = "symbol", out: str = "led") -> str:
    """CTEs from a table with close and signal to its ledger."""
    w = f"OVER (PARTITION BY {keys} ORDER BY timestamp)"
    return f""", {out}1 AS (SELECT *, close / nullif(lag(close) {w}, 0) - 1 AS ret, coalesce(lag(coalesce(signal, 0.0::DOUBLE)) {w}, 0.0::DOUBLE) AS position FROM {signals}),
  {out}2 AS (SELECT *, abs(position - coalesce(lag(position) {w}, 0.0::DOUBLE)) AS turnover FROM {out}1), {out} AS (SELECT *, coalesce(position * ret - turnover * {fee} / 1e4, 0.0::DOUBLE) AS strat FROM {out}2)"""


def stats_sql(ledger: str, keys: str = "symbol", per_year: float = 252.0, metrics: tuple[str, ...] = METRICS, returns: str = "strat", raw: bool = False) -> str:
    """A query for the metrics of a ledger."""
    p = f"{per_year}::DOUBLE"
    shown = ", ".join(m if raw or m == "n_periods" else r(m, m) for m in metrics)
    return f"""SELECT {keys}, {shown} FROM (SELECT {keys}, product(1 + x) - 1 AS total_return, pow(product(1 + x), {p} / count(x)) - 1 AS cagr, coalesce(stddev_samp(x), 0) * sqrt({p}) AS ann_volatility,
  coalesce(avg(x) / nullif(stddev_samp(x), 0), 0) * sqrt({p}) AS sharpe, coalesce(avg(x) / nullif(stddev_samp(x) FILTER (WHERE x < 0), 0), 0) * sqrt({p}) AS sortino, min(dd) AS max_drawdown,
  coalesce((pow(product(1 + x), {p} / count(x)) - 1) / nullif(abs(min(dd)), 0), 0) AS calmar, coalesce(count(*) FILTER (WHERE x > 0) / nullif(count(*) FILTER (WHERE x <> 0), 0)::DOUBLE, 0) AS win_rate, count(x) AS n_periods
  FROM (SELECT {keys}, x, eq / max(eq) OVER (PARTITION BY {keys} ORDER BY timestamp ROWS UNBOUNDED PRECEDING) - 1 AS dd
    FROM (SELECT {keys}, timestamp, x, product(1 + x) OVER (PARTITION BY {keys} ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS eq FROM (SELECT {keys}, timestamp, coalesce({returns}, 0) AS x FROM {ledger}))) GROUP BY {keys})"""


GOLDEN = B.StrategyConfig(indicators=[("sma", {"window": 20}), ("sma", {"window": 50})], rule="sma_20 - sma_50 > 1e-9", name="golden cross")
CROSS = f", sig AS (SELECT *, coalesce(({full('avg', 'close', 20)}) - ({full('avg', 'close', 50)}) > 1e-9, false)::INT::DOUBLE AS signal FROM bars)"


@query(f"WITH {BARS}{CROSS}{ledger_sql('sig')} {stats_sql('led')}")
def golden_cross_stats(spark, sf_dir):
    return B.run_strategy(daily(spark, sf_dir), GOLDEN).stats


@query(panel_sql(", ".join(r(c, c) for c in ("ret", "position", "turnover", "strat")), "led", CROSS + ledger_sql("sig")))
def backtest_ledger(spark, sf_dir):
    return B.run_strategy(daily(spark, sf_dir), GOLDEN).ledger.select("symbol", "timestamp", "ret", "position", "turnover", "strat")


WEEKLY_CROSS = f", sig AS (SELECT *, coalesce(({full('avg', 'close', 4)}) - ({full('avg', 'close', 12)}) > 1e-9, false)::INT::DOUBLE AS signal FROM coarse)"


@query(f"WITH {BARS}, {RESAMPLED.format(FRIDAY)}{WEEKLY_CROSS}{ledger_sql('sig')} {stats_sql('led', per_year=52.0)}")
def weekly_strategy_stats(spark, sf_dir):
    config = B.StrategyConfig(indicators=[("sma", {"window": 4}), ("sma", {"window": 12})], rule="sma_4 - sma_12 > 1e-9")
    return B.run_strategy(daily(spark, sf_dir), config, resample_rule="W-FRI").stats


@query(f"""WITH {BARS}, f AS (SELECT *, {full('avg', 'close', 20)} AS sma_20, {Z} AS z FROM bars),
  sig AS (SELECT *, coalesce((coalesce(close > sma_20, false) AND coalesce(z < 1.5, false)) OR NOT coalesce(abs(z) > 0.2, false), false)::INT::DOUBLE AS signal FROM f){ledger_sql('sig', '2.0::DOUBLE')} {stats_sql('led')}""")
def rule_combo_stats(spark, sf_dir):
    config = B.StrategyConfig(indicators=[("sma", {"window": 20}), ("zscore", {"window": 20})], rule="((close > sma_20) & (zscore_20 < 1.5)) | ~(np.abs(zscore_20) > 0.2)", fee_bps=2.0)
    return B.run_strategy(daily(spark, sf_dir), config).stats


@query(f"WITH {BARS}{STATE}, short AS (SELECT symbol, timestamp, close, -signal AS signal FROM sig){ledger_sql('short')} {stats_sql('led')}")
def short_strategy_stats(spark, sf_dir):
    return B.run_strategy(daily(spark, sf_dir), B.StrategyConfig(indicators=REVERSION.indicators, entry=REVERSION.entry, exit=REVERSION.exit, direction="short")).stats


@query(f"""WITH {BARS}{CROSS}, feed AS (SELECT symbol, timestamp, close, signal, fee_bps FROM sig, (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE), (25.0::DOUBLE)) AS f(fee_bps))
  {ledger_sql('feed', 'fee_bps', 'symbol, fee_bps')} {stats_sql('led', 'symbol, fee_bps')}""")
def fee_sensitivity(spark, sf_dir):
    return sweeps.fee_sensitivity(B.build_signal(daily(spark, sf_dir), GOLDEN))


@query(f"WITH {BARS}{CROSS}{ledger_sql('sig')}, p AS (SELECT timestamp, sum(strat) / (SELECT count(DISTINCT symbol) FROM bars) AS strat FROM led GROUP BY timestamp) SELECT timestamp, {r('strat', 'strat')} FROM p")
def portfolio_equal_weight(spark, sf_dir):
    return B.run_strategy_multi(daily(spark, sf_dir), GOLDEN).portfolio.select("timestamp", "strat")


@query(f"WITH {BARS}{RETURNS} {stats_sql('rets', returns='ret')}")
def buy_hold_stats(spark, sf_dir):
    return compute_stats(daily(spark, sf_dir).withColumn("ret", W.change("close")), returns="ret")


@query(f"""WITH {BARS}, f AS (SELECT *, {RET} AS ret FROM bars), g AS (SELECT symbol, ret, coalesce(ret > 0, false)::INT AS now, lag(coalesce(ret > 0, false)::INT) OVER ({W_SQL}) AS before FROM f)
  SELECT symbol, {r('sum(ln(1 + coalesce(now * ret, 0)))', 'cheating')}, {r('sum(ln(1 + coalesce(before * ret, 0)))', 'honest')} FROM g GROUP BY symbol""")
def lookahead_gap(spark, sf_dir):
    df = daily(spark, sf_dir).withColumn("ret", W.change("close")).withColumn("now", W.true(F.col("ret") > 0).cast("int"))
    df = df.withColumn("before", F.lag("now").over(W.ordered()))
    total = lambda x: F.sum(F.ln(1 + F.coalesce(F.col(x) * F.col("ret"), F.lit(0.0))))
    return df.groupBy("symbol").agg(total("now").alias("cheating"), total("before").alias("honest"))


@query(f"""WITH {BARS}{CROSS}{ledger_sql('sig')}, m AS (SELECT symbol, CAST(year(timestamp) AS INTEGER) AS year, month(timestamp) AS mo, product(1 + coalesce(strat, 0)) - 1 AS x FROM led GROUP BY ALL)
  SELECT symbol, year, {", ".join(r(f"max(x) FILTER (WHERE mo = {m})", f'"{m}"') for m in range(1, 13))} FROM m GROUP BY symbol, year""")
def monthly_returns(spark, sf_dir):
    return monthly_table(B.run_strategy(daily(spark, sf_dir), GOLDEN).ledger)


# Recursions

XS = ", s AS (SELECT symbol, timestamp, high, low, close, row_number() OVER w AS i, list(close) OVER w AS xs FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp))"


def fold_sql(lists: str, alpha: str) -> str:
    return f"list_reduce({lists}, lambda a, b: (1 - {alpha}) * a + {alpha} * b)"


def recursive_sql(rows: str, first: str, step: str, columns: str, keys: str = "symbol") -> str:
    """A recursion along i: ``rows`` has i from 1 and n; ``first`` and ``step`` give ``columns`` at i = 1 and from p (before) and c (now)."""
    return f"rec AS (SELECT {keys}, i, {first} FROM {rows} c WHERE i = 1 UNION ALL SELECT c.{keys}, c.i, {step} FROM rec p JOIN {rows} c ON c.{keys} = p.{keys} AND c.i = p.i + 1)"


NUMBERED = f"""num AS (SELECT *, row_number() OVER ({W_SQL}) AS i, {TR} AS tr, {lagged('close')} AS bc, close - {lagged('close')} AS step FROM bars)"""


def rec_panel(first: str, step: str, shown: str, more: str = "") -> str:
    return f"WITH RECURSIVE {BARS}, {NUMBERED}{more}, {recursive_sql('num', first, step, '')} SELECT n.symbol, n.timestamp, {shown} FROM num n JOIN rec ON n.symbol = rec.symbol AND n.i = rec.i"


def ema_step(name: str, x: str, alpha: str) -> str:
    return f"p.{name} + {alpha} * ({x} - p.{name}) AS {name}"


enter("ewma", indicator(("ewma", {"span": 20})), rec_panel("close AS y", ema_step("y", "c.close", "2 / 21.0::DOUBLE"), r("y", "ewma_20")))
enter("atr_ewma", indicator(("atr", {"window": 14})), rec_panel("tr AS y", ema_step("y", "c.tr", "1 / 14.0::DOUBLE"), r("y", "atr_14")))


def wilder_first(name: str) -> str:
    return f"0.0::DOUBLE AS s_{name}"


def wilder_sql(name: str, x: str, n: int, start: int = 1) -> str:
    """The running state of Wilder's average of x over rows from ``start`` (1-based): a sum until n are there, then the average."""
    last = start + n - 1
    return f"CASE WHEN c.i < {start} THEN 0.0::DOUBLE WHEN c.i < {last} THEN p.s_{name} + {x} WHEN c.i = {last} THEN (p.s_{name} + {x}) / {n} ELSE p.s_{name} + ({x} - p.s_{name}) / {n} END AS s_{name}"


SIZE = ", size AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol)"
enter(
    "rsi", indicator(("rsi", {"window": 14})),
    rec_panel(
        f"{wilder_first('u')}, {wilder_first('d')}", f"{wilder_sql('u', 'greatest(c.step, 0)', 14, 2)}, {wilder_sql('d', 'greatest(-c.step, 0)', 14, 2)}",
        r("CASE WHEN n.i > 14 THEN CASE WHEN s_d = 0 THEN 100 ELSE 100 - 100 / (1 + s_u / s_d) END END", "rsi_14"),
    ),
)
enter("atr_wilder", indicator(("wilder_atr", {"window": 14})), rec_panel("tr AS s_t", wilder_sql("t", "c.tr", 14), r("CASE WHEN n.i >= 14 THEN s_t END", "wilder_atr_14")))
enter(
    "macd", indicator(("macd", {})),
    rec_panel(
        "close AS f, close AS s, 0.0::DOUBLE AS g",
        "p.f + 2 / 13.0::DOUBLE * (c.close - p.f), p.s + 2 / 27.0::DOUBLE * (c.close - p.s), p.g + 0.2::DOUBLE * (p.f + 2 / 13.0::DOUBLE * (c.close - p.f) - (p.s + 2 / 27.0::DOUBLE * (c.close - p.s)) - p.g)",
        f'{r("f - s", chr(34) + "MACD_macd" + chr(34))}, {r("g", chr(34) + "MACD_macdsignal" + chr(34))}, {r("f - s - g", chr(34) + "MACD_macdhist" + chr(34))}',
    ),
)
enter(
    "chandelier", indicator(("chandelier", {"period": 22})),
    f"WITH RECURSIVE {BARS}, {NUMBERED}, {recursive_sql('num', 'tr AS s_t', wilder_sql('t', 'c.tr', 22), '')}, a AS (SELECT n.*, s_t AS atr FROM num n JOIN rec ON n.symbol = rec.symbol AND n.i = rec.i), "
    f"h AS (SELECT *, max(high) FILTER (WHERE i > 22) OVER {RUN} - 3 * atr AS raw FROM a) SELECT symbol, timestamp, {r(f'CASE WHEN i > 22 THEN max(raw) FILTER (WHERE i > 22) OVER {RUN} END', 'chandelier_22')} FROM h",
)
_TOP, _FLOOR = "(c.high + c.low) / 2 + 3 * c.atr", "(c.high + c.low) / 2 - 3 * c.atr"
_NEW_TOP = f"CASE WHEN c.i <= 11 THEN {_TOP} WHEN c.bc > p.top THEN {_TOP} ELSE least(p.top, {_TOP}) END"
_NEW_FLOOR = f"CASE WHEN c.i <= 11 THEN {_FLOOR} WHEN c.bc < p.floor THEN {_FLOOR} ELSE greatest(p.floor, {_FLOOR}) END"
enter(
    "supertrend", indicator(("supertrend", {})),
    f"""WITH RECURSIVE {BARS}, {NUMBERED}, {recursive_sql('num', 'tr AS s_t', wilder_sql('t', 'c.tr', 10), '')}, a AS (SELECT n.*, s_t AS atr FROM num n JOIN rec ON n.symbol = rec.symbol AND n.i = rec.i),
  st AS (SELECT symbol, i, {_TOP} AS top, {_FLOOR} AS floor, 1.0::DOUBLE AS dir FROM a c WHERE i = 1 UNION ALL
    SELECT c.symbol, c.i, {_NEW_TOP}, {_NEW_FLOOR}, CASE WHEN c.i <= 11 THEN 1.0::DOUBLE WHEN c.close > {_NEW_TOP} THEN 1.0::DOUBLE WHEN c.close < {_NEW_FLOOR} THEN -1.0::DOUBLE ELSE p.dir END
    FROM st p JOIN a c ON c.symbol = p.symbol AND c.i = p.i + 1)
  SELECT n.symbol, n.timestamp, {r("CASE WHEN n.i > 10 THEN CASE WHEN dir > 0 THEN floor ELSE top END END", "supertrend")}, {r("dir", "supertrend_dir")} FROM a n JOIN st ON n.symbol = st.symbol AND n.i = st.i""",
)
_PLUS = "CASE WHEN c.up > c.down AND c.up > 0 THEN c.up ELSE 0 END"
_MINUS = "CASE WHEN c.down > c.up AND c.down > 0 THEN c.down ELSE 0 END"
enter(
    "adx", indicator(("adx", {"timeperiod": 14})),
    f"""WITH RECURSIVE {BARS}, {NUMBERED}, m AS (SELECT *, high - {lagged('high')} AS up, {lagged('low')} - low AS down FROM num),
  {recursive_sql('m', f"{wilder_first('t')}, {wilder_first('a')}, {wilder_first('b')}", f"{wilder_sql('t', 'c.tr', 14, 2)}, {wilder_sql('a', _PLUS, 14, 2)}, {wilder_sql('b', _MINUS, 14, 2)}", '')},
  d AS (SELECT m.symbol, m.timestamp, m.i, CASE WHEN m.i <= 14 THEN 0.0::DOUBLE WHEN s_t = 0 THEN 0.0::DOUBLE WHEN s_a + s_b = 0 THEN 0.0::DOUBLE ELSE 100 * abs(s_a / s_t - s_b / s_t) / (s_a / s_t + s_b / s_t) END AS dx FROM m JOIN rec ON m.symbol = rec.symbol AND m.i = rec.i),
  x AS (SELECT symbol, i, 0.0::DOUBLE AS s_x FROM d c WHERE i = 1 UNION ALL SELECT c.symbol, c.i, {wilder_sql('x', 'c.dx', 14, 15)} FROM x p JOIN d c ON c.symbol = p.symbol AND c.i = p.i + 1)
  SELECT d.symbol, d.timestamp, {r('CASE WHEN d.i >= 28 THEN s_x END', '"ADX_14"')} FROM d JOIN x ON d.symbol = x.symbol AND d.i = x.i""",
)
_NEXT = "p.stop + p.pace * (p.peak - p.stop)"
enter(
    "parabolic_sar", indicator(("sar", {})),
    f"""WITH RECURSIVE {BARS}, num AS (SELECT *, row_number() OVER ({W_SQL}) AS i, {lagged('low')} AS l1, coalesce({lagged('low', 2)}, {lagged('low')}) AS l2, {lagged('high')} AS h1, coalesce({lagged('high', 2)}, {lagged('high')}) AS h2 FROM bars),
  rec AS (SELECT symbol, i, low AS stop, high AS peak, 0.02::DOUBLE AS pace, true AS up FROM num WHERE i = 1 UNION ALL
    SELECT symbol, i, CASE WHEN turned THEN peak0 ELSE stop0 END, CASE WHEN turned THEN CASE WHEN up0 THEN low ELSE high END WHEN up0 THEN greatest(peak0, high) ELSE least(peak0, low) END,
      CASE WHEN turned THEN 0.02::DOUBLE WHEN CASE WHEN up0 THEN high > peak0 ELSE low < peak0 END THEN least(0.2::DOUBLE, pace0 + 0.02::DOUBLE) ELSE pace0 END, up0 <> turned
    FROM (SELECT *, CASE WHEN up0 THEN low < stop0 ELSE high > stop0 END AS turned FROM (SELECT c.symbol, c.i, c.high, c.low, p.peak AS peak0, p.pace AS pace0, p.up AS up0,
      CASE WHEN p.up THEN least({_NEXT}, c.l1, c.l2) ELSE greatest({_NEXT}, c.h1, c.h2) END AS stop0 FROM rec p JOIN num c ON c.symbol = p.symbol AND c.i = p.i + 1)))
  SELECT n.symbol, n.timestamp, {r('stop', '"SAR"')} FROM num n JOIN rec ON n.symbol = rec.symbol AND n.i = rec.i""",
)
enter("adosc", indicator(("adosc", {})), rec_panel(
    "ad AS f, ad AS s", "p.f + 0.5::DOUBLE * (c.ad - p.f), p.s + 2 / 11.0::DOUBLE * (c.ad - p.s)", r("f - s", '"ADOSC"'), "").replace(
    NUMBERED, f"num AS (SELECT *, row_number() OVER ({W_SQL}) AS i, sum(coalesce((2 * close - low - high) / nullif(high - low, 0), 0) * volume) OVER {RUN} AS ad FROM bars)"))
enter("natr", indicator(("natr", {"timeperiod": 14})), rec_panel("tr AS s_t", wilder_sql("t", "c.tr", 14), r("CASE WHEN n.i >= 14 THEN 100 * s_t / n.close END", '"NATR_14"')))

# Combo strategy, sweeps

RSI_CTE = recursive_sql("num", f"{wilder_first('u')}, {wilder_first('d')}", f"{wilder_sql('u', 'greatest(c.step, 0)', 14, 2)}, {wilder_sql('d', 'greatest(-c.step, 0)', 14, 2)}", "")
WITH_RSI = f"""{NUMBERED}, {RSI_CTE}, feats AS (SELECT n.*, CASE WHEN n.i > 14 THEN CASE WHEN s_d = 0 THEN 100 ELSE 100 - 100 / (1 + s_u / s_d) END END AS rsi_14 FROM num n JOIN rec ON n.symbol = rec.symbol AND n.i = rec.i)"""
COMBO = f"""WITH RECURSIVE {BARS}, {WITH_RSI}, cf AS (SELECT *, {full('avg', 'close', 20)} AS fast, {full('avg', 'close', 100)} AS slow, {Z} AS z FROM feats)"""


@query(f"{COMBO} SELECT symbol, timestamp, {r('coalesce(fast - slow > 1e-9 AND rsi_14 > 40 AND rsi_14 < 75 AND z <= 0.5, false)::INT::DOUBLE', 'signal')} FROM cf")
def combo_signal(spark, sf_dir):
    return sweeps.run_combo(daily(spark, sf_dir))[0].select("symbol", "timestamp", "signal")


_FASTS, _SLOWS = (10, 20, 30, 40, 50), (80, 100, 120, 140, 160, 180, 200)
_LONG = " UNION ALL ".join(f"SELECT symbol, timestamp, close, {n} AS n, {full('avg', 'close', n)} AS sma FROM bars" for n in (*_FASTS, *_SLOWS))
THREE = ("total_return", "sharpe", "max_drawdown")
SWEEP = f"""WITH {BARS}, long AS ({_LONG}), grid AS (SELECT a.symbol, a.timestamp, a.close, a.n AS fast, b.n AS slow, coalesce(a.sma - b.sma > 1e-9, false)::INT::DOUBLE AS signal
  FROM long a JOIN long b ON a.symbol = b.symbol AND a.timestamp = b.timestamp AND a.n <= 50 AND b.n >= 80){ledger_sql('grid', keys='symbol, fast, slow')}"""


@query(f"{SWEEP} {stats_sql('led', 'symbol, fast, slow', metrics=THREE)}")
def sweep_sma(spark, sf_dir):
    return sweeps.sweep_sma(daily(spark, sf_dir), _FASTS, _SLOWS)


@query(f"""{COMBO}, grid AS (SELECT symbol, timestamp, close, rsi_floor, z_entry, coalesce(fast - slow > 1e-9 AND rsi_14 > rsi_floor AND rsi_14 < 75 AND z <= z_entry, false)::INT::DOUBLE AS signal FROM cf,
  (VALUES (35.0::DOUBLE), (40.0::DOUBLE), (45.0::DOUBLE), (50.0::DOUBLE)) AS a(rsi_floor), (VALUES (-0.5::DOUBLE), (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) AS b(z_entry))
  {ledger_sql('grid', keys='symbol, rsi_floor, z_entry')} {stats_sql('led', 'symbol, rsi_floor, z_entry', metrics=THREE)}""")
def sweep_combo(spark, sf_dir):
    return sweeps.sweep_combo(daily(spark, sf_dir))


@query(f"""{SWEEP}, trials AS (SELECT symbol, fast, slow, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown FROM ({stats_sql('led', 'symbol, fast, slow', metrics=THREE, raw=True)}))
  SELECT symbol, fast, slow, sharpe + 0.0::DOUBLE AS sharpe, max_drawdown + 0.0::DOUBLE AS max_drawdown FROM trials t WHERE NOT EXISTS (SELECT 1 FROM trials o WHERE o.symbol = t.symbol AND o.sharpe >= t.sharpe
  AND abs(o.max_drawdown) <= abs(t.max_drawdown) AND (o.sharpe > t.sharpe OR abs(o.max_drawdown) < abs(t.max_drawdown)))""")
def pareto_front(spark, sf_dir):
    trials = sweeps.sweep_sma(daily(spark, sf_dir), _FASTS, _SLOWS).select("symbol", "fast", "slow", F.round("sharpe", 6).alias("sharpe"), F.round("max_drawdown", 6).alias("max_drawdown"))
    return sweeps.pareto_front(trials, ["symbol"])


_WF = (10, 20, 30, 50)
_WFRAME = "PARTITION BY symbol, fold, test ORDER BY timestamp ROWS BETWEEN {0} PRECEDING AND CURRENT ROW"
_WAVG = lambda n: f"CASE WHEN count(close) OVER ({_WFRAME.format(n - 1)}) >= {n} THEN avg(close) OVER ({_WFRAME.format(n - 1)}) END"
WALK = f"""WITH {BARS}, ys AS (SELECT DISTINCT symbol, year(timestamp) AS y FROM bars), ks AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY y) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM ys),
  folds AS (SELECT t.symbol, t.y AS fold, k.y, k.k = t.k AS test FROM ks t JOIN ks k ON k.symbol = t.symbol AND t.k > 3 AND t.k < t.n AND k.k BETWEEN t.k - 3 AND t.k),
  wb AS (SELECT b.symbol, b.timestamp, b.close, fold, test FROM bars b JOIN folds f ON f.symbol = b.symbol AND f.y = year(b.timestamp)),
  ws AS (SELECT *, {", ".join(f"{_WAVG(n)} AS s{n}" for n in (*_WF, 100))} FROM wb),
  grid AS ({" UNION ALL ".join(f"SELECT symbol, fold, test, timestamp, close, {n} AS fast, coalesce(s{n} - s100 > 1e-9, false)::INT::DOUBLE AS signal FROM ws" for n in _WF)})
  {ledger_sql('grid', keys='symbol, fold, test, fast')}, tr AS (SELECT * FROM led WHERE NOT test), sc AS ({stats_sql('tr', 'symbol, fold, fast', metrics=('sharpe',), raw=True)}),
  best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY symbol, fold ORDER BY round(sharpe, 9) DESC, fast) = 1)"""


@query(f"{WALK} SELECT symbol, CAST(fold AS INTEGER) AS fold, fast, {r('sharpe', 'sharpe')} FROM best")
def walk_forward(spark, sf_dir):
    return sweeps.walk_forward(daily(spark, sf_dir), _WF)[0]


@query(f"{WALK}, oos AS (SELECT led.* FROM led JOIN best USING (symbol, fold, fast) WHERE test) {stats_sql('oos', metrics=('sharpe', 'max_drawdown', 'n_periods'))}")
def walk_forward_oos(spark, sf_dir):
    return compute_stats(sweeps.walk_forward(daily(spark, sf_dir), _WF)[1]).select("symbol", "sharpe", "max_drawdown", "n_periods")


@query()
def parameter_search(spark, sf_dir):
    return sweeps.search(daily(spark, sf_dir), trials=50, seed=7)


@query()
def parameter_search_two_aims(spark, sf_dir):
    tried = sweeps.search(daily(spark, sf_dir), trials=80, seed=7, aims=2)
    return sweeps.pareto_front(tried, ["symbol"])


# Scanners

LOOSE = 1_000.0
_SNAP_COLUMNS = f"""{", ".join(f"{full('avg', 'close', n)} AS sma{n}" for n in (20, 50, 200))}, {Z} AS z20, close / nullif({lagged('close', 20)}, 0) - 1 AS mom20, close / nullif({lagged('close', 60)}, 0) - 1 AS mom60,
  {full('avg', 'close * volume', 20)} AS dollar_vol, open / nullif({lagged('close')}, 0) - 1 AS gap, close / nullif({full('max', 'close', 252, 20)}, 0) - 1 AS pct_from_high"""
_ATR = recursive_sql("feats", "tr AS y", ema_step("y", "c.tr", "1 / 14.0::DOUBLE"), "").replace("rec", "rec2")
SNAP = f"""WITH RECURSIVE {BARS}, {WITH_RSI}, {_ATR}, b AS (SELECT timestamp, close AS bench0 FROM bars WHERE symbol = '{BENCHMARK}'),
  j AS (SELECT f.*, y AS atr_14, bench0 FROM feats f JOIN rec2 ON f.symbol = rec2.symbol AND f.i = rec2.i LEFT JOIN b USING (timestamp)),
  l AS (SELECT *, close / nullif(last_value(bench0 IGNORE NULLS) OVER {RUN}, 0) AS rs FROM j),
  sf AS (SELECT *, rsi_14 AS rsi14, atr_14 AS atr14, {_SNAP_COLUMNS}, rs / nullif({lagged('rs', 60)}, 0) - 1 AS rs_mom60, rs / nullif({full('max', 'rs', 252, 20)}, 0) - 1 AS rs_pct_from_high FROM l),
  snap AS (SELECT * FROM sf QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1)"""
_DISPLAY_SQL = ", ".join(r(c, c) for c in scanners.DISPLAY)


def _snapshot(spark, sf_dir) -> DataFrame:
    return scanners.latest_snapshot(daily(spark, sf_dir), BENCHMARK)


@query(f"{SNAP} SELECT symbol, timestamp, {', '.join(r(c, c) for c in ('sma20', 'sma50', 'sma200', *scanners.DISPLAY))} FROM snap")
def scan_snapshot(spark, sf_dir):
    return _snapshot(spark, sf_dir).select("symbol", "timestamp", "sma20", "sma50", "sma200", *scanners.DISPLAY)


def _scan(name: str, which: scanners.Setup, where: str, **settings) -> None:
    enter(name, lambda s, d: scanners.scan_snapshot(_snapshot(s, d), which, **settings), f"{SNAP} SELECT symbol, {_DISPLAY_SQL} FROM snap WHERE {where} AND dollar_vol > {LOOSE}")


_scan("scan_swing", scanners.swing_pullback, "close > sma200 AND sma20 > sma50 AND rsi_14 BETWEEN 40 AND 55", min_dollar_vol=LOOSE)
_scan("scan_momentum", scanners.momentum_breakout, "sma20 > sma50 AND z20 > 0.5 AND mom60 > -0.05", min_dollar_vol=LOOSE, min_z=0.5, min_mom=-0.05)
_scan("scan_rs", scanners.relative_strength, "rs_pct_from_high >= -0.2 AND rs_mom60 > 0 AND sma20 > sma50", min_dollar_vol=LOOSE, near_high=0.2)
_scan("scan_gap", scanners.gap_up, "gap > 0.001 AND close > sma50", min_dollar_vol=LOOSE, min_gap=0.001)
_scan("scan_new_high", scanners.new_high_breakout, "pct_from_high >= -0.05 AND mom60 > 0.0", min_dollar_vol=LOOSE, tol=0.05, min_mom=0.0)


@query(f"{SNAP}, c AS (SELECT symbol, {' + '.join(f'({x} - avg({x}) OVER ()) / nullif(stddev_samp({x}) OVER (), 0)' for x in ('mom20', 'mom60', 'z20'))} AS score FROM snap) SELECT symbol, {r('score', 'score')} FROM c")
def composite_score(spark, sf_dir):
    return scanners.composite_score(_snapshot(spark, sf_dir))


ORB = f"""WITH {HOURS}, f AS (SELECT *, timestamp::DATE AS session FROM bars), g AS (SELECT * FROM f QUALIFY session = max(session) OVER (PARTITION BY symbol)),
  h AS (SELECT *, row_number() OVER ({W_SQL}) AS k FROM g), o AS (SELECT symbol, max(high) FILTER (WHERE k <= 6) AS h, min(low) FILTER (WHERE k <= 6) AS l, max(high) FILTER (WHERE k > 6) AS later,
  last(close ORDER BY timestamp) AS last, sum(close * volume) AS session_dollar_vol, count(*) AS n FROM h GROUP BY symbol),
  orb AS (SELECT symbol, CASE WHEN n > 6 THEN h END AS or_high, CASE WHEN n > 6 THEN l END AS or_low, last, coalesce(n > 6 AND later > h, false) AS orb_up, session_dollar_vol FROM o)
  SELECT symbol, {r('or_high', 'or_high')}, {r('or_low', 'or_low')}, {r('last', 'last')}, orb_up, {r('session_dollar_vol', 'session_dollar_vol')} FROM orb"""


@query(ORB)
def orb_features(spark, sf_dir):
    return scanners.orb_features(hourly(spark, sf_dir))


@query(f"{ORB} WHERE orb_up AND session_dollar_vol > 100")
def orb_scan(spark, sf_dir):
    return scanners.orb_scan(hourly(spark, sf_dir), min_session_dollar_vol=100.0)


# Learning

_FEATURES = learning.feature_names()
FEATS = f"""WITH RECURSIVE {BARS}, {WITH_RSI}, {_ATR}, fx AS (SELECT f.symbol, f.timestamp, f.close, {", ".join(f"f.close / nullif(lag(f.close, {k}) OVER w, 0) - 1 AS ret_{k}" for k in (1, 5, 20))},
  rsi_14, {Z.replace(W_SQL, 'PARTITION BY f.symbol ORDER BY f.timestamp').replace('close', 'f.close')} AS zscore_20, y / f.close AS atr_14,
  ({full('avg', 'close', 50)}) / close - 1 AS sma_50, ({full('stddev_pop', 'close', 20)}) / close AS std_20
  FROM (SELECT f.*, y FROM feats f JOIN rec2 ON f.symbol = rec2.symbol AND f.i = rec2.i) f WINDOW w AS (PARTITION BY f.symbol ORDER BY f.timestamp))"""


_OTHERS = [c for c in _FEATURES if c != "sma_50"]


# the trend as a logarithm: prices have one decimal, so the plain ratio meets exact ties in rounding
@query(f"{FEATS} SELECT symbol, timestamp, {', '.join(r(c, c) for c in _OTHERS)}, {r('ln(1 + sma_50)', 'trend_log')} FROM fx WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _FEATURES)}")
def feature_matrix(spark, sf_dir):
    return learning.complete(learning.make_features(daily(spark, sf_dir)), _FEATURES).select("symbol", "timestamp", *_OTHERS, F.ln(1 + F.col("sma_50")).alias("trend_log"))


@query(panel_sql(f"CASE WHEN {AHEAD} IS NOT NULL THEN ({AHEAD} > 0)::INT::DOUBLE END AS label"))
def binary_label(spark, sf_dir):
    return daily(spark, sf_dir).select("symbol", "timestamp", learning.binary_label(5).alias("label"))


@query(f"WITH {BARS}, l AS (SELECT CASE WHEN {AHEAD} IS NOT NULL THEN ({AHEAD} > 0)::INT::DOUBLE END AS label FROM bars) SELECT label, count(*) AS n FROM l GROUP BY label")
def label_counts(spark, sf_dir):
    return daily(spark, sf_dir).select(learning.binary_label(5).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {BARS}, f AS (SELECT *, {RET} AS ret FROM bars), g AS (SELECT *, {full('stddev_samp', 'ret', 20)} AS vol, list(close) OVER ({W_SQL} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS path FROM f),
  h AS (SELECT *, list_position(list_transform(path, lambda x: x >= close * (1 + 2 * vol)), true) AS u, list_position(list_transform(path, lambda x: x <= close * (1 - 2 * vol)), true) AS d FROM g),
  t AS (SELECT *, vol IS NOT NULL AND len(path) = 10 AS known, coalesce(least(nullif(u, 0), nullif(d, 0)), 10) AS touch FROM h)
  SELECT symbol, timestamp, CASE WHEN known THEN CASE WHEN coalesce(u, 0) > 0 AND (coalesce(d, 0) = 0 OR u <= d) THEN 1.0::DOUBLE WHEN coalesce(d, 0) > 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END END AS label,
  {r('CASE WHEN known THEN path[touch] / nullif(close, 0) - 1 END', 'label_ret')}, CASE WHEN known THEN touch::BIGINT END AS touch_idx FROM t""")
def triple_barrier(spark, sf_dir):
    return learning.triple_barrier(daily(spark, sf_dir)).select("symbol", "timestamp", "label", "label_ret", "touch_idx")


@query(f"""WITH {BARS}, f AS (SELECT symbol, timestamp, row_number() OVER ({W_SQL}) - 1 AS row, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
  g AS (SELECT *, k::INTEGER AS fold, k * (n // 5) + least(k, n % 5) AS a, k * (n // 5) + least(k, n % 5) + n // 5 + (k < n % 5)::INT AS b, floor(n * 0.01::DOUBLE) AS gap FROM f, range(5) AS r(k))
  SELECT symbol, timestamp, row, fold, CASE WHEN row >= a AND row < b THEN 'test' WHEN row < a AND row >= a - 10 THEN 'purged' WHEN row >= b AND row < b + gap THEN 'embargoed' ELSE 'train' END AS role FROM g""")
def purged_folds(spark, sf_dir):
    return learning.purged_folds(daily(spark, sf_dir).select("symbol", "timestamp"))


@query(f"WITH {BARS} SELECT symbol, timestamp, row_number() OVER ({W_SQL}) > floor(count(*) OVER (PARTITION BY symbol) * 0.75::DOUBLE) AS is_test FROM bars")
def time_split(spark, sf_dir):
    return learning.time_split(daily(spark, sf_dir).select("symbol", "timestamp"))


def _labelled(spark, sf_dir) -> DataFrame:
    return learning.make_features(daily(spark, sf_dir)).withColumn("label", learning.binary_label(5))


@query()
def logistic_purged_cv(spark, sf_dir):
    return learning.purged_auc(_labelled(spark, sf_dir), _FEATURES, label_horizon=5)


@query()
def gbt_signal(spark, sf_dir):
    return learning.boosted(_labelled(spark, sf_dir), _FEATURES)[0].select("symbol", "timestamp", "proba", "signal")


@query()
def gbt_scores(spark, sf_dir):
    return learning.scores(learning.boosted(_labelled(spark, sf_dir), _FEATURES)[0])


@query()
def gbt_importance(spark, sf_dir):
    return learning.boosted(_labelled(spark, sf_dir), _FEATURES)[1]


@query()
def gbt_attributions(spark, sf_dir):
    """Mean size of each feature's part of the margin over the test rows, and how far the parts are from adding up."""
    rows = learning.explained(_labelled(spark, sf_dir), _FEATURES)
    off = F.max(F.abs(F.col("margin") - F.col("model_margin"))).alias("off")
    means = rows.agg(off, *(F.avg(F.abs(f"phi_{c}")).alias(c) for c in _FEATURES))
    return means.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_part")) for c in _FEATURES))).alias("x"), F.round("off", 9).alias("off")).select("x.*", "off")


# Options

RATE = 0.04
_T, _S = "greatest(years, 1e-12::DOUBLE)", "greatest(sigma, 1e-12::DOUBLE)"
D1 = f"(ln({SPOT}::DOUBLE / strike) + ({RATE}::DOUBLE + {_S} * {_S} / 2) * {_T}) / ({_S} * sqrt({_T}))"
PRICED = f""", d AS (SELECT *, {D1} AS d1, {D1} - {_S} * sqrt({_T}) AS d2 FROM chain), nd AS (SELECT *, {norm_cdf_sql('d1')} AS n1, {norm_cdf_sql('d2')} AS n2, {norm_cdf_sql('-d1')} AS m1, {norm_cdf_sql('-d2')} AS m2,
  exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS bell, exp(-{RATE}::DOUBLE * years) AS disc FROM d), pr AS (SELECT *, CASE WHEN option_type = 'call' THEN {SPOT}::DOUBLE * n1 - strike * disc * n2 ELSE strike * disc * m2 - {SPOT}::DOUBLE * m1 END AS price FROM nd)"""


def _either(call: Column, put: Column) -> Column:
    return F.when(F.col("option_type") == "call", call).otherwise(put)


def _prices(spark, sf_dir) -> DataFrame:
    price = lambda kind: options.bs_price(SPOT, "strike", "years", RATE, "sigma", kind)
    return chain_table(spark, sf_dir).withColumn("price", _either(price("call"), price("put")))


@query(f"WITH {CHAIN}{PRICED} SELECT contract, option_type, {r('price', 'price')} FROM pr")
def bs_price(spark, sf_dir):
    return _prices(spark, sf_dir).select("contract", "option_type", "price")


@query(f"""WITH {CHAIN}{PRICED} SELECT contract, {r("CASE WHEN option_type = 'call' THEN n1 ELSE -m1 END", 'delta')}, {r(f'bell / nullif({SPOT}::DOUBLE * sigma * sqrt({_T}), 0)', 'gamma')}, {r(f'{SPOT}::DOUBLE * bell * sqrt({_T})', 'vega')},
  {r(f"-{SPOT}::DOUBLE * bell * sigma / (2 * sqrt({_T})) + CASE WHEN option_type = 'call' THEN -{RATE}::DOUBLE * strike * disc * n2 ELSE {RATE}::DOUBLE * strike * disc * m2 END", 'theta')},
  {r("CASE WHEN option_type = 'call' THEN strike * years * disc * n2 ELSE -strike * years * disc * m2 END", 'rho')} FROM nd""")
def greeks(spark, sf_dir):
    call, put = (options.greeks(SPOT, "strike", "years", RATE, "sigma", kind) for kind in ("call", "put"))
    return chain_table(spark, sf_dir).select("contract", *(_either(call[g], put[g]).alias(g) for g in call))


_D1_MID = D1.replace(_S, "mid")
IV = f"""WITH RECURSIVE {CHAIN}{PRICED}, rec AS (SELECT contract, strike, years, disc, option_type, price, 0 AS step, 1e-6::DOUBLE AS lo, 5.0::DOUBLE AS hi FROM pr UNION ALL
  SELECT contract, strike, years, disc, option_type, price, step + 1, CASE WHEN val < price THEN mid ELSE lo END, CASE WHEN val < price THEN hi ELSE mid END
  FROM (SELECT *, CASE WHEN option_type = 'call' THEN {SPOT}::DOUBLE * {norm_cdf_sql('d1')} - strike * disc * {norm_cdf_sql('d2')} ELSE strike * disc * {norm_cdf_sql('-d2')} - {SPOT}::DOUBLE * {norm_cdf_sql('-d1')} END AS val
    FROM (SELECT *, {_D1_MID} AS d1, {_D1_MID} - mid * sqrt({_T}) AS d2 FROM (SELECT *, (lo + hi) / 2 AS mid FROM rec WHERE step < 23))))
  SELECT contract, {r("CASE WHEN price > CASE WHEN option_type = 'call' THEN greatest(" + str(SPOT) + "::DOUBLE - strike * disc, 0) ELSE greatest(strike * disc - " + str(SPOT) + "::DOUBLE, 0) END THEN (lo + hi) / 2 END", 'iv')} FROM rec WHERE step = 23"""


@query(IV)
def implied_vol(spark, sf_dir):
    return _prices(spark, sf_dir).select("contract", options.implied_vol("price", SPOT, "strike", "years", RATE, F.col("option_type")).alias("iv"))


@query(f"""WITH {CHAIN}{PRICED} SELECT contract, {r('strike', 'strike')}, option_type, {r('price', 'mid')}, {r('greatest(days, 1) / 365.0::DOUBLE', 'years')} FROM pr ORDER BY abs(strike - {SPOT}::DOUBLE), strike, option_type, contract LIMIT 5""")
def chain_near_money(spark, sf_dir):
    chain = _prices(spark, sf_dir).withColumns({"bid": F.col("price") - 0.5, "ask": F.col("price") + 0.5}).drop("years")
    near = options.chain_overlay(chain, SPOT, F.col("days"), RATE, top=None)
    return near.orderBy(F.abs(F.col("strike") - SPOT), "strike", "option_type", "contract").limit(5).select("contract", "strike", "option_type", "mid", "years")


# What is left of joins, unions and tallies


@query(f"SELECT symbol, count(*) FILTER (WHERE d <> before) AS flips FROM (SELECT symbol, supertrend_dir AS d, lag(supertrend_dir) OVER (PARTITION BY symbol ORDER BY timestamp) AS before FROM ({_SQL['supertrend']})) GROUP BY symbol")
def direction_flips(spark, sf_dir):
    df = combine(daily(spark, sf_dir), [("supertrend", {})])
    flip = F.col("supertrend_dir") != F.lag("supertrend_dir").over(W.ordered())
    return df.withColumn("flip", flip).groupBy("symbol").agg(F.count_if("flip").alias("flips"))


@query(panel_sql(f"{r('(high - low) / nullif(close, 0)', 'hl')}, {r(f'close / nullif({full("avg", "close", 50)}, 0) - 1', 'trend')}, {r('close * volume', 'dollar')}"))
def derived_features(spark, sf_dir):
    close = F.col("close")
    df = combine(daily(spark, sf_dir), [("sma", {"window": 50})])
    return df.select("symbol", "timestamp", F.try_divide(F.col("high") - F.col("low"), close).alias("hl"), (F.try_divide(close, F.col("sma_50")) - 1).alias("trend"), (close * F.col("volume")).alias("dollar"))


@query(f"WITH {BARS}, s AS (SELECT symbol, timestamp, 1.0::DOUBLE AS signal FROM bars WHERE volume >= 100){', j AS (SELECT b.symbol, b.timestamp, b.close, s.signal FROM bars b LEFT JOIN s USING (symbol, timestamp))'}{ledger_sql('j')} SELECT symbol, timestamp, {r('position', 'position')}, {r('strat', 'strat')} FROM led")
def signal_reindex(spark, sf_dir):
    """A sparse signal put on the bars' own index: no row means flat."""
    bars = daily(spark, sf_dir)
    sparse = bars.filter("volume >= 100").select("symbol", "timestamp", F.lit(1.0).alias("signal"))
    return B.backtest(bars.join(sparse, ["symbol", "timestamp"], "left")).select("symbol", "timestamp", "position", "strat")


@query(f"SELECT * FROM ({_SQL['sweep_sma']}) ORDER BY sharpe DESC, symbol, fast, slow LIMIT 5")
def sweep_top(spark, sf_dir):
    trials = rounded(sweeps.sweep_sma(daily(spark, sf_dir), _FASTS, _SLOWS))
    return trials.orderBy(F.desc("sharpe"), "symbol", "fast", "slow").limit(5)


@query(f"WITH {HOURS}, f AS (SELECT symbol, timestamp, close AS iv, min(close) OVER {frame(48)} AS lo, max(close) OVER {frame(48)} AS hi FROM bars) SELECT symbol, timestamp, {r('(iv - lo) / nullif(hi - lo, 0)', 'iv_rank')} FROM f")
def iv_rank(spark, sf_dir):
    return options.iv_rank(hourly(spark, sf_dir).select("symbol", "timestamp", F.col("close").alias("iv")), 48).select("symbol", "timestamp", "iv_rank")


@query(f"WITH {CHAIN} SELECT contract, {r('strike', 'strike')}, option_type, '2024-01-19' AS expiry, CASE WHEN option_type = 'put' THEN days END AS days FROM chain")
def chain_union(spark, sf_dir):
    """Calls and puts as one chain; a column that one leg lacks is null there."""
    legs = chain_table(spark, sf_dir).select("contract", "strike", "option_type", "days")
    calls, puts = (legs.filter(F.col("option_type") == kind).drop("option_type") for kind in ("call", "put"))
    return option_chain(calls.drop("days"), puts, "2024-01-19")


@query(f"WITH {CHAIN}{PRICED}, iv AS ({IV}) ".replace("WITH ", "WITH RECURSIVE ", 1) + f"SELECT contract, {r('price', 'mid')}, {r('iv.iv', 'iv')} FROM pr JOIN iv USING (contract) ORDER BY abs(strike - {SPOT}::DOUBLE), strike, option_type, contract LIMIT 20")
def chain_overlay(spark, sf_dir):
    """The twenty contracts nearest to the spot with mid price and implied volatility."""
    chain = _prices(spark, sf_dir).withColumns({"bid": F.col("price"), "ask": F.col("price")})
    near = chain.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).orderBy(F.abs(F.col("strike") - SPOT), "strike", "option_type", "contract").limit(20)
    return near.select("contract", "mid", options.implied_vol("mid", SPOT, "strike", "years", RATE, F.col("option_type")).alias("iv"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden-cross strategy of every symbol, the ten best by Sharpe ratio."""
    return rounded(B.run_strategy(daily(spark, sf_dir), GOLDEN).stats.orderBy(F.desc("sharpe"), "symbol").limit(10))
