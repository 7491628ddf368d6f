"""Rules, signals, ledgers, statistics: exact vectors and relations."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlume.operators import backtest as B
from barlume.functions import windows as W
from barlume.operators import indicators, learning, rules, stats, sweeps
from tests.conftest import made_bars, path


def signals(spark, closes, **config):
    df = B.build_signal(spark.createDataFrame(path(closes)), B.StrategyConfig(**config))
    return [r[0] for r in df.orderBy("timestamp").select("signal").collect()]


def test_state_machine_vectors(spark):
    closes = [20, 21, 25, 18, 16, 17, 30, 15]
    assert signals(spark, closes, entry="close < 17.5", exit="close > 24") == [0, 0, 0, 0, 1, 1, 0, 1]
    assert signals(spark, closes, entry="close < 17.5", exit="close > 24", direction="short") == [0, 0, 0, 0, -1, -1, 0, -1]
    assert signals(spark, [20, 15, 22, 22, 3], rule="close > 19") == [1, 0, 1, 1, 0]
    assert signals(spark, [6, 4, 9, 2], rule="close > 5") == signals(spark, [6, 4, 9, 2], rule=lambda df: df["close"] > 5)
    assert signals(spark, [1, 5, 1], entry="close > 3", exit="close > 3") == [0, 0, 0]
    with pytest.raises(ValueError, match="needs one of"):
        signals(spark, closes)


def test_rules_are_compiled_not_run(spark):
    columns = ["close", "sma_20"]
    for bad in ("__import__('os')", "close.real", "(lambda: 1)()", "[1]", "np.load(close)", "'a'", "close >"):
        with pytest.raises(ValueError, match="Bad expression"):
            rules.compile_rule(bad, columns)
    with pytest.raises(ValueError, match="Unknown name"):
        rules.compile_rule("volume > 1", columns)
    with pytest.raises(ValueError):
        rules.compile_rule("1 > 0", columns)
    df = spark.createDataFrame([(1.0, None), (3.0, 2.0)], "close double, sma_20 double")
    found = df.select(rules.condition("~(close > sma_20) | (np.maximum(close, 2) >= 3)", df).alias("x")).collect()
    assert [r["x"] for r in found] == [True, True]
    with pytest.raises(ValueError):
        rules.condition(lambda d: 1, df)
    more = df.select(rules.condition("(close % (sma_20 - 2) >= 0) | (np.clip(close, 0, 2) == 2) & np.isfinite(close) & (np.floor(close) == np.round(close)) & (np.power(close, 2) > np.log1p(close))", df).alias("x")).collect()
    assert [r["x"] for r in more] == [False, True]


def test_parse_indicators():
    specs, names, errors = rules.parse_indicators("sma:30\nzscore:15\nrsi:9")
    assert names == ["sma_30", "zscore_15", "rsi_9"] and not errors and specs[0] == ("sma", {"window": 30})
    assert rules.parse_indicators("sma\n \n\nrsi:\n")[1] == ["sma_20", "rsi_14"]
    assert len(rules.parse_indicators("nope:3\newma:12")[2]) == 1


def plain_stats(r: np.ndarray, per_year: float = 252) -> dict:
    eq = np.cumprod(1 + r)
    neg = r[r < 0]
    return {
        "total_return": eq[-1] - 1, "cagr": eq[-1] ** (per_year / len(r)) - 1, "ann_volatility": r.std(ddof=1) * per_year**0.5, "sharpe": r.mean() / r.std(ddof=1) * per_year**0.5,
        "sortino": r.mean() / neg.std(ddof=1) * per_year**0.5, "max_drawdown": (eq / np.maximum.accumulate(eq) - 1).min(), "win_rate": (r > 0).sum() / (r != 0).sum(), "n_periods": len(r),
    }


def test_ledger_and_stats_match_a_loop(spark):
    bars = made_bars(120)
    df = spark.createDataFrame(bars)
    config = B.StrategyConfig(indicators=[("sma", {"window": 5})], rule="close > sma_5", fee_bps=3.0)
    result = B.run_strategy(df, config)
    c = bars["close"].to_numpy()
    sma = bars["close"].rolling(5).mean().to_numpy()
    position, want = 0.0, []
    for t in range(len(c)):
        now = float(sma[t - 1] < c[t - 1]) if t and not np.isnan(sma[t - 1]) else 0.0
        ret = c[t] / c[t - 1] - 1 if t else np.nan
        want.append(0.0 if t == 0 else now * ret - abs(now - position) * 3e-4)
        position = now
    found = result.ledger.orderBy("timestamp").toPandas()
    np.testing.assert_allclose(found["strat"], want, atol=1e-12)
    row = result.stats.first().asDict()
    for k, v in plain_stats(np.array(want)).items():
        assert row[k] == pytest.approx(v, abs=1e-9), k
    assert row["calmar"] == pytest.approx(row["cagr"] / abs(row["max_drawdown"]))


def test_relations(spark, panel):
    always = B.backtest(panel.withColumn("signal", F.lit(1.0)), 0.0)
    last = always.groupBy("symbol").agg(F.product(1 + F.col("strat")).alias("grown"), (F.max_by("close", "timestamp") / F.min_by("close", "timestamp")).alias("held"))
    assert all(r["grown"] == pytest.approx(r["held"]) for r in last.collect())
    config = B.StrategyConfig(indicators=[("sma", {"window": 10})], rule="close > sma_10")
    totals = [{r["symbol"]: r["total_return"] for r in B.run_strategy(panel, B.StrategyConfig(**vars(config) | {"fee_bps": fee})).stats.collect()} for fee in (0.0, 20.0)]
    assert all(totals[1][s] < totals[0][s] for s in totals[0])
    day, week = (B.run_strategy(panel, config, timeframe=t).stats.orderBy("symbol").first()["sharpe"] for t in ("1d", "1wk"))
    assert day / week == pytest.approx((252 / 52) ** 0.5)
    flat = stats.compute_stats(panel.withColumn("strat", F.lit(0.0))).first()
    assert flat["sharpe"] == flat["sortino"] == flat["calmar"] == flat["win_rate"] == 0


def test_multi_isolates_bad_symbols(spark, panel):
    bad = path([3.0, 4.0, 5.0], "BAD").assign(high=0.0)
    result = B.run_strategy_multi(panel.unionByName(spark.createDataFrame(bad)), B.StrategyConfig(rule="close > 0"))
    assert [r["symbol"] for r in result.errors.collect()] == ["BAD"]
    assert result.stats.count() == 3 and result.portfolio_stats.count() == 1
    ledger = result.ledger.groupBy("timestamp").agg(F.avg("strat").alias("m")).orderBy("timestamp").toPandas()
    np.testing.assert_allclose(result.portfolio.orderBy("timestamp").toPandas()["strat"], ledger["m"], atol=1e-12)
    assert B.run_strategy_multi(spark.createDataFrame(bad), B.StrategyConfig(rule="close > 0")).portfolio is None


def test_sweeps_agree_with_single_runs(spark, panel):
    grid = sweeps.sweep_sma(panel, (5, 10), (20, 30))
    one = B.run_strategy(panel, B.StrategyConfig(indicators=[("sma", {"window": 10}), ("sma", {"window": 30})], rule="sma_10 - sma_30 > 1e-9")).stats
    found = grid.filter("fast = 10 AND slow = 30").join(one.select("symbol", F.col("sharpe").alias("want")), "symbol").collect()
    assert len(found) == 3 and all(r["sharpe"] == pytest.approx(r["want"]) for r in found)
    assert sweeps.sweep_combo(panel).count() == 48
    assert sweeps.search(panel, 3).count() == 9
    point = {"fast": 5, "slow": 60, "rsi_floor": 40.0, "z_entry": 0.5}
    _, alone, _ = sweeps.run_combo(panel, sweeps.ComboParams(fast=5, slow=60, rsi_floor=40.0))
    both = {r["symbol"]: r for r in sweeps.tried(panel, [point]).collect()}
    assert all(abs(both[r["symbol"]]["sharpe"] - r["sharpe"]) < 1e-9 for r in alone.collect())


def test_pareto_front_against_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [("a", i, float(s), -float(d)) for i, (s, d) in enumerate(rng.integers(0, 6, (40, 2)))]
    df = spark.createDataFrame(rows, "symbol string, k int, sharpe double, max_drawdown double")
    want = {k for _, k, s, d in rows if not any(s2 >= s and abs(d2) <= abs(d) and (s2 > s or abs(d2) < abs(d)) for _, _, s2, d2 in rows)}
    assert {r["k"] for r in sweeps.pareto_front(df, ["symbol"]).collect()} == want


def test_walk_forward_picks_by_training_sharpe(spark):
    df = spark.createDataFrame(made_bars(2000))
    choices, ledger = sweeps.walk_forward(df, (5, 10), 20)
    picked = choices.orderBy("fold").collect()
    years = sorted(made_bars(2000)["timestamp"].dt.year.unique())
    assert [r["fold"] for r in picked] == years[3:-1] and set(r["fast"] for r in picked) <= {5, 10}
    assert {r[0] for r in ledger.select(F.year("timestamp")).distinct().collect()} == set(years[3:-1])
    assert isinstance(ledger.toPandas(), pd.DataFrame)


def test_report(spark, panel, tmp_path):
    ledger = B.run_strategy(panel, B.StrategyConfig(rule="close > 0")).ledger
    page = stats.html_report(ledger, str(tmp_path / "r.html"))
    assert "max_drawdown" in open(page).read()
    assert B.asdict_safe(B.StrategyConfig(signal=lambda df: df["close"]))["signal"].startswith("<callable")


def test_edges_and_last_rows(spark):
    rows = [("A", k, s) for k, s in enumerate([None, 1.0, 1.0, 0.0, None, 1.0, -1.0, 1.0])] + [("B", 0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, timestamp int, signal double")
    entry, exit_ = W.edges("signal")
    found = {(r["symbol"], r["timestamp"]): (r["a"], r["b"]) for r in df.select("symbol", "timestamp", entry.alias("a"), exit_.alias("b")).collect()}
    assert {k for k, v in found.items() if v[0]} == {("A", 1), ("A", 5), ("A", 7), ("B", 0)}
    assert {k for k, v in found.items() if v[1]} == {("A", 3), ("A", 6)}
    assert sorted((r["symbol"], r["timestamp"]) for r in W.last_rows(df, 2).collect()) == [("A", 6), ("A", 7), ("B", 0)]


def test_search_over_bars(spark, panel):
    found = sweeps.search(panel, trials=6, seed=3)
    assert found.select("trial").distinct().count() == 6 and found.count() == 18
    again = sweeps.search(panel, trials=6, seed=3)
    key = lambda df: sorted((r["symbol"], r["trial"], r["fast"], r["slow"], r["rsi_floor"], r["z_entry"]) for r in df.collect())
    assert key(found) == key(again)
    assert all(5 <= r["fast"] <= 50 and 60 <= r["slow"] <= 250 and 30 <= r["rsi_floor"] <= 55 and -1 <= r["z_entry"] <= 1.5 for r in found.collect())
    front = sweeps.pareto_front(sweeps.search(panel, trials=4, seed=3, aims=2), ["symbol"]).collect()
    assert front and all(not any(o["symbol"] == f["symbol"] and o["sharpe"] > f["sharpe"] and abs(o["max_drawdown"]) < abs(f["max_drawdown"]) for o in front) for f in front)


def test_panel_folds_leave_no_training_rows_between_test_dates(spark):
    a, b = ([(s, d, 0.0) for d in range(*span)] for s, span in (("A", (0, 60)), ("B", (30, 90))))
    rows = learning.panel_folds(spark.createDataFrame(a + b, "symbol string, timestamp int, x double"), 3, 4, 0.05).collect()
    assert len(rows) == 360
    for k in range(3):
        test = {r["timestamp"] for r in rows if r["fold"] == k and r["role"] == "test"}
        train = {r["timestamp"] for r in rows if r["fold"] == k and r["role"] == "train"}
        assert test == set(range(30 * k, 30 * k + 30)) and not train & set(range(30 * k - 4, 30 * k + 34))
    split = learning.panel_split(spark.createDataFrame(a + b, "symbol string, timestamp int, x double"), 0.2).collect()
    assert all(r["is_test"] == (r["timestamp"] >= 72) for r in split)


def test_scores_against_pairs(spark):
    rows = [(0.9, 1.0), (0.9, 0.0), (0.2, 0.0), (0.6, 1.0), (0.4, 1.0), (0.2, 1.0)]
    found = learning.scores(spark.createDataFrame(rows, "proba double, label double")).first()
    pairs = [1.0 if a > b else 0.5 if a == b else 0.0 for a, y in rows for b, z in rows if y == 1 and z == 0]
    assert found["n"] == 6 and found["accuracy"] == pytest.approx(3 / 6) and found["auc"] == pytest.approx(sum(pairs) / len(pairs))
    assert learning.scores(spark.createDataFrame(rows[:1], "proba double, label double")).first()["auc"] is None


def test_functions_in_one_plan(panel):
    df = indicators.add_indicators(panel, [("RSI", {"timeperiod": 5}), ("BBANDS", {}), ("STOCH", {})])
    assert df.columns[len(panel.columns) :] == ["BBANDS_upperband", "BBANDS_middleband", "BBANDS_lowerband", "STOCH_slowk", "STOCH_slowd", "RSI_real"]
    bars = df.filter("symbol = 'AAA'").orderBy("timestamp").toPandas()
    k = 100 * (bars["close"] - bars["low"].rolling(14).min()) / (bars["high"].rolling(14).max() - bars["low"].rolling(14).min())
    np.testing.assert_allclose(bars["STOCH_slowd"].to_numpy(float), k.rolling(3).mean().rolling(3).mean().to_numpy())
    with pytest.raises(ValueError):
        indicators.add_indicators(panel, [("RSI", {"timeperiod": 5}), ("RSI", {"timeperiod": 9})])
