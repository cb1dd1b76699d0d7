"""Golden PnL, cost and drawdown cases, window tables, and the resampling invariants."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barloom.config import Costs
from barloom.operators import backtest as B, ensemble, nulls, paths, persistence, resample, stability, stress
from barloom.operators.regimes import vol_gate
from barloom.operators.windows import check_no_leakage, time_series_folds, windows_calendar, windows_rows
from tests.helpers import by_key, random_bars

DAYS = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(400)]


def preds(spark, signals, returns):
    rows = [("A", d, s, 0.6, 0.7, r, int(np.sign(r))) for d, s, r in zip(DAYS, signals, returns)]
    return spark.createDataFrame(rows, "symbol string, date date, signal int, prob_up double, confidence double, actual_return double, actual_direction int")


@pytest.fixture(scope="module")
def gate(spark):
    return vol_gate(spark.createDataFrame(random_bars(("A", "B", "C"), 260))).selectExpr(
        "symbol", "date", "ret", "CAST(position AS DOUBLE) AS position", "regime").cache()


def test_capital_without_costs(spark):
    df = preds(spark, [1, 1, -1, -1, 0], [0.10, -0.05, -0.10, 0.05, 0.01])
    out = B.equity(B.net_returns(df, costs=Costs(0.0, 0.0)), start=100.0)
    assert by_key(out, "date")["equity"].iloc[-1] == pytest.approx(109.2025)


def test_costs_follow_turnover(spark):
    got = by_key(B.net_returns(preds(spark, [1, -1, 0], [0.0, 0.0, 0.0])), "date")
    assert list(got["turnover"]) == [1, 2, 1]
    np.testing.assert_allclose(got["net_return"], [-0.0015, -0.003, -0.0015])


def test_equity_survives_a_total_loss_and_a_negative_factor(spark):
    got = by_key(B.equity(preds(spark, [1, 1, 1], [0.5, -2.0, 0.5]), ret="actual_return"), "date")
    np.testing.assert_allclose(got["equity"], [1.5, -1.5, -2.25])
    got = by_key(B.equity(preds(spark, [1, 1, 1], [0.5, -1.0, 0.5]), ret="actual_return"), "date")
    np.testing.assert_allclose(got["equity"], [1.5, 0.0, 0.0])


def test_profit_factor_without_losses_is_infinite(spark):
    out = B.pnl_metrics(B.net_returns(preds(spark, [1, 1], [0.1, 0.1]), costs=Costs(0.0, 0.0))).first()
    assert out.profit_factor == float("inf") and out.max_drawdown == 0.0


def test_abstention(spark):
    df = spark.createDataFrame([(0.9, 0.8), (0.1, 0.8), (0.9, 0.5), (0.5, 0.9)], "prob_up double, confidence double")
    assert [r.signal for r in B.abstain(df, 0.6).collect()] == [1, -1, 0, 0]


def test_simple_average_ensemble(spark):
    rows = [("A", DAYS[0], "x", 1, 0.9, 0.9), ("A", DAYS[0], "y", 1, 0.8, 0.7), ("A", DAYS[1], "x", 1, 0.9, 0.3), ("A", DAYS[1], "y", 1, 0.9, 0.3)]
    df = spark.createDataFrame(rows, "symbol string, date date, model string, signal int, prob_up double, confidence double")
    assert list(by_key(ensemble.score_simple_average(df), "date")["signal"]) == [1, 0]


def test_walk_forward_windows_against_a_loop(spark):
    rng = np.random.default_rng(7)
    dates = [DAYS[0] + dt.timedelta(days=int(k)) for k in sorted(rng.choice(700, 420, replace=False))]
    df = spark.createDataFrame([("A", d, 1.0) for d in dates], "symbol string, date date, close double")
    s, end, expected, k = pd.Series(pd.to_datetime(dates)), pd.Timestamp(dates[-1]), [], 0
    now = pd.Timestamp(dates[0]) + pd.Timedelta(days=252)
    while now + pd.Timedelta(days=21) <= end:
        k += 1
        train = ((s >= now - pd.Timedelta(days=252)) & (s < now)).sum()
        test = ((s >= now) & (s < now + pd.Timedelta(days=21))).sum()
        if train >= 50 and test:
            expected.append((k, train, test))
        now += pd.Timedelta(days=21)
    got = by_key(windows_calendar(df), "window_id")
    assert [tuple(r) for r in got[["window_id", "train_rows", "test_rows"]].itertuples(index=False)] == expected


def test_row_windows_do_not_leak(spark):
    df = spark.createDataFrame([("A", d, 1.0) for d in DAYS], "symbol string, date date, close double")
    for tagged, key in ((windows_rows(df, 100, 40), "window_id"), (windows_rows(df, 100, 40, "expanding"), "window_id"), (time_series_folds(df), "fold")):
        assert check_no_leakage(tagged.where("role = 'train'"), tagged.where("role = 'test'"), ["symbol", key], True).count() == 0


def test_drawdown_is_never_positive(gate):
    df = B.drawdown(B.equity(gate, ret="ret"))
    assert df.where("drawdown > 0").count() == 0


def test_transitions_sum_to_one(gate):
    sums = persistence.transitions(gate).groupBy("symbol", "from_state").sum("p").toPandas()
    np.testing.assert_allclose(sums["sum(p)"], 1.0)


def test_runs_cover_every_bar_once(gate):
    assert persistence.regime_runs(gate).groupBy().sum("duration").first()[0] == gate.count()


def test_shuffle_keeps_the_returns_of_each_regime(gate):
    arrays = resample.series_arrays(gate, ["ret", "position", "regime"])
    for row in resample.regime_shuffle(arrays, 3).collect():
        for state in set(row.regime):
            old = sorted(r for r, g in zip(row.ret, row.regime) if g == state)
            new = sorted(r for r, g in zip(row.perm_ret, row.regime) if g == state)
            assert old == new
        assert list(row.perm_ret) != list(row.ret)


def test_bootstrap_is_made_of_blocks_and_repeats_itself(gate):
    arrays = resample.series_arrays(gate, ["ret", "position", "regime"])
    rows = resample.block_bootstrap(arrays, 4, 20).collect()
    for row in rows:
        n = len(row.ret)
        assert len(row.perm_ret) == n
        for b in range(0, n - 20, 20):
            block = row.perm_ret[b:b + 20]
            start = row.ret.index(block[0])
            assert row.ret[start:start + 20] == block and start < n - 20
    again = {(r.symbol, r.path_id): r.perm_ret for r in resample.block_bootstrap(arrays, 4, 20, chunk=1).collect()}
    assert all(again[(r.symbol, r.path_id)] == r.perm_ret for r in rows)


def test_curve_stats_match_a_loop(gate):
    arrays = resample.series_arrays(gate, ["ret", "position"])
    got = {r.symbol: r for r in resample.real_metrics(arrays, -0.01).collect()}
    for row in arrays.collect():
        value, peak, dd = 1.0, float("-inf"), 0.0
        for r, p in zip(row.ret, row.position):
            value *= 1 + r * p
            peak = max(peak, value)
            dd = min(dd, value / peak - 1)
        crash = [p for r, p in zip(row.ret, row.position) if r < -0.01]
        assert got[row.symbol].real_max_dd == pytest.approx(dd)
        assert got[row.symbol].real_crash_exposure == pytest.approx(np.mean(crash) if crash else 0.0)


def test_paths_have_their_lengths_and_states(gate):
    suite = paths.hostile_suite(gate, n_paths=2)
    sizes = {(r.path_type, r.n) for r in suite.selectExpr("path_type", "size(ret) AS n").distinct().collect()}
    assert ("RegimeBootstrap", 500) in sizes and ("BackToBackCrisis", 100) in sizes and ("Whipsaw", 259) in sizes
    assert suite.where("size(ret) <> size(regime) OR size(ret) <> size(position)").count() == 0
    res = paths.survival(paths.path_results(suite)).toPandas()
    assert (res["paths_tested"] == 2 + 2 + 3 + 2 + 5).all()


def test_null_strategies(gate):
    rows = nulls.null_positions(gate)
    assert rows.where("strategy = 'Inverse'").join(rows.where("strategy = 'Real'").selectExpr("symbol", "date", "position AS p"), ["symbol", "date"]).where(
        "position + p <> 1").count() == 0
    results = nulls.null_results(gate).toPandas()
    assert sorted(results["strategy"].unique()) == ["Always-Long", "Delayed-T+2", "Delayed-T+3", "Inverse", "Random", "Real"]
    assert (results[results["strategy"] == "Always-Long"]["turnover"] == 0).all()


def test_stress_is_worse_with_more_slippage(gate):
    book = gate.selectExpr("'P' AS portfolio_id", "*")
    out = {r.scenario: r.portfolio_dd for r in stress.portfolio_stress(stress.stressed_returns(book)).collect()}
    assert len(out) == 10
    assert out["LiquidityShock10x"] <= out["LiquidityShock5x"] <= out["Normal"] <= 0


def test_first_row_counts_as_a_trade(spark):
    df = spark.createDataFrame([("A", d, 1) for d in DAYS[:40]], "symbol string, date date, position int")
    assert stability.trade_stability(df).first().trades == 1


def test_min_trades_promotes_only_what_is_missing(spark):
    signals = [1] + [0] * 20 + [0] * 10
    got = by_key(ensemble.min_trades(preds(spark, signals, [0.01] * 31), 21, 5), "date")
    assert got["promoted"].sum() == 4 and got["promoted"][21:].sum() == 0
