"""Null strategies that a real strategy has to beat."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from barloom.config import RESEARCH, TRADING_DAYS
from barloom.functions import rolling as R
from barloom.functions.text import div, keyed_uniform
from barloom.operators.backtest import drawdown, equity, total_product

N_RANDOM = 10
MEDIAN_RANK = 6  # the sixth of ten, counted from the deepest drawdown


def null_positions(df: DataFrame, delays: tuple[int, ...] = (2, 3), n_random: int = N_RANDOM, seed: int = RESEARCH.seed) -> DataFrame:
    """Rows ``(symbol, date, ret, strategy, draw, position)`` for the real and every null strategy.

    All variants come from the same row, so the input is shuffled by symbol once. A random variant flips
    with probability turnover / days and starts long; the others are a constant, a delay and the inverse.
    """
    moved = f"coalesce(position <> {R.lag('position')}, false)"
    whole = "OVER (PARTITION BY symbol)"
    df = df.selectExpr("symbol", "date", "ret", "CAST(position AS DOUBLE) AS position", f"{moved} AS _moved")
    df = df.selectExpr("*", f"count_if(_moved) {whole} / count(*) {whole} AS _rate")
    flips = [f"sum(IF({keyed_uniform(str(seed + k), 'symbol', 'date')} < _rate, 1, 0)) {R.running()} AS _f{k}" for k in range(n_random)]
    lags = [f"lag(position, {d}, 1D) {R.over()} AS _d{d}" for d in delays]
    df = df.selectExpr("*", *flips, *lags)
    variants = [("Real", 0, "position"), ("Always-Long", 0, "1D"), ("Inverse", 0, "1 - position")]
    variants += [(f"Delayed-T+{d}", 0, f"_d{d}") for d in delays]
    variants += [("Random", k, f"CAST((1 + _f{k}) % 2 AS DOUBLE)") for k in range(n_random)]
    rows = [f"struct('{name}' AS strategy, {k} AS draw, {held} AS position)" for name, k, held in variants]
    return df.selectExpr("symbol", "date", "ret", f"inline(array({', '.join(rows)}))")


def strategy_metrics(df: DataFrame, by: list[str], threshold: float = -0.02) -> DataFrame:
    """Return, drawdown, Sharpe (sample deviation), crash exposure and turnover per group, in percent.

    What is ranked and compared is rounded to nine places, so that equal curves are ties and not rounding noise.
    """
    key = ", ".join(by)
    df = df.selectExpr("*", "ret * position AS _s", f"coalesce(position <> {R.lag('position', 1, key)}, false) AS _moved")
    df = drawdown(equity(df, by, "_s", out="_e"), by, "_e", out="_d")
    return df.groupBy(*by).agg(
        ((total_product("_s") - 1) * 100).alias("total_return"), F.expr("round(min(_d) * 100, 9) AS max_drawdown"),
        F.expr(f"IF(stddev_samp(_s) > 0, {div('avg(_s)', 'stddev_samp(_s)')} * {math.sqrt(TRADING_DAYS)!r}D, 0D) AS sharpe"),
        F.expr(f"round(coalesce(avg(IF(ret < {threshold}, position, NULL)), 0D) * 100, 9) AS crash_exposure"),
        F.expr("count_if(_moved) AS turnover"),
    )


def null_results(df: DataFrame, **options) -> DataFrame:
    """Metrics of the real strategy and of each null; of the random draws the one of median drawdown stays."""
    metrics = strategy_metrics(null_positions(df, **options), ["symbol", "strategy", "draw"])
    rank = "row_number() OVER (PARTITION BY symbol, strategy ORDER BY max_drawdown, draw)"
    ranked = metrics.selectExpr("*", f"{rank} AS _rank")
    return ranked.where(f"strategy <> 'Random' OR _rank = {MEDIAN_RANK}").drop("_rank", "draw")


def compare_nulls(results: DataFrame) -> DataFrame:
    """The real strategy against each null, as differences and wins."""
    real = results.where("strategy = 'Real'").selectExpr(
        "symbol", "max_drawdown AS _dd", "crash_exposure AS _crash", "total_return AS _ret"
    )
    return results.where("strategy <> 'Real'").join(real, "symbol").selectExpr(
        "symbol", "strategy", "_dd - max_drawdown AS dd_improvement", "crash_exposure - _crash AS crash_improvement",
        "_ret - total_return AS return_delta", "_dd > max_drawdown AS real_wins_dd", "_crash < crash_exposure AS real_wins_crash",
    )


def null_verdict(comparison: DataFrame, pass_at: float = 0.8) -> DataFrame:
    wins = comparison.groupBy("symbol").agg(F.expr("avg(IF(real_wins_dd, 1D, 0D)) AS dd_win_rate"))
    return wins.selectExpr("*", f"dd_win_rate >= {pass_at} AS passed")
