"""Smallest complete research question: does the volatility gate cut drawdown against buy and hold?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions import rolling as R
from barloom.operators.backtest import drawdown, equity
from barloom.operators.regimes import vol_gate


def gate_versus_hold(bars: DataFrame) -> DataFrame:
    """One row per symbol: returns, drawdowns and the last rolling Sharpe of the gated strategy."""
    df = vol_gate(bars).selectExpr("*", "ret * position AS strategy_return")
    df = equity(equity(df, ret="strategy_return", out="strategy_equity"), ret="ret", out="hold_equity")
    df = drawdown(drawdown(df, value="strategy_equity", out="strategy_dd"), value="hold_equity", out="hold_dd")
    df = df.selectExpr("*", f"{R.sharpe('strategy_return', 60)} AS sharpe_60d")
    return df.groupBy("symbol").agg(
        F.expr("max_by(strategy_equity, date) - 1 AS strategy_return"),
        F.expr("max_by(hold_equity, date) - 1 AS hold_return"),
        F.expr("min(strategy_dd) AS strategy_max_dd"),
        F.expr("min(hold_dd) AS hold_max_dd"),
        F.expr("min(strategy_dd) - min(hold_dd) AS dd_improvement"),
        F.expr("max_by(sharpe_60d, date) AS last_sharpe_60d"),
        F.expr("avg(position) AS exposure"),
    )
