"""Rolling stability of a strategy and its report as of the last day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions import rolling as R
from barloom.operators.backtest import drawdown, equity


def rolling_sharpe(df: DataFrame, windows: tuple[int, ...] = (30, 60, 90), ret: str = "ret") -> DataFrame:
    return df.selectExpr("*", *[f"{R.sharpe(ret, n)} AS sharpe_{n}d" for n in windows])


def recent(df: DataFrame, n: int, by: str = "symbol") -> DataFrame:
    """Last ``n`` rows per group with ``_back`` = 1 for the newest and ``_total`` = rows in the group."""
    df = df.selectExpr(
        "*", f"row_number() OVER (PARTITION BY {by} ORDER BY date DESC) AS _back", f"count(*) OVER (PARTITION BY {by}) AS _total"
    )
    return df.where(f"_back <= {n}")


def drawdown_slope(df: DataFrame, n: int = 30) -> DataFrame:
    """Least-squares slope of the last ``n`` drawdowns per bar; 0 with fewer rows."""
    return recent(df, n).groupBy("symbol").agg(
        F.expr(f"IF(max(_total) < {n}, 0D, regr_slope(drawdown, CAST(-_back AS DOUBLE))) AS drawdown_slope")
    )


def exposure_utilization(df: DataFrame, n: int = 30) -> DataFrame:
    return recent(df, n).groupBy("symbol").agg(F.expr("avg(position) AS exposure_utilization"))


def trade_stability(df: DataFrame, n: int = 30, per_week: float = 2.0) -> DataFrame:
    """Position changes in the last ``n`` rows (the first row counts) against the expected number."""
    expected = per_week * n / 5.0
    moved = recent(df, n).selectExpr("symbol", f"coalesce(position <> {R.lag('position')}, true) AS _moved")
    counts = moved.groupBy("symbol").agg(F.expr("count_if(_moved) AS trades"))
    return counts.selectExpr("*", f"greatest(0D, 1 - abs(trades - {expected!r}D) / {expected!r}D) AS trade_frequency_stability")


def stability_report(df: DataFrame, n: int = 30, per_week: float = 2.0) -> DataFrame:
    """Snapshot, trend classes, warnings and score per symbol; needs strategy ``ret`` and ``position``."""
    df = drawdown(equity(rolling_sharpe(df), ret="ret"))
    expected = per_week * n / 5.0
    last = recent(df, n).selectExpr("*", f"coalesce(position <> {R.lag('position')}, true) AS _moved")
    snap = last.groupBy("symbol").agg(
        F.expr("max(date) AS as_of"),
        *[F.expr(f"max_by(sharpe_{k}d, date) AS sharpe_{k}d") for k in (30, 60, 90)],
        F.expr("max_by(drawdown, date) * 100 AS current_drawdown"),
        F.expr(f"IF(max(_total) < {n}, 0D, regr_slope(drawdown, CAST(-_back AS DOUBLE))) * 100 AS drawdown_slope_30d"),
        F.expr("avg(position) * 100 AS exposure_utilization"),
        F.expr("count_if(_moved) AS trades_30d"),
    )
    snap = snap.selectExpr(
        "*", f"greatest(0D, 1 - abs(trades_30d - {expected!r}D) / {expected!r}D) AS trade_frequency_stability"
    )
    return snap.selectExpr(
        "*",
        "CASE WHEN sharpe_30d < sharpe_90d - 0.3D THEN 'degrading' WHEN sharpe_30d > sharpe_90d + 0.3D THEN 'improving' "
        "ELSE 'stable' END AS sharpe_trend",
        "CASE WHEN drawdown_slope_30d < -0.1D THEN 'degrading' WHEN drawdown_slope_30d > 0.05D THEN 'recovering' "
        "ELSE 'stable' END AS drawdown_trend",
        "CASE WHEN exposure_utilization < 50 THEN 'underutilized' WHEN exposure_utilization > 90 THEN 'overutilized' "
        "ELSE 'balanced' END AS exposure_trend",
        "array_compact(array("
        "IF(sharpe_30d < sharpe_90d - 0.3D, 'Sharpe ratio declining (30d < 90d by >0.3)', NULL), "
        "IF(drawdown_slope_30d < -0.1D, format_string('Drawdown worsening (slope: %.2f%%/day)', drawdown_slope_30d), NULL), "
        "IF(exposure_utilization < 50, 'Exposure below 50% - strategy mostly flat', NULL), "
        "IF(exposure_utilization > 90, 'Exposure above 90% - little crash protection', NULL), "
        "IF(trade_frequency_stability < 0.5D, 'Trade frequency unstable vs expected', NULL))) AS warnings",
        "least(40D, greatest(0D, sharpe_30d * 20)) + greatest(0D, 30 + current_drawdown) "
        "+ 30 - abs(exposure_utilization - 70) * 0.3D AS stability_score",
    )
