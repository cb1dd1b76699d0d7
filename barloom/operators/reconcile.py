"""Reconciliation of decisions, shadow runs, broker fills and weekly results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from barloom.config import TRADING_DAYS
from barloom.functions.text import div


def last_write(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Newest row per key; an aggregate, so rewrites collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.expr(f"max_by(struct({', '.join(rest)}), {ts}) AS _row"))
    return newest.select(*keys, "_row.*")


def match_decisions(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected and actual decision of a symbol and day side by side, with slippage in basis points."""
    key = ["symbol", "date"]
    e = last_write(expected, key).selectExpr(*key, "action AS expected_action", "regime AS expected_regime", "price AS expected_price")
    a = last_write(actual, key).selectExpr(*key, "action AS actual_action", "regime AS actual_regime", "price AS actual_price")
    move = f"{div('(actual_price - expected_price)', 'expected_price')} * 10000"
    return e.join(a, key).selectExpr(
        "*", "expected_action = actual_action AS is_aligned", "expected_regime = actual_regime AS regime_aligned",
        f"IF(expected_price > 0, IF(actual_action = 'ENTER_LONG', 1, -1) * {move}, 0D) AS slippage_bps",
    )


def reconciliation_report(matched: DataFrame, by: list[str] = ["date"]) -> DataFrame:
    return matched.groupBy(*by).agg(
        F.expr("count(*) AS total_decisions"), F.expr("count_if(is_aligned) AS aligned_decisions"),
        F.expr("count_if(NOT regime_aligned) AS regime_misclassifications"), F.expr("avg(slippage_bps) AS avg_slippage_bps"),
        F.expr("max(slippage_bps) AS max_slippage_bps"),
        F.expr("count_if(expected_action = 'EXIT_TO_CASH' AND actual_action <> 'EXIT_TO_CASH') AS missed_exits"),
        F.expr("count_if(expected_action = 'ENTER_LONG' AND actual_action <> 'ENTER_LONG') AS missed_entries"),
    )


def discrepancies(matched: DataFrame, limit_bps: float = 20.0) -> DataFrame:
    """Decisions that differ in action, regime or price, with the issue spelled out."""
    bad = matched.where(f"NOT is_aligned OR NOT regime_aligned OR abs(slippage_bps) > {limit_bps}")
    return bad.selectExpr(
        "symbol", "date", "expected_action AS expected", "actual_action AS actual", "slippage_bps",
        "concat_ws('; ', "
        "IF(NOT is_aligned, concat('Action mismatch: ', expected_action, ' → ', actual_action), NULL), "
        "IF(NOT regime_aligned, concat('Regime mismatch: ', expected_regime, ' → ', actual_regime), NULL), "
        f"IF(abs(slippage_bps) > {limit_bps}, concat('High slippage: ', format_string('%.1f', slippage_bps), ' bps'), NULL)) AS issue",
    )


def shadow_parity(live: DataFrame, shadow: DataFrame, by: list[str] = ["symbol"]) -> DataFrame:
    """Share of live actions equal to the shadow run's, and the divergences; 1 where nothing can be compared."""
    key = ["symbol", "date"]
    both = last_write(live, key).selectExpr(*key, "action AS live_action").join(
        last_write(shadow, key).selectExpr(*key, "action AS shadow_action"), key
    )
    known = live.select(*by).union(shadow.select(*by)).distinct()
    counts = both.groupBy(*by).agg(
        F.expr("count(*) AS compared"), F.expr("count_if(live_action = shadow_action) AS aligned")
    )
    return known.join(counts, by, "left").selectExpr(
        *by, "coalesce(compared, 0) AS compared", "coalesce(compared - aligned, 0) AS divergences",
        "coalesce(try_divide(CAST(aligned AS DOUBLE), compared), 1D) AS alignment_rate",
    )


def reconcile_fills(orders: DataFrame, fills: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row per discrepancy between the order book and the broker's fills."""
    booked = orders.selectExpr("client_order_id", "filled_qty AS _qty", "avg_price AS _price", "true AS _known")
    joined = fills.join(booked, "client_order_id", "left")
    issue = "struct('{0}' AS issue, {1} AS expected, {2} AS actual)"
    none = "CAST(NULL AS DOUBLE)"
    return joined.selectExpr(
        "client_order_id",
        "inline(array_compact(array("
        f"IF(_known IS NULL, {issue.format('unknown_fill', none, none)}, NULL), "
        f"IF(abs(filled_qty - _qty) > {tolerance}, {issue.format('quantity_mismatch', '_qty', 'filled_qty')}, NULL), "
        f"IF(abs(avg_price - _price) > {tolerance}, {issue.format('price_mismatch', '_price', 'avg_price')}, NULL))))",
    )


def weekly_reconciliation(
    pnl: DataFrame, trades: DataFrame, fills: DataFrame, return_per_year: float = 15.0, sharpe: float = 1.0,
    max_drawdown: float = 20.0, trades_per_week: float = 2.0,
) -> DataFrame:
    """Actual return, Sharpe, drawdown and turnover per symbol and week against the budget.

    ``pnl`` has ``daily_return`` and ``equity`` per day, ``trades`` an ``order_status``, ``fills`` a
    ``slippage_bps``. Within a week the peak runs over at most seven rows.
    """
    week = "CAST(date_trunc('week', {}) AS DATE) AS week"
    daily = pnl.selectExpr("*", week.format("date"))
    peak = "max(equity) OVER (PARTITION BY symbol, week ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    daily = daily.selectExpr("*", f"({peak} - equity) / {peak} * 100 AS _dd")
    actual = daily.groupBy("symbol", "week").agg(
        F.expr("(max_by(equity, date) / min_by(equity, date) - 1) * 100 AS actual_return"),
        F.expr(
            f"IF(count(*) > 1, coalesce({div('avg(daily_return)', 'stddev_pop(daily_return)')} * {math.sqrt(TRADING_DAYS)!r}D, 0D), 0D) "
            "AS actual_sharpe"
        ),
        F.expr("max(_dd) AS actual_drawdown"),
    )
    traded = trades.selectExpr("symbol", week.format("timestamp"), "order_status").groupBy("symbol", "week").agg(
        F.expr("count_if(order_status <> 'NO_ACTION') AS actual_turnover")
    )
    slips = fills.selectExpr("symbol", week.format("fill_ts"), "slippage_bps").groupBy("symbol", "week").agg(
        F.expr("avg(slippage_bps) AS actual_slippage_mean")
    )
    df = actual.join(traded, ["symbol", "week"], "left").join(slips, ["symbol", "week"], "left").selectExpr(
        "symbol", "week", "actual_return", "actual_sharpe", "actual_drawdown", "coalesce(actual_turnover, 0) AS actual_turnover",
        "coalesce(actual_slippage_mean, 0D) AS actual_slippage_mean",
        f"actual_return - {return_per_year * 7 / 365!r}D AS return_divergence", f"actual_sharpe - {sharpe!r}D AS sharpe_divergence",
        f"actual_drawdown - {max_drawdown!r}D AS drawdown_divergence",
        f"coalesce(actual_turnover, 0) - {trades_per_week!r}D AS turnover_divergence",
    )
    return df.selectExpr(
        "*",
        "CASE WHEN drawdown_divergence > 10 THEN 'FAIL' WHEN abs(return_divergence) > 10 OR sharpe_divergence < -0.5D "
        "OR abs(turnover_divergence) > 5 THEN 'WARN' ELSE 'PASS' END AS status",
    )
