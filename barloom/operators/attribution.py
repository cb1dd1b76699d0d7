"""Daily decomposition of strategy PnL and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions import rolling as R
from barloom.functions.text import div


def attribution_daily(df: DataFrame, cost_bps: float = 10.0, fill: str | None = None, expected: str | None = None) -> DataFrame:
    """Beta, volatility avoidance, timing, cost drag and slippage in percent; a symbol's first day is dropped.

    Needs ``equity``, ``position``, ``ret`` (market) and ``regime``.
    """
    slip = "0D"
    if fill and expected:
        slip = f"coalesce(IF({expected} > 0, ({fill} - {expected}) / {expected} * 100, 0D), 0D)"
    df = df.selectExpr(
        "*",
        f"coalesce({R.change('equity', 1)}, 0D) * 100 AS total_pnl",
        "ret * 100 AS market_return",
        f"position <> {R.lag('position')} AS _changed",
        "coalesce(regime, 'UNKNOWN') AS regime_state",
        f"row_number() {R.over()} AS _rn",
        f"{slip} AS slippage_impact",
    ).where("_rn > 1")
    return df.selectExpr(
        "symbol", "date", "total_pnl", "market_return", "regime_state", "slippage_impact",
        "position = 1 AS was_exposed",
        "IF(position = 1, market_return, 0D) AS market_beta",
        "IF(position <> 1 AND regime_state = 'HOSTILE' AND market_return < 0, -market_return, 0D) AS vol_avoidance",
        "IF(position = 1, total_pnl - market_return, 0D) AS timing_contribution",
        f"IF(_changed, {-cost_bps / 100!r}D, 0D) AS cost_drag",
    )


def attribution_summary(daily: DataFrame, by: list[str] = ["symbol"]) -> DataFrame:
    """Totals, shares of absolute contribution, day counts, and the largest source."""
    totals = daily.groupBy(*by).agg(
        F.expr("min(date) AS period_start"), F.expr("max(date) AS period_end"), F.expr("count(*) AS total_days"),
        F.expr("sum(total_pnl) AS total_pnl"), F.expr("sum(market_beta) AS total_market_beta"),
        F.expr("sum(vol_avoidance) AS total_vol_avoidance"), F.expr("sum(timing_contribution) AS total_timing"),
        F.expr("sum(cost_drag) AS total_costs"), F.expr("sum(slippage_impact) AS total_slippage"),
        F.expr("count_if(was_exposed) AS exposed_days"), F.expr("count_if(NOT was_exposed) AS flat_days"),
        F.expr("count_if(regime_state = 'HOSTILE') AS risk_off_days"),
    )
    b, v, t = "abs(total_market_beta)", "abs(total_vol_avoidance)", "abs(total_timing)"
    base = f"({b} + {v} + {t})"

    def pct(x: str, over: str) -> str:
        return f"coalesce({div(x, over)} * 100, 0D)"

    return totals.selectExpr(
        "*",
        f"{pct(b, base)} AS pct_from_beta", f"{pct(v, base)} AS pct_from_vol_avoidance", f"{pct(t, base)} AS pct_from_timing",
        f"{pct('abs(total_costs)', 'abs(total_pnl)')} AS pct_cost_drag",
        f"CASE WHEN {b} >= {v} AND {b} >= {t} THEN 'market_beta' WHEN {v} >= {t} THEN 'vol_avoidance' ELSE 'timing' END "
        "AS primary_edge_source",
    )
