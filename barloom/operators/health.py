"""Edge health: regime hit rate, crash avoidance, drawdown prevented, opportunity cost, composite score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions.text import div
from barloom.operators.backtest import drawdown, equity


def edge_health(
    df: DataFrame, by: list[str] = ["symbol"], crash: float = -0.01, rally: float = 0.01, capital: float = 100_000.0
) -> DataFrame:
    """One row per group from ``ret``, ``position`` and ``regime``. Percent columns are scaled by 100."""
    df = df.selectExpr(*by, "date", "ret", "position", "coalesce(regime, 'UNKNOWN') AS regime", "ret * position AS _strategy")
    df = equity(equity(df, by, "_strategy", out="_se"), by, "ret", out="_he")
    df = drawdown(drawdown(df, by, "_se", out="_sd"), by, "_he", out="_hd")
    flat_crash = f"position = 0 AND ret < {crash}"
    flat_rally = f"position = 0 AND ret > {rally}"
    agg = df.groupBy(*by).agg(
        F.expr("min(date) AS period_start"), F.expr("max(date) AS period_end"),
        F.expr("count_if(regime = 'HOSTILE') AS risk_off_predicted"),
        F.expr("count_if(ret < 0) AS risk_off_actual"),
        F.expr("count_if(regime = 'HOSTILE' AND ret < 0) AS _hits"),
        F.expr(f"count_if({flat_crash}) AS crashes_avoided"),
        F.expr(f"coalesce(sum(IF({flat_crash}, -ret, 0D)), 0D) AS _damage"),
        F.expr(f"coalesce(sum(IF(ret < {crash}, ret - _strategy, 0D)), 0D) AS _crash_delta"),
        F.expr("min(_sd) AS _sdd"), F.expr("min(_hd) AS _hdd"),
        F.expr(f"count_if({flat_rally}) AS missed_rallies"),
        F.expr(f"coalesce(sum(IF({flat_rally}, ret, 0D)), 0D) AS _missed"),
    )
    # The crash delta keeps the published sign: hold damage minus strategy damage, both negative.
    out = agg.selectExpr("*", f"coalesce({div('CAST(_hits AS DOUBLE)', 'risk_off_predicted')}, 0D) AS regime_hit_rate")
    return out.selectExpr(
        *by, "period_start", "period_end", "regime_hit_rate", "risk_off_predicted", "risk_off_actual",
        "_crash_delta * 100 AS crash_avoidance_delta", "crashes_avoided", "_damage * 100 AS crash_damage_avoided",
        "_sdd * 100 AS max_drawdown_strategy", "_hdd * 100 AS max_drawdown_buyhold",
        "(_hdd - _sdd) * 100 AS drawdown_prevented_pct", f"(_hdd - _sdd) * {capital!r}D AS drawdown_prevented_abs",
        "_missed * 100 AS opportunity_cost", "missed_rallies",
        "greatest(0D, least(100D, regime_hit_rate * 30 + least(40D, _crash_delta * 1000) + least(20D, (_hdd - _sdd) * 100) "
        "- least(10D, _missed * 50))) AS health_score",
    )
