"""Portfolio stress scenarios and the overall verdict of the falsification suite."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.config import RESEARCH
from barloom.functions import rolling as R
from barloom.functions.text import grid, keyed_normal
from barloom.operators.backtest import drawdown, equity

# Scenario name, correlation, slippage multiple, execution delay in days.
SCENARIOS = [
    ("Normal", 0.3, 1.0, 0),
    ("HighCorr", 0.95, 1.0, 0),
    ("PerfectCorr", 1.0, 1.0, 0),
    ("LiquidityShock5x", 0.3, 5.0, 0),
    ("LiquidityShock10x", 0.3, 10.0, 0),
    ("ExecDelay1d", 0.3, 1.0, 1),
    ("ExecDelay2d", 0.3, 1.0, 2),
    ("CorrPlusLiq", 0.95, 5.0, 0),
    ("FullStress", 0.95, 10.0, 1),
    ("BlackSwan", 1.0, 20.0, 2),
]
FIELDS = ["scenario", "correlation", "slippage_mult", "delay"]


def common_dates(df: DataFrame) -> DataFrame:
    """Rows on dates for which every member of the portfolio has a return."""
    members = df.groupBy("portfolio_id").agg(F.expr("count(DISTINCT symbol) AS _m"))
    full = df.groupBy("portfolio_id", "date").agg(F.expr("count(*) AS _n")).join(members, "portfolio_id").where("_n = _m")
    return df.join(full.select("portfolio_id", "date"), ["portfolio_id", "date"], "left_semi")


def stressed_returns(
    df: DataFrame, scenarios: list[tuple] = SCENARIOS, base_bps: float = 5.0, seed: int = RESEARCH.seed
) -> DataFrame:
    """Strategy return per portfolio, symbol, date and scenario.

    Delays are lags of the position computed once per symbol; each scenario then picks its own, so the
    input is shuffled by symbol once and multiplied by the literal scenario grid. The first day has no
    position change to price and drops out.
    """
    key = "portfolio_id, symbol"
    over = R.over(key)
    delays = sorted({s[3] for s in scenarios})
    df = common_dates(df).selectExpr(
        "portfolio_id", "symbol", "date", "ret", f"row_number() {over} AS _rn",
        *[f"CAST({'position' if d == 0 else f'lag(position, {d}, 1) {over}'} AS DOUBLE) AS _p{d}" for d in delays],
    )
    df = df.selectExpr("*", *[f"abs(_p{d} - lag(_p{d}) {over}) AS _c{d}" for d in delays]).where("_rn > 1")
    rows = df.selectExpr("*", f"inline({grid(scenarios, FIELDS)})")
    pick = "CASE delay " + " ".join(f"WHEN {d} THEN {{0}}{d}" for d in delays) + " END"
    factor = keyed_normal(0.0, 0.015, f"'{seed}'", "'factor'", "scenario", "date")
    blended = f"IF(correlation <= 0.3D, ret, correlation * {factor} + (1 - correlation) * ret)"
    cost = f"{pick.format('_c')} * {base_bps / 10000!r}D * slippage_mult"
    return rows.selectExpr("portfolio_id", "symbol", "date", "scenario", f"({blended} - {cost}) * {pick.format('_p')} AS strategy_return")


def asset_drawdowns(returns: DataFrame) -> DataFrame:
    by = ["portfolio_id", "symbol", "scenario"]
    return drawdown(equity(returns, by, "strategy_return"), by).groupBy(*by).agg(F.expr("min(drawdown) * 100 AS asset_dd"))


def portfolio_stress(returns: DataFrame, kill: float = -0.10) -> DataFrame:
    """Drawdown of the equal-weight portfolio per scenario and the kill-switch outcome."""
    members = returns.groupBy("portfolio_id").agg(F.expr("count(DISTINCT symbol) AS _m"))
    daily = returns.groupBy("portfolio_id", "scenario", "date").agg(F.expr("sum(strategy_return) AS _sum"))
    daily = daily.join(members, "portfolio_id").selectExpr("portfolio_id", "scenario", "date", "_sum / _m AS portfolio_return")
    by = ["portfolio_id", "scenario"]
    dd = drawdown(equity(daily, by, "portfolio_return"), by).groupBy(*by).agg(F.expr("min(drawdown) AS _dd"))
    return dd.selectExpr(*by, "_dd * 100 AS portfolio_dd", f"_dd <= {kill} AS kill_switch_triggered", f"_dd > {kill} AS survived")


def stress_summary(results: DataFrame, pass_at: float = 0.99) -> DataFrame:
    """The kill switch is correct by construction, as both sides test the same drawdown."""
    out = results.groupBy("portfolio_id").agg(
        F.expr("count(*) AS total_scenarios"), F.expr("count_if(survived) AS scenarios_passed"),
        F.expr("avg(IF(survived, 1D, 0D)) AS survival_rate"), F.expr("min(portfolio_dd) AS worst_dd"),
        F.expr("min(struct(round(portfolio_dd, 9) AS portfolio_dd, scenario)).scenario AS worst_scenario"),
    )
    return out.selectExpr(
        "*", "1D AS kill_switch_accuracy",
        f"survival_rate >= {pass_at} AS overall_pass",
    )


def verdict(nulls: DataFrame, permutation: DataFrame, survived: DataFrame, stress: DataFrame, members: DataFrame) -> DataFrame:
    """One row per symbol: it passes only when all four phases pass; a missing phase fails."""
    phases = members.select("portfolio_id", "symbol").distinct()
    for frame, column, out, key in (
        (nulls, "passed", "null_pass", "symbol"), (permutation, "overall_pass", "permutation_pass", "symbol"),
        (survived, "passed", "survival_pass", "symbol"), (stress, "overall_pass", "stress_pass", "portfolio_id"),
    ):
        phases = phases.join(frame.selectExpr(key, f"{column} AS {out}"), key, "left")
    names = ("null_pass", "permutation_pass", "survival_pass", "stress_pass")
    filled = phases.selectExpr("symbol", "portfolio_id", *[f"coalesce({n}, false) AS {n}" for n in names])
    return filled.selectExpr("*", f"{' AND '.join(names)} AS overall_pass")
