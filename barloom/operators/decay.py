"""Early signs of decay: entropy, clustering, duration drift, label correlation, and governance flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions import rolling as R
from barloom.functions.text import div
from barloom.operators.backtest import drawdown, equity
from barloom.operators.persistence import duration_drift


def entropy(df: DataFrame, columns: list[str], by: list[str] = ["symbol"]) -> DataFrame:
    """Mean of the columns' mean binary entropies."""

    def term(c: str) -> str:
        p = f"least(greatest({c}, 1e-10D), 1 - 1e-10D)"
        return f"avg(-{p} * log2({p}) - (1 - {p}) * log2(1 - {p}))"

    parts = ", ".join(term(c) for c in columns)
    return df.groupBy(*by).agg(F.expr(f"array({parts}) AS _e")).selectExpr(
        *by, "aggregate(filter(_e, x -> x IS NOT NULL), 0D, (a, x) -> a + x) / size(filter(_e, x -> x IS NOT NULL)) AS entropy"
    )


def probability_clustering(df: DataFrame, columns: list[str], by: list[str] = ["symbol"], limit: float = 0.8) -> DataFrame:
    """Share of probabilities below 0.1 or above 0.9."""
    extreme = " + ".join(f"count_if({c} < 0.1D OR {c} > 0.9D)" for c in columns)
    total = " + ".join(f"count({c})" for c in columns)
    out = df.groupBy(*by).agg(F.expr(f"coalesce({div(f'CAST({extreme} AS DOUBLE)', total)}, 0D) AS clustering"))
    return out.selectExpr("*", f"clustering > {limit} AS clustering_problem")


def label_correlation(current: DataFrame, historical: DataFrame, label: str = "regime", by: str = "symbol", floor: float = 0.5) -> DataFrame:
    """Spearman correlation of the two label series aligned at their ends, with average ranks for ties."""
    back = f"row_number() OVER (PARTITION BY {by} ORDER BY date DESC) AS _back"
    pairs = current.selectExpr(by, f"{label} AS _c", back).join(historical.selectExpr(by, f"{label} AS _h", back), [by, "_back"])

    def rank(x: str) -> str:
        return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2D"

    ranked = pairs.selectExpr(by, f"{rank('_c')} AS _rc", f"{rank('_h')} AS _rh")
    value = div("covar_samp(_rc, _rh)", "stddev_samp(_rc) * stddev_samp(_rh)")
    out = ranked.groupBy(by).agg(F.expr(f"coalesce({value}, 0D) AS correlation"))
    return out.selectExpr("*", f"correlation < {floor} AS correlation_problem")


def decay_status(
    probabilities: DataFrame, columns: list[str], current_durations: DataFrame, baseline_durations: DataFrame,
    current_labels: DataFrame, historical_labels: DataFrame, by: str = "symbol", entropy_floor: float = 0.3,
) -> DataFrame:
    """All four checks, the mean risk, and the list of alerts per symbol."""
    drift = duration_drift(current_durations, baseline_durations, by=by).groupBy(by).agg(
        F.expr("avg(abs(drift)) AS duration_drift")
    )
    df = entropy(probabilities, columns, [by]).join(probability_clustering(probabilities, columns, [by]), by)
    df = df.join(drift, by, "left").join(label_correlation(current_labels, historical_labels, by=by), by, "left")
    df = df.selectExpr(
        by, "coalesce(entropy, 1D) AS entropy", "clustering", "clustering_problem",
        "coalesce(duration_drift, 0D) AS duration_drift", "coalesce(correlation, 1D) AS correlation",
        "coalesce(correlation_problem, false) AS correlation_problem",
    )
    alerts = [
        (f"entropy < {entropy_floor}", "entropy_collapse", "WARNING", "entropy", f"{entropy_floor}D"),
        ("clustering_problem", "probability_clustering", "WARNING", "clustering", "0.8D"),
        ("duration_drift > 0.3", "duration_drift", "CRITICAL", "duration_drift", "0.3D"),
        ("correlation_problem", "correlation_drift", "CRITICAL", "correlation", "0.5D"),
    ]
    rows = ", ".join(
        f"IF({cond}, struct('{kind}' AS alert_type, '{sev}' AS severity, {value} AS current_value, {limit} AS threshold), NULL)"
        for cond, kind, sev, value, limit in alerts
    )
    df = df.selectExpr(
        "*", f"array_compact(array({rows})) AS alerts",
        "((1 - least(entropy, 1D)) + clustering + duration_drift + (1 - greatest(correlation, 0D))) / 4 AS overall_risk",
    )
    return df.selectExpr("*", "size(alerts) = 0 AS is_healthy")


def decay_alerts(status: DataFrame, by: str = "symbol") -> DataFrame:
    return status.selectExpr(by, "inline(alerts)")


def governance_flags(df: DataFrame, trigger: str = "is_trigger", ret: str = "ret") -> DataFrame:
    """Per-day governance conditions on strategy returns and kill-switch triggers."""
    df = drawdown(equity(df, ret=ret)).selectExpr(
        "*",
        f"{R.sharpe(ret, 126)} AS sharpe_6m", f"{R.sharpe(ret, 30)} AS sharpe_30d",
        f"count({ret}) {R.frame(30)} = 30 AS _warm",
        f"count({ret}) {R.frame(126)} = 126 AS _warm_6m",
        f"sum(IF({trigger}, 1, 0)) OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL '29' DAY PRECEDING AND CURRENT ROW) "
        "AS triggers_30d",
    )
    df = df.selectExpr("*", "_warm AND sharpe_30d < 0.5D AS _weak")
    df = df.selectExpr("*", f"sum(IF(_weak, 0, 1)) {R.running()} AS _island")
    df = df.selectExpr("*", f"sum(IF(_weak, 1, 0)) {R.running('symbol, _island')} AS weak_days")
    return df.selectExpr(
        "symbol", "date", "sharpe_6m", "drawdown", "triggers_30d", "weak_days",
        "_warm_6m AND sharpe_6m < 0 AS flag_sharpe_6m", "drawdown < -0.25D AS flag_drawdown_25",
        "triggers_30d >= 3 AS flag_triggers", "weak_days >= 30 AS flag_weak_sharpe", "drawdown < -0.15D AS flag_drawdown_15",
    )
