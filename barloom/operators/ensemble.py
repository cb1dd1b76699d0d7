"""Ensembles over a long table of specialist predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.config import RESEARCH
from barloom.operators.backtest import net_returns, pnl_metrics, signal_metrics
from barloom.plans.stage import staged


def score_simple_average(preds: DataFrame, by: list[str] = ["symbol", "date"], min_confidence: float = RESEARCH.min_confidence) -> DataFrame:
    """Mean of signals with a dead band of 0.1, silent when the mean confidence is too low."""
    mean = preds.groupBy(*by).agg(
        F.expr("avg(signal) AS avg_signal"), F.expr("avg(confidence) AS confidence"), F.expr("avg(prob_up) AS prob_up"),
        F.expr("count(*) AS n_models"),
    )
    return mean.selectExpr(
        "*", f"CASE WHEN confidence < {min_confidence} THEN 0 WHEN avg_signal > 0.1D THEN 1 WHEN avg_signal < -0.1D THEN -1 ELSE 0 END AS signal"
    )


def ablate(preds: DataFrame, outcomes: DataFrame, configs: dict[str, list[str]], min_confidence: float = RESEARCH.min_confidence) -> DataFrame:
    """The average ensemble with subsets of its members, back-tested per symbol.

    Each prediction goes to the configurations that contain its model, so there is no join with them. The scored rows are stored
    once for both kinds of metrics.
    ``outcomes`` has ``actual_return`` and ``actual_direction`` per symbol and date.
    """
    models = sorted({m for members in configs.values() for m in members})
    lists = " ".join(
        f"WHEN '{m}' THEN array({', '.join(repr(c) for c, members in configs.items() if m in members)})" for m in models
    )
    spread = preds.selectExpr("*", f"explode(CASE model {lists} ELSE array() END) AS configuration")
    scored = staged(score_simple_average(spread, ["configuration", "symbol", "date"], min_confidence).join(outcomes, ["symbol", "date"]), "ablation")
    key = ["configuration", "symbol"]
    return signal_metrics(scored, key).join(pnl_metrics(net_returns(scored, key), key), key)


def classification_report(preds: DataFrame, label: str, predicted: str, values: list[int], by: list[str] = ["symbol"]) -> DataFrame:
    """Confusion counts and shares per true label, with the group's overall accuracy."""
    key = ", ".join(by)
    counts = preds.groupBy(*by, label).agg(
        *[F.expr(f"count_if({predicted} = {v}) AS n_pred_{v}") for v in values], F.expr(f"count_if({predicted} = {label}) AS _hit"),
        F.expr("count(*) AS support"),
    )
    over = f"OVER (PARTITION BY {key})"
    return counts.selectExpr(
        *by, f"{label} AS label", "support", *[f"n_pred_{v}" for v in values],
        *[f"n_pred_{v} / CAST(support AS DOUBLE) AS share_pred_{v}" for v in values],
        f"sum(_hit) {over} / CAST(sum(support) {over} AS DOUBLE) AS accuracy",
    )


def min_trades(preds: DataFrame, period: int = 21, minimum: int = 5) -> DataFrame:
    """Promote the most confident abstentions of a period until it has ``minimum`` trades.

    A period with too few abstentions to reach the minimum, and the incomplete last period, stay as they are.
    """
    over = "OVER (PARTITION BY symbol ORDER BY date)"
    df = preds.selectExpr("*", f"row_number() {over} - 1 AS _rn", "count(*) OVER (PARTITION BY symbol) AS _n")
    df = df.selectExpr("*", f"_rn DIV {period} AS period", f"_rn DIV {period} < _n DIV {period} AS _whole")
    slot = "OVER (PARTITION BY symbol, period)"
    df = df.selectExpr(
        "*", f"count_if(signal <> 0) {slot} AS _trades", f"count_if(signal = 0) {slot} AS _idle",
        "row_number() OVER (PARTITION BY symbol, period ORDER BY IF(signal = 0, 0, 1), confidence DESC, date) AS _rank",
    )
    promote = f"_whole AND signal = 0 AND _trades < {minimum} AND _idle >= {minimum} - _trades AND _rank <= {minimum} - _trades"
    return df.selectExpr(
        "* EXCEPT (_rn, _n, _whole, _trades, _idle, _rank, signal)", f"coalesce({promote}, false) AS promoted",
        f"IF({promote}, IF(prob_up > 0.5D, 1, -1), signal) AS signal",
    )
