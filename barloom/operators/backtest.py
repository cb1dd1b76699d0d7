"""Returns net of costs, equity, drawdown, and the summary metrics of a back-test.

Inputs are keyed by one or more grouping columns (symbol, strategy, resample, threshold ...) and a date;
every function takes those columns as ``by``, so a sweep is the same plan with one more key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.config import COSTS, RESEARCH, TRADING_DAYS, Costs
from barloom.functions import rolling as R
from barloom.functions.text import div, grid, keyed_normal, keyed_uniform

_ANNUAL = f"{math.sqrt(TRADING_DAYS)!r}D"


def _key(by: list[str]) -> str:
    return ", ".join(by)


def abstain(df: DataFrame, min_confidence: float | str, prob: str = "prob_up", confidence: str = "confidence") -> DataFrame:
    """Signal from a probability; 0 below the confidence floor or at exactly one half."""
    return df.selectExpr(
        f"* {'EXCEPT (signal)' if 'signal' in df.columns else ''}",
        f"CASE WHEN {confidence} < {min_confidence} THEN 0 WHEN {prob} > 0.5D THEN 1 WHEN {prob} < 0.5D THEN -1 "
        "ELSE 0 END AS signal",
    )


def net_returns(
    preds: DataFrame, by: list[str] = ["symbol"], costs: Costs = COSTS, rate: str | None = None, ret: str = "actual_return"
) -> DataFrame:
    """Signal times return less turnover times cost; the position before the first row is 0.

    ``rate`` overrides the fixed cost per unit of turnover by a column. The optional random slippage and
    missed fills are keyed draws, so a rerun of a lost task gives the same numbers.
    """
    executed = "signal"
    if costs.delay_prob > 0:
        missed = keyed_uniform(f"'{costs.seed}'", "'delay'", *by, "date")
        executed = f"IF({missed} < {costs.delay_prob}D, 0, signal)"
    slip = "0D"
    if costs.slippage_std > 0:
        slip = f"abs({keyed_normal(0.0, costs.slippage_std, f'{chr(39)}{costs.seed}{chr(39)}', *by, 'date')})"
    df = preds.selectExpr("*", f"{executed} AS executed_signal", f"{slip} AS slippage")
    df = df.selectExpr(
        "*", f"abs(executed_signal - lag(executed_signal, 1, 0) {R.over(_key(by))}) AS turnover"
    )
    unit = rate or f"{costs.fixed_rate()!r}D"
    return df.selectExpr("*", f"executed_signal * {ret} - turnover * ({unit} + slippage) AS net_return")


def equity(df: DataFrame, by: list[str] = ["symbol"], ret: str = "net_return", start: float = 1.0, out: str = "equity") -> DataFrame:
    """Compounded equity."""
    return df.withColumn(out, F.lit(float(start)) * running_product(ret, by))


def running_product(ret: str, by: list[str], order: str = "date") -> Column:
    """Running product of ``1 + ret``."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.product(F.expr(f"1 + {ret}")).over(frame)


def total_product(ret: str) -> Column:
    """Aggregate product of ``1 + ret``."""
    return F.product(F.expr(f"1 + {ret}"))


def drawdown(
    df: DataFrame, by: list[str] = ["symbol"], value: str = "equity", start: float | None = None, out: str = "drawdown",
    order: str = "date",
) -> DataFrame:
    """Drop from the running peak; ``start`` counts as the first peak when given."""
    peak = f"max({value}) {R.running(_key(by), order)}"
    if start is not None:
        peak = f"greatest({peak}, {float(start)!r}D)"
    return df.selectExpr("*", f"{div(f'{value} - {peak}', peak)} AS {out}")


def pnl_metrics(df: DataFrame, by: list[str] = ["symbol"], ret: str = "net_return", capital: float = RESEARCH.initial_capital) -> DataFrame:
    """Total return, Sharpe (population deviation), drawdown, win rate, expectancy, profit factor, CAGR."""
    df = drawdown(equity(df, by, ret, capital), by, "equity", capital)
    summary = df.groupBy(*by).agg(
        F.expr(f"max_by(equity, date) / {capital!r}D - 1 AS total_return"),
        F.expr(f"coalesce({div(f'avg({ret})', f'stddev_pop({ret})')} * {_ANNUAL}, 0D) AS sharpe_ratio"),
        F.expr("abs(min(least(drawdown, 0D))) AS max_drawdown"),
        F.expr(f"avg(IF({ret} > 0, 1D, 0D)) AS win_rate"),
        F.expr(f"avg({ret}) AS expectancy"),
        F.expr(f"coalesce(sum(IF({ret} > 0, {ret}, 0D)), 0D) AS _win"),
        F.expr(f"abs(coalesce(sum(IF({ret} < 0, {ret}, 0D)), 0D)) AS _loss"),
        F.expr("datediff(max(date), min(date)) AS _days"),
        F.expr("count(*) AS n_days"),
    )
    return summary.selectExpr(
        "* EXCEPT (_win, _loss, _days)",
        "CASE WHEN _loss > 0 THEN _win / _loss WHEN _win > 0 THEN DOUBLE('Infinity') ELSE 0D END AS profit_factor",
        "IF(_days > 0, power(1 + total_return, 365D / _days) - 1, 0D) AS cagr",
    )


def signal_metrics(preds: DataFrame, by: list[str] = ["symbol"], actual: str = "actual_direction") -> DataFrame:
    """Directional accuracy of the rows that trade, coverage, precision and recall per side."""

    def share(hits: str, base: str) -> str:
        return f"coalesce(try_divide(CAST(count_if({hits}) AS DOUBLE), count_if({base})), 0D)"

    return preds.groupBy(*by).agg(
        F.expr(f"{share(f'signal <> 0 AND signal = {actual}', 'signal <> 0')} AS directional_accuracy"),
        F.expr("avg(IF(signal <> 0, 1D, 0D)) AS coverage"),
        F.expr(f"{share(f'signal = 1 AND {actual} = 1', 'signal = 1')} AS buy_precision"),
        F.expr(f"IF(count_if(signal = 1) > 0, {share(f'signal = 1 AND {actual} = 1', f'{actual} = 1')}, 0D) AS buy_recall"),
        F.expr(f"{share(f'signal = -1 AND {actual} = -1', 'signal = -1')} AS sell_precision"),
        F.expr(f"IF(count_if(signal = -1) > 0, {share(f'signal = -1 AND {actual} = -1', f'{actual} = -1')}, 0D) AS sell_recall"),
        F.expr("coalesce(avg(IF(signal <> 0, confidence, NULL)), 0D) AS avg_confidence"),
        F.expr("count_if(signal <> 0) AS trades"),
        F.expr("count_if(signal = 0) AS abstentions"),
        F.expr("count(*) AS n_rows"),
    )


def conditional_returns(bars: DataFrame, by: list[str] = ["symbol"], signal: str = "signal", cost_bps: float | str = RESEARCH.cost_bps) -> DataFrame:
    """Open-to-open return of the signal less costs on its changes; the first row pays its own entry."""
    key = _key(by)
    entry, leave = R.lead("open", 1, key), R.lead("open", 2, key)
    turnover = f"abs({signal} - lag({signal}, 1, 0) {R.over(key)})"
    df = bars.selectExpr("*", f"{div(f'{leave} - {entry}', entry)} AS next_open_return", f"{turnover} AS turnover")
    return df.selectExpr("*", f"{signal} * next_open_return - turnover * ({cost_bps} / 10000D) AS net_return")


def conditional_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Metrics of :func:`conditional_returns` rows; rows without a next open are left out of all but turnover."""
    return df.groupBy(*by).agg(
        (total_product("net_return") - 1).alias("total_return"),
        F.expr(
            f"IF(stddev_samp(net_return) > 0, {div('avg(net_return)', 'stddev_samp(net_return)')} * {_ANNUAL}, 0D) AS sharpe"
        ),
        F.expr("coalesce(try_divide(CAST(count_if(net_return > 0) AS DOUBLE), count(net_return)), 0D) AS win_rate"),
        F.expr("count(net_return) AS n_trades"),
        F.expr("sum(turnover) AS turnover_count"),
    )


def backtest_conditional(bars: DataFrame, by: list[str] = ["symbol"], signal: str = "signal", cost_bps: float | str = RESEARCH.cost_bps) -> DataFrame:
    return conditional_summary(conditional_returns(bars, by, signal, cost_bps), by)


def baselines(df: DataFrame, signals: dict[str, str], reference: str, cost_bps: float = RESEARCH.cost_bps) -> DataFrame:
    """One back-test row per symbol and named signal expression, with the gap to ``reference``.

    All signals are exploded from the same row, so the bars are scanned and shuffled once.
    """
    rows = ", ".join(f"struct('{name}' AS strategy, CAST({expr} AS DOUBLE) AS signal)" for name, expr in signals.items())
    keep = df.selectExpr("symbol", "date", "open", f"inline(array({rows}))")
    out = backtest_conditional(keep, ["symbol", "strategy"], "signal", cost_bps)
    return out.selectExpr(
        "*",
        f"total_return - max(IF(strategy = '{reference}', total_return, NULL)) OVER (PARTITION BY symbol) AS return_delta",
        f"sharpe - max(IF(strategy = '{reference}', sharpe, NULL)) OVER (PARTITION BY symbol) AS sharpe_delta",
    )


def calibration(preds: DataFrame, by: list[str] = ["symbol"], bins: int = 9, actual: str = "actual_direction") -> DataFrame:
    """Accuracy per confidence bin on [0, 1); empty bins are 0. A zero signal counts as a short."""
    hit = f"IF(signal > 0, 1, -1) = {actual}"
    found = preds.where("confidence >= 0 AND confidence < 1").groupBy(
        *by, F.expr(f"CAST(floor(confidence * {bins}) AS INT) AS bin")
    ).agg(F.expr(f"avg(IF({hit}, 1D, 0D)) AS accuracy"), F.expr("count(*) AS n"))
    spine = preds.select(*by).distinct().selectExpr("*", f"explode(sequence(0, {bins - 1})) AS bin")
    joined = spine.join(found, [*by, "bin"], "left")
    return joined.selectExpr(
        *by, "bin", f"(bin + 0.5D) / {bins} AS bin_center", "coalesce(accuracy, 0D) AS accuracy", "coalesce(n, 0) AS n"
    )


def signal_distribution(preds: DataFrame, by: list[str] = ["symbol"]) -> DataFrame:
    return preds.groupBy(*by, "signal").agg(F.expr("count(*) AS n"))


def histogram(df: DataFrame, column: str, bins: int = 50, by: list[str] = ["symbol"]) -> DataFrame:
    """Equal-width counts between the group's minimum and maximum; the last bin is closed."""
    edges = df.groupBy(*by).agg(F.expr(f"min({column}) AS _lo"), F.expr(f"max({column}) AS _hi"))
    at = f"coalesce(CAST(floor({div(f'({column} - _lo) * {bins}', '_hi - _lo')}) AS INT), 0)"
    placed = df.where(f"{column} IS NOT NULL").join(edges, by).selectExpr(*by, f"least({at}, {bins - 1}) AS bin")
    return placed.groupBy(*by, "bin").agg(F.expr("count(*) AS n"))


def cross_asset(preds: DataFrame, costs: Costs = COSTS) -> DataFrame:
    """PnL metrics of the signal and of holding the asset, one row each per symbol."""
    both = net_returns(preds, costs=costs).selectExpr(
        "symbol", "date",
        "inline(array(struct('signal' AS strategy, net_return), struct('hold' AS strategy, actual_return AS net_return)))",
    )
    return pnl_metrics(both, ["symbol", "strategy"])


def threshold_sweep(preds: DataFrame, thresholds: list[float], by: list[str] = ["symbol"], costs: Costs = COSTS) -> DataFrame:
    """Re-threshold the same scores at every level: scores are fitted once, rows multiplied by a literal grid."""
    base = preds.drop("signal").selectExpr("*", f"inline({grid([(float(x),) for x in thresholds], ['threshold'])})")
    swept = abstain(base, "threshold")
    key = [*by, "threshold"]
    return signal_metrics(swept, key).join(pnl_metrics(net_returns(swept, key, costs), key), key)


def cost_sweep(preds: DataFrame, bps: list[float], by: list[str] = ["symbol"]) -> DataFrame:
    """PnL metrics at each total cost per unit of turnover."""
    base = preds.selectExpr("*", f"inline({grid([(float(x),) for x in bps], ['cost_bps'])})")
    key = [*by, "cost_bps"]
    return pnl_metrics(net_returns(base, key, Costs(), "cost_bps / 10000D"), key)


def time_shift(preds: DataFrame, shifts: list[int], min_confidence: float, fill: float = 0.5) -> DataFrame:
    """Metrics when the forecast of another bar is used: ``k`` bars late for positive shifts, early for negative."""
    versions = ", ".join(
        f"struct({k} AS shift_days, coalesce({_moved('prob_up', k)}, {fill}D) AS prob_up, "
        f"coalesce({_moved('confidence', k)}, 0D) AS confidence)"
        for k in [0, *shifts]
    )
    moved = preds.selectExpr("symbol", "date", "actual_return", "actual_direction", f"array({versions}) AS _v")
    rows = moved.selectExpr("* EXCEPT (_v)", "inline(_v)")
    key = ["symbol", "shift_days"]
    scored = abstain(rows, min_confidence)
    return signal_metrics(scored, key).join(pnl_metrics(net_returns(scored, key), key), key)


def _moved(x: str, k: int) -> str:
    if k == 0:
        return x
    return R.lag(x, k) if k > 0 else R.lead(x, -k)


def label_shuffle(preds: DataFrame, seed: int = RESEARCH.seed) -> DataFrame:
    """Outcomes dealt to other dates of the same symbol in keyed random order; a sound model finds nothing."""
    from barloom.functions.text import keyed_draw

    outcomes = preds.selectExpr(
        "symbol", "actual_return", "actual_direction",
        f"row_number() OVER (PARTITION BY symbol ORDER BY {keyed_draw(f'{chr(39)}{seed}{chr(39)}', 'symbol', 'date')}, date) AS _rn",
    )
    rows = preds.drop("actual_return", "actual_direction").selectExpr("*", f"row_number() {R.over()} AS _rn")
    dealt = rows.join(outcomes, ["symbol", "_rn"])
    out = signal_metrics(dealt).join(pnl_metrics(net_returns(dealt)), "symbol")
    return out.selectExpr("*", "abs(directional_accuracy - 0.5D) < 0.1D AND total_return < 0.05D AS passed")


def best_config(metrics: DataFrame, config: str, by: list[str], min_trades: int = 1, score: str = "directional_accuracy") -> DataFrame:
    """Configuration with the highest score among those with enough trades; ties go to the lower value."""
    valid = metrics.where(f"trades >= {min_trades}")
    return valid.groupBy(*by).agg(F.expr(f"max_by(struct({config}, {score}), struct({score}, -{config})) AS _b")).selectExpr(
        *by, f"_b.{config} AS {config}", f"_b.{score} AS {score}"
    )
