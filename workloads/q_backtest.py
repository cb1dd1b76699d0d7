"""Back-test, sweep and robustness queries."""

from __future__ import annotations

from barloom.config import Costs
from barloom.functions import scan
from barloom.operators import backtest as B, regimes
from barloom.plans.gate import gate_versus_hold
from workloads.oracle import ORACLE_VIEWS as V
from workloads.registry import query
from workloads.sqlkit import RUN, W, div, draw, frame, lead, normal, roll, uniform

V["gate_curves"] = f"""SELECT *, ret * position AS sret, product(1 + ret * position) OVER {RUN} AS seq, product(1 + ret) OVER {RUN} AS heq FROM strategy_daily"""
V["gate_dd"] = f"""SELECT *, seq / max(seq) OVER {RUN} - 1 AS sdd, heq / max(heq) OVER {RUN} - 1 AS hdd,
  coalesce(({roll('avg', 'sret', 60)}) / nullif({roll('stddev_samp', 'sret', 60)}, 0) * sqrt(252e0), 0e0) AS sharpe_60d FROM gate_curves"""


@query("gate_versus_hold",
       "symbol strategy_return:6 hold_return:6 strategy_max_dd:6 hold_max_dd:6 dd_improvement:6 last_sharpe_60d:6 exposure:6",
       """SELECT symbol, max_by(seq, date) - 1 AS strategy_return, max_by(heq, date) - 1 AS hold_return, min(sdd) AS strategy_max_dd,
       min(hdd) AS hold_max_dd, min(sdd) - min(hdd) AS dd_improvement, max_by(sharpe_60d, date) AS last_sharpe_60d,
       avg(position) AS exposure FROM gate_dd GROUP BY symbol""")
def _(t):
    return gate_versus_hold(t.bars)


def net_sql(source: str, by: str = "symbol", rate: str = "15e-4", sig: str = "signal") -> str:
    return f"""SELECT *, {sig} * actual_return - turnover * ({rate}) AS net_return FROM (
    SELECT *, abs({sig} - lag({sig}, 1, 0) OVER (PARTITION BY {by} ORDER BY date)) AS turnover FROM {source}) tt"""


def pnl_sql(source: str, by: str = "symbol") -> str:
    run = f"(PARTITION BY {by} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""SELECT {by}, max_by(eq, date) / 1e5 - 1 AS total_return,
  coalesce(avg(net_return) / nullif(stddev_pop(net_return), 0) * sqrt(252e0), 0) AS sharpe_ratio,
  abs(min(least(dd, 0))) AS max_drawdown, avg(CASE WHEN net_return > 0 THEN 1e0 ELSE 0e0 END) AS win_rate,
  avg(net_return) AS expectancy, count(*) AS n_days,
  CASE WHEN sum(net_return) FILTER (net_return < 0) < 0 THEN coalesce(sum(net_return) FILTER (net_return > 0), 0) / abs(sum(net_return) FILTER (net_return < 0))
       WHEN sum(net_return) FILTER (net_return > 0) > 0 THEN 'Infinity'::DOUBLE ELSE 0e0 END AS profit_factor,
  CASE WHEN date_diff('day', min(date), max(date)) > 0 THEN power(max_by(eq, date) / 1e5, 365e0 / date_diff('day', min(date), max(date))) - 1 ELSE 0e0 END AS cagr
  FROM (SELECT *, eq / greatest(max(eq) OVER {run}, 1e5) - 1 AS dd FROM
    (SELECT *, 1e5 * product(1 + net_return) OVER {run} AS eq FROM ({source}) s0) s1) s2 GROUP BY {by}"""


def signal_sql(source: str, by: str = "symbol") -> str:
    def share(hits, base):
        return f"coalesce(count(*) FILTER ({hits}) * 1e0 / nullif(count(*) FILTER ({base}), 0), 0e0)"
    return f"""SELECT {by}, {share('signal <> 0 AND signal = actual_direction', 'signal <> 0')} AS directional_accuracy,
  avg(CASE WHEN signal <> 0 THEN 1e0 ELSE 0e0 END) AS coverage,
  {share('signal = 1 AND actual_direction = 1', 'signal = 1')} AS buy_precision,
  CASE WHEN count(*) FILTER (signal = 1) > 0 THEN {share('signal = 1 AND actual_direction = 1', 'actual_direction = 1')} ELSE 0e0 END AS buy_recall,
  {share('signal = -1 AND actual_direction = -1', 'signal = -1')} AS sell_precision,
  CASE WHEN count(*) FILTER (signal = -1) > 0 THEN {share('signal = -1 AND actual_direction = -1', 'actual_direction = -1')} ELSE 0e0 END AS sell_recall,
  coalesce(avg(confidence) FILTER (signal <> 0), 0e0) AS avg_confidence, count(*) FILTER (signal <> 0) AS trades,
  count(*) FILTER (signal = 0) AS abstentions, count(*) AS n_rows FROM {source} GROUP BY {by}"""


PNL_COLS = "total_return:6 sharpe_ratio:6 max_drawdown:6 win_rate:6 expectancy:8 profit_factor:6 cagr:6"
SIG_COLS = "directional_accuracy:6 coverage:6 trades:i"
V["net_rows"] = net_sql("preds")
V["pnl_rows"] = pnl_sql("SELECT * FROM net_rows")


@query("abstention_signals", "symbol date prob_up:6 confidence:6 signal:i",
       "SELECT symbol, date, prob_up, confidence, CASE WHEN confidence < 6e-1 THEN 0 WHEN prob_up > 5e-1 THEN 1 WHEN prob_up < 5e-1 THEN -1 ELSE 0 END AS signal FROM preds")
def _(t):
    return B.abstain(t.preds, 0.6)


@query("net_daily_returns", "symbol date signal:i turnover:i net_return:8", "SELECT * FROM net_rows")
def _(t):
    return B.net_returns(t.preds)


_missed = uniform("'42'", "'delay'", "symbol", "date")


@query("net_daily_returns_random_costs", "symbol date executed_signal:i turnover:i net_return:8",
       f"""SELECT *, executed_signal * actual_return - turnover * (15e-4 + abs({normal(0.0, 0.0005, "'42'", 'symbol', 'date')})) AS net_return FROM (
       SELECT *, abs(executed_signal - lag(executed_signal, 1, 0) OVER {W}) AS turnover FROM (
       SELECT *, CASE WHEN {_missed} < 1e-1 THEN 0 ELSE signal END AS executed_signal FROM preds) a) b""")
def _(t):
    return B.net_returns(t.preds, costs=Costs(slippage_std=0.0005, delay_prob=0.1))


@query("equity_curve", "symbol date equity:6", f"SELECT symbol, date, product(1 + net_return) OVER {RUN} AS equity FROM net_rows")
def _(t):
    return B.equity(B.net_returns(t.preds))


@query("drawdown_series", "symbol date drawdown:6 drawdown_from_start:6",
       f"""SELECT *, eq / max(eq) OVER {RUN} - 1 AS drawdown, eq / greatest(max(eq) OVER {RUN}, 1e0) - 1 AS drawdown_from_start
       FROM (SELECT symbol, date, product(1 + net_return) OVER {RUN} AS eq FROM net_rows) x""")
def _(t):
    df = B.equity(B.net_returns(t.preds))
    return B.drawdown(B.drawdown(df), start=1.0, out="drawdown_from_start")


@query("drawdown_by_bucket", "symbol date drawdown:6",
       f"""SELECT symbol, date, eq / greatest(max(eq) OVER {RUN}, 1e0) - 1 AS drawdown
       FROM (SELECT symbol, date, product(1 + net_return) OVER {RUN} AS eq FROM net_rows) x""")
def _(t):
    return scan.drawdown(B.net_returns(t.preds), ["symbol"], "year(date)", ["date"], "net_return", start=1.0)


@query("pnl_summary", f"symbol {PNL_COLS} n_days:i", "SELECT * FROM pnl_rows")
def _(t):
    return B.pnl_metrics(B.net_returns(t.preds))


V["signal_rows"] = signal_sql("preds")


@query("signal_quality",
       "symbol directional_accuracy:6 coverage:6 buy_precision:6 buy_recall:6 sell_precision:6 sell_recall:6 avg_confidence:6 trades:i",
       "SELECT * FROM signal_rows")
def _(t):
    return B.signal_metrics(t.preds)


@query("multi_symbol_robustness", f"symbol trades:i abstentions:i coverage:6 directional_accuracy:6 {PNL_COLS}",
       "SELECT * FROM signal_rows JOIN pnl_rows USING (symbol)")
def _(t):
    return B.signal_metrics(t.preds).join(B.pnl_metrics(B.net_returns(t.preds)), "symbol")


@query("cross_asset_summary", "symbol strategy total_return:6 sharpe_ratio:6 max_drawdown:6 cagr:6",
       pnl_sql("SELECT symbol, date, 'signal' AS strategy, net_return FROM net_rows UNION ALL SELECT symbol, date, 'hold', actual_return FROM preds",
               "symbol, strategy"))
def _(t):
    return B.cross_asset(t.preds)


def conditional_sql(source: str, by: str = "symbol", bps: str = "10e0") -> str:
    w = f"(PARTITION BY {by} ORDER BY date)"
    return f"""SELECT {by}, product(1 + net_return) - 1 AS total_return,
  CASE WHEN stddev_samp(net_return) > 0 THEN avg(net_return) / stddev_samp(net_return) * sqrt(252e0) ELSE 0e0 END AS sharpe,
  coalesce(count(*) FILTER (net_return > 0) * 1e0 / nullif(count(net_return), 0), 0e0) AS win_rate,
  count(net_return) AS n_trades, sum(turnover) AS turnover_count FROM (
    SELECT *, signal * nor - turnover * {bps} / 10000e0 AS net_return FROM (
      SELECT *, (lead(open, 2) OVER {w} - lead(open, 1) OVER {w}) / nullif(lead(open, 1) OVER {w}, 0) AS nor,
             abs(signal - lag(signal, 1, 0) OVER {w}) AS turnover FROM ({source}) c0) c1) c2 GROUP BY {by}"""


COND = "total_return:6 sharpe:6 win_rate:6 n_trades:i turnover_count:6"
LATTICE_SIGNAL = "SELECT *, CASE WHEN lattice_state = 0 THEN 0e0 ELSE 1e0 END AS signal FROM lattice_rows"


@query("conditional_backtest", f"symbol {COND}", conditional_sql(LATTICE_SIGNAL))
def _(t):
    df = regimes.exposure(regimes.lattice(regimes.label_regimes(t.bars)))
    return B.backtest_conditional(df, signal="exposure")


@query("strategy_baselines", f"symbol strategy {COND} return_delta:6 sharpe_delta:6",
       "SELECT *, total_return - max(total_return) FILTER (strategy = 'buy_and_hold') OVER (PARTITION BY symbol) AS return_delta, "
       "sharpe - max(sharpe) FILTER (strategy = 'buy_and_hold') OVER (PARTITION BY symbol) AS sharpe_delta FROM ("
       + conditional_sql("""SELECT symbol, date, open, s.strategy, CASE s.strategy WHEN 'buy_and_hold' THEN 1e0 WHEN 'momentum' THEN momentum_signal
         ELSE reversal_signal END AS signal FROM (SELECT c.*, open FROM component_signal_rows c JOIN bars USING (symbol, date)) c,
         (VALUES ('buy_and_hold'), ('momentum'), ('reversal')) s(strategy)""", "symbol, strategy") + ") z")
def _(t):
    df = regimes.component_signals(t.bars)
    return B.baselines(df, {"buy_and_hold": "1D", "momentum": "momentum_signal", "reversal": "reversal_signal"}, "buy_and_hold")


@query("confidence_calibration", "symbol bin:i bin_center:6 accuracy:6 n:i",
       """SELECT s.symbol, s.bin, (s.bin + 5e-1) / 9 AS bin_center, coalesce(accuracy, 0e0) AS accuracy, coalesce(n, 0) AS n FROM (
       SELECT symbol, unnest(range(0, 9)) AS bin FROM (SELECT DISTINCT symbol FROM preds) d) s LEFT JOIN (
       SELECT symbol, CAST(floor(confidence * 9) AS BIGINT) AS bin, avg(CASE WHEN (CASE WHEN signal > 0 THEN 1 ELSE -1 END) = actual_direction THEN 1e0 ELSE 0e0 END) AS accuracy, count(*) AS n
       FROM preds WHERE confidence >= 0 AND confidence < 1 GROUP BY 1, 2) a USING (symbol, bin)""")
def _(t):
    return B.calibration(t.preds)


@query("signal_distribution", "symbol signal:i n:i", "SELECT symbol, signal, count(*) AS n FROM preds GROUP BY 1, 2")
def _(t):
    return B.signal_distribution(t.preds)


@query("return_histogram", "symbol bin:i n:i",
       """SELECT symbol, least(coalesce(CAST(floor((actual_return - lo) * 50 / nullif(hi - lo, 0)) AS BIGINT), 0), 49) AS bin, count(*) AS n
       FROM preds JOIN (SELECT symbol, min(actual_return) AS lo, max(actual_return) AS hi FROM preds GROUP BY 1) e USING (symbol) GROUP BY 1, 2""")
def _(t):
    return B.histogram(t.preds, "actual_return")


THRESHOLDS = [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65]
V["sweep_signals"] = """SELECT symbol, date, prob_up, confidence, actual_return, actual_direction, threshold,
  CASE WHEN confidence < threshold THEN 0 WHEN prob_up > 5e-1 THEN 1 WHEN prob_up < 5e-1 THEN -1 ELSE 0 END AS signal
  FROM preds, (SELECT unnest([3e-1, 35e-2, 4e-1, 45e-2, 5e-1, 55e-2, 6e-1, 65e-2]) AS threshold) p"""
V["sweep_net"] = net_sql("sweep_signals", "symbol, threshold")


@query("threshold_sweep", f"symbol threshold:2 {SIG_COLS} {PNL_COLS}",
       f"SELECT * FROM ({signal_sql('sweep_signals', 'symbol, threshold')}) a JOIN ({pnl_sql('SELECT * FROM sweep_net', 'symbol, threshold')}) b USING (symbol, threshold)")
def _(t):
    return B.threshold_sweep(t.preds, THRESHOLDS)


@query("best_threshold", "symbol threshold:2 directional_accuracy:6",
       f"""SELECT symbol, arg_max(threshold, struct_pack(a := round(directional_accuracy, 9), t := -threshold)) AS threshold,
       max(round(directional_accuracy, 9)) AS directional_accuracy FROM ({signal_sql('sweep_signals', 'symbol, threshold')}) m
       WHERE trades >= 20 GROUP BY symbol""")
def _(t):
    sweep = B.threshold_sweep(t.preds, THRESHOLDS)
    return B.best_config(sweep.selectExpr("symbol", "threshold", "round(directional_accuracy, 9) AS directional_accuracy", "trades"),
                         "threshold", ["symbol"], 20)


@query("cost_sweep", f"symbol cost_bps:1 {PNL_COLS}",
       pnl_sql(net_sql("(SELECT * FROM preds, (SELECT unnest([0e0, 5e0, 10e0, 20e0, 50e0]) AS cost_bps) p) px", "symbol, cost_bps", "cost_bps / 10000e0"),
               "symbol, cost_bps"))
def _(t):
    return B.cost_sweep(t.preds, [0, 5, 10, 20, 50])


V["shifted"] = "SELECT *, CASE WHEN confidence < 3e-1 THEN 0 WHEN prob_up > 5e-1 THEN 1 WHEN prob_up < 5e-1 THEN -1 ELSE 0 END AS signal FROM (" + " UNION ALL ".join(
    f"SELECT symbol, date, actual_return, actual_direction, {k} AS shift_days, "
    f"coalesce({'prob_up' if k == 0 else ('lag' if k > 0 else 'lead') + f'(prob_up, {abs(k)}) OVER {W}'}, 5e-1) AS prob_up, "
    f"coalesce({'confidence' if k == 0 else ('lag' if k > 0 else 'lead') + f'(confidence, {abs(k)}) OVER {W}'}, 0e0) AS confidence FROM preds"
    for k in (0, -2, -1, 1, 2)) + ") u"


@query("time_shift_test", f"symbol shift_days:i {SIG_COLS} {PNL_COLS}",
       f"""SELECT * FROM ({signal_sql('shifted', 'symbol, shift_days')}) a JOIN
       ({pnl_sql(net_sql('shifted', 'symbol, shift_days'), 'symbol, shift_days')}) b USING (symbol, shift_days)""")
def _(t):
    return B.time_shift(t.preds, [-2, -1, 1, 2], 0.3)


V["label_deal"] = f"""SELECT p.symbol, p.date, p.signal, p.confidence, o.actual_return, o.actual_direction
  FROM (SELECT *, row_number() OVER {W} AS rn FROM preds) p JOIN
  (SELECT symbol, actual_return, actual_direction, row_number() OVER (PARTITION BY symbol ORDER BY {draw("'42'", 'symbol', 'date')}, date) AS rn FROM preds) o
  USING (symbol, rn)"""


@query("label_shuffle_test", f"symbol {SIG_COLS} {PNL_COLS} passed:b",
       f"""SELECT *, abs(directional_accuracy - 5e-1) < 1e-1 AND total_return < 5e-2 AS passed FROM ({signal_sql('label_deal')}) a
       JOIN ({pnl_sql(net_sql('label_deal'))}) b USING (symbol)""")
def _(t):
    return B.label_shuffle(t.preds)
