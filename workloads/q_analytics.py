"""Attribution, health, stability, persistence, decay and governance queries."""

from __future__ import annotations

from barloom.operators import attribution, decay, health, persistence, stability
from barloom.operators.backtest import drawdown, equity
from barloom.operators.regimes import vol_gate
from barloom.operators.windows import time_split
from workloads.oracle import ORACLE_VIEWS as V
from workloads.registry import query
from workloads.sqlkit import RUN, W, frame, lag, roll

V["strat"] = f"""SELECT *, sret AS strategy_ret, product(1 + sret - CASE WHEN moved THEN 1e-3 ELSE 0e0 END) OVER {RUN} AS equity FROM (
  SELECT *, ret * position AS sret, coalesce(position <> lag(position) OVER {W}, false) AS moved FROM strategy_daily) s"""


def strategy(t):
    """Gate positions with returns net of 10 bps per change, as an equity curve."""
    df = vol_gate(t.bars).selectExpr(
        "*", "ret * position AS strategy_ret",
        "coalesce(position <> lag(position) OVER (PARTITION BY symbol ORDER BY date), false) AS moved")
    df = df.selectExpr("*", "strategy_ret - IF(moved, 0.001D, 0D) AS net_return")
    return equity(df, ret="net_return")


V["attr"] = f"""SELECT symbol, date, total_pnl, ret * 100 AS market_return, regime AS regime_state, position = 1 AS was_exposed,
  CASE WHEN position = 1 THEN ret * 100 ELSE 0e0 END AS market_beta,
  CASE WHEN position <> 1 AND regime = 'HOSTILE' AND ret < 0 THEN -ret * 100 ELSE 0e0 END AS vol_avoidance,
  CASE WHEN position = 1 THEN total_pnl - ret * 100 ELSE 0e0 END AS timing_contribution,
  CASE WHEN moved THEN -1e-1 ELSE 0e0 END AS cost_drag, 0e0 AS slippage_impact
  FROM (SELECT *, (equity / lag(equity) OVER {W} - 1) * 100 AS total_pnl, row_number() OVER {W} AS rn FROM strat) x WHERE rn > 1"""


@query("pnl_attribution_daily",
       "symbol date total_pnl:6 market_beta:6 vol_avoidance:6 timing_contribution:6 cost_drag:6 regime_state was_exposed", "SELECT * FROM attr")
def _(t):
    return attribution.attribution_daily(strategy(t))


@query("pnl_attribution_summary",
       "symbol period_start period_end total_days:i total_pnl:6 total_market_beta:6 total_vol_avoidance:6 total_timing:6 total_costs:6 "
       "pct_from_beta:6 pct_from_vol_avoidance:6 pct_from_timing:6 pct_cost_drag:6 exposed_days:i flat_days:i risk_off_days:i primary_edge_source",
       """SELECT *, abs(total_market_beta) / nullif(base, 0) * 100 AS pct_from_beta, abs(total_vol_avoidance) / nullif(base, 0) * 100 AS pct_from_vol_avoidance,
       abs(total_timing) / nullif(base, 0) * 100 AS pct_from_timing, abs(total_costs) / nullif(abs(total_pnl), 0) * 100 AS pct_cost_drag,
       CASE WHEN abs(total_market_beta) >= abs(total_vol_avoidance) AND abs(total_market_beta) >= abs(total_timing) THEN 'market_beta'
            WHEN abs(total_vol_avoidance) >= abs(total_timing) THEN 'vol_avoidance' ELSE 'timing' END AS primary_edge_source
       FROM (SELECT *, abs(total_market_beta) + abs(total_vol_avoidance) + abs(total_timing) AS base FROM (
       SELECT symbol, min(date) AS period_start, max(date) AS period_end, count(*) AS total_days, sum(total_pnl) AS total_pnl,
       sum(market_beta) AS total_market_beta, sum(vol_avoidance) AS total_vol_avoidance, sum(timing_contribution) AS total_timing,
       sum(cost_drag) AS total_costs, count(*) FILTER (was_exposed) AS exposed_days, count(*) FILTER (NOT was_exposed) AS flat_days,
       count(*) FILTER (regime_state = 'HOSTILE') AS risk_off_days FROM attr GROUP BY symbol) a) b""")
def _(t):
    return attribution.attribution_summary(attribution.attribution_daily(strategy(t)))


V["health_agg"] = """SELECT symbol, min(date) AS period_start, max(date) AS period_end, count(*) FILTER (regime = 'HOSTILE') AS risk_off_predicted,
  count(*) FILTER (ret < 0) AS risk_off_actual, count(*) FILTER (regime = 'HOSTILE' AND ret < 0) AS hits,
  count(*) FILTER (position = 0 AND ret < -1e-2) AS crashes_avoided, coalesce(-sum(ret) FILTER (position = 0 AND ret < -1e-2), 0e0) AS damage,
  coalesce(sum(ret) FILTER (ret < -1e-2), 0e0) - coalesce(sum(ret * position) FILTER (ret < -1e-2), 0e0) AS crash_delta,
  min(sdd) AS sdd, min(hdd) AS hdd, count(*) FILTER (position = 0 AND ret > 1e-2) AS missed_rallies,
  coalesce(sum(ret) FILTER (position = 0 AND ret > 1e-2), 0e0) AS missed FROM gate_dd GROUP BY symbol"""
V["health_rows"] = """SELECT *, coalesce(hits * 1e0 / nullif(risk_off_predicted, 0), 0e0) AS regime_hit_rate, crash_delta * 100 AS crash_avoidance_delta,
  damage * 100 AS crash_damage_avoided, sdd * 100 AS max_drawdown_strategy, hdd * 100 AS max_drawdown_buyhold,
  (hdd - sdd) * 100 AS drawdown_prevented_pct, (hdd - sdd) * 1e5 AS drawdown_prevented_abs, missed * 100 AS opportunity_cost FROM health_agg"""


@query("regime_hit_rate", "symbol regime_hit_rate:6 risk_off_predicted:i risk_off_actual:i", "SELECT * FROM health_rows")
def _(t):
    return health.edge_health(vol_gate(t.bars))


@query("crash_avoidance", "symbol crash_avoidance_delta:6 crashes_avoided:i crash_damage_avoided:6", "SELECT * FROM health_rows")
def _(t):
    return health.edge_health(vol_gate(t.bars))


@query("drawdown_prevented", "symbol max_drawdown_strategy:6 max_drawdown_buyhold:6 drawdown_prevented_pct:6 drawdown_prevented_abs:4",
       "SELECT * FROM health_rows")
def _(t):
    return health.edge_health(vol_gate(t.bars))


@query("opportunity_cost", "symbol opportunity_cost:6 missed_rallies:i", "SELECT * FROM health_rows")
def _(t):
    return health.edge_health(vol_gate(t.bars))


@query("edge_health_score", "symbol period_start period_end health_score:6",
       """SELECT *, greatest(0e0, least(1e2, regime_hit_rate * 30 + least(4e1, crash_delta * 1000) + least(2e1, (hdd - sdd) * 100)
       - least(1e1, missed * 50))) AS health_score FROM health_rows""")
def _(t):
    return health.edge_health(vol_gate(t.bars))


def sharpe_sql(x: str, n: int) -> str:
    return f"coalesce(({roll('avg', x, n)}) / nullif({roll('stddev_samp', x, n)}, 0) * sqrt(252e0), 0e0)"


V["sharpe_rows"] = f"SELECT symbol, date, position, sret AS ret, {', '.join(f'{sharpe_sql(chr(115) + chr(114) + chr(101) + chr(116), n)} AS sharpe_{n}d' for n in (30, 60, 90))} FROM gate_curves"
V["stab_dd"] = f"""SELECT *, eq / max(eq) OVER {RUN} - 1 AS drawdown FROM (SELECT *, product(1 + ret) OVER {RUN} AS eq FROM sharpe_rows) x"""
V["stab_recent"] = f"""SELECT *, coalesce(position <> lag(position) OVER {W}, true) AS moved FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM stab_dd) x WHERE back <= 30"""
V["stab_snap"] = """SELECT *, greatest(0e0, 1 - abs(trades_30d - 12e0) / 12e0) AS trade_frequency_stability FROM (
  SELECT symbol, max(date) AS as_of, max_by(sharpe_30d, date) AS sharpe_30d, max_by(sharpe_60d, date) AS sharpe_60d, max_by(sharpe_90d, date) AS sharpe_90d,
  max_by(drawdown, date) * 100 AS current_drawdown, CASE WHEN count(*) < 30 THEN 0e0 ELSE regr_slope(drawdown, -back) END AS slope,
  avg(position) AS util, count(*) FILTER (moved) AS trades_30d FROM stab_recent GROUP BY symbol) x"""


def gated(t):
    return vol_gate(t.bars).selectExpr("symbol", "date", "position", "regime", "ret * position AS ret")


@query("rolling_sharpe", "symbol date sharpe_30d:6 sharpe_60d:6 sharpe_90d:6", "SELECT * FROM sharpe_rows")
def _(t):
    return stability.rolling_sharpe(gated(t))


@query("drawdown_slope", "symbol drawdown_slope:8", "SELECT symbol, slope AS drawdown_slope FROM stab_snap")
def _(t):
    return stability.drawdown_slope(drawdown(equity(gated(t), ret="ret")))


@query("exposure_utilization", "symbol exposure_utilization:6", "SELECT symbol, util AS exposure_utilization FROM stab_snap")
def _(t):
    return stability.exposure_utilization(gated(t))


@query("trade_frequency_stability", "symbol trades:i trade_frequency_stability:6", "SELECT *, trades_30d AS trades FROM stab_snap")
def _(t):
    return stability.trade_stability(gated(t))


@query("stability_report",
       "symbol as_of sharpe_trend drawdown_trend exposure_trend warnings stability_score:6",
       """SELECT *, CASE WHEN sharpe_30d < sharpe_90d - 3e-1 THEN 'degrading' WHEN sharpe_30d > sharpe_90d + 3e-1 THEN 'improving' ELSE 'stable' END AS sharpe_trend,
       CASE WHEN slope * 100 < -1e-1 THEN 'degrading' WHEN slope * 100 > 5e-2 THEN 'recovering' ELSE 'stable' END AS drawdown_trend,
       CASE WHEN util * 100 < 50 THEN 'underutilized' WHEN util * 100 > 90 THEN 'overutilized' ELSE 'balanced' END AS exposure_trend,
       concat_ws('; ', CASE WHEN sharpe_30d < sharpe_90d - 3e-1 THEN 'Sharpe ratio declining (30d < 90d by >0.3)' END,
         CASE WHEN slope * 100 < -1e-1 THEN concat('Drawdown worsening (slope: ', printf('%.2f', slope * 100), '%/day)') END,
         CASE WHEN util * 100 < 50 THEN 'Exposure below 50% - strategy mostly flat' END,
         CASE WHEN util * 100 > 90 THEN 'Exposure above 90% - little crash protection' END,
         CASE WHEN trade_frequency_stability < 5e-1 THEN 'Trade frequency unstable vs expected' END) AS warnings,
       least(4e1, greatest(0e0, sharpe_30d * 20)) + greatest(0e0, 30 + current_drawdown) + 30 - abs(util * 100 - 70) * 3e-1 AS stability_score
       FROM stab_snap""")
def _(t):
    return stability.stability_report(gated(t)).selectExpr("* EXCEPT (warnings)", "array_join(warnings, '; ') AS warnings")


def runs_sql(source: str) -> str:
    return f"""SELECT symbol, run_id, regime, min(date) AS start_date, max(date) AS end_date, count(*) AS duration FROM (
  SELECT *, sum(s) OVER {RUN} AS run_id FROM (SELECT *, CASE WHEN regime = lag(regime) OVER {W} THEN 0 ELSE 1 END AS s FROM {source}) a) b GROUP BY 1, 2, 3"""


def durations_sql(source: str) -> str:
    return f"""SELECT symbol, regime, avg(duration) AS avg_duration, coalesce(stddev_pop(duration), 0e0) AS std_duration, min(duration) AS min_duration,
  max(duration) AS max_duration, count(*) AS occurrences, sum(duration) AS total_days FROM ({runs_sql(source)}) r GROUP BY 1, 2"""


@query("regime_runs", "symbol run_id:i regime start_date end_date duration:i", runs_sql("strategy_daily"))
def _(t):
    return persistence.regime_runs(vol_gate(t.bars))


@query("regime_durations", "symbol regime avg_duration:6 std_duration:6 min_duration:i max_duration:i occurrences:i total_days:i",
       durations_sql("strategy_daily"))
def _(t):
    return persistence.regime_durations(vol_gate(t.bars))


@query("regime_transitions", "symbol from_state to_state n:i p:6",
       f"""SELECT symbol, from_state, to_state, n, coalesce(n * 1e0 / nullif(sum(n) OVER (PARTITION BY symbol, from_state), 0), 0e0) AS p FROM (
       SELECT g.symbol, g.from_state, g.to_state, count(s.symbol) AS n FROM
         (SELECT DISTINCT a.symbol, a.regime AS from_state, b.regime AS to_state FROM (SELECT DISTINCT symbol, regime FROM strategy_daily) a
          JOIN (SELECT DISTINCT symbol, regime FROM strategy_daily) b USING (symbol)) g
         LEFT JOIN (SELECT symbol, lag(regime) OVER {W} AS f, regime AS t FROM strategy_daily) s
         ON s.symbol = g.symbol AND s.f = g.from_state AND s.t = g.to_state GROUP BY 1, 2, 3) c""")
def _(t):
    return persistence.transitions(vol_gate(t.bars))


V["gate_split"] = f"""SELECT *, CASE WHEN row_number() OVER {W} <= floor(count(*) OVER (PARTITION BY symbol) * 7e-1) THEN 'train' ELSE 'test' END AS split FROM strategy_daily"""
V["gate_train"] = "SELECT * FROM gate_split WHERE split = 'train'"
V["gate_test"] = "SELECT * FROM gate_split WHERE split = 'test'"
V["drift_rows"] = f"""SELECT symbol, regime, c.avg_duration, b.avg_duration AS baseline_duration, (c.avg_duration - b.avg_duration) / b.avg_duration AS drift
  FROM ({durations_sql('gate_test')}) c JOIN ({durations_sql('gate_train')}) b USING (symbol, regime)"""


def halves(t):
    split = time_split(vol_gate(t.bars), 0.7)
    return split.where("split = 'train'"), split.where("split = 'test'")


@query("duration_drift", "symbol regime avg_duration:6 baseline_duration:6 drift:6 significant:b", "SELECT *, abs(drift) > 3e-1 AS significant FROM drift_rows")
def _(t):
    old, new = halves(t)
    return persistence.duration_drift(persistence.regime_durations(new), persistence.regime_durations(old))


def ent_sql(c):
    p = f"least(greatest({c}, 1e-10), 1 - 1e-10)"
    return f"avg(-{p} * log2({p}) - (1 - {p}) * log2(1 - {p}))"


V["entropy_rows"] = f"SELECT symbol, ({ent_sql('prob_up')} + {ent_sql('confidence')}) / 2 AS entropy FROM preds GROUP BY symbol"
V["cluster_rows"] = """SELECT symbol, (count(*) FILTER (prob_up < 1e-1 OR prob_up > 9e-1) + count(*) FILTER (confidence < 1e-1 OR confidence > 9e-1)) * 1e0
  / (count(prob_up) + count(confidence)) AS clustering FROM preds GROUP BY symbol"""
V["spear_pairs"] = """SELECT symbol, c.regime AS c, h.regime AS h FROM (SELECT symbol, regime, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM gate_test) c
  JOIN (SELECT symbol, regime, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM gate_train) h USING (symbol, back)"""
V["spear_rows"] = """SELECT symbol, coalesce(covar_samp(rc, rh) / nullif(stddev_samp(rc) * stddev_samp(rh), 0), 0e0) AS correlation FROM (
  SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY c) + (count(*) OVER (PARTITION BY symbol, c) - 1) / 2e0 AS rc,
         rank() OVER (PARTITION BY symbol ORDER BY h) + (count(*) OVER (PARTITION BY symbol, h) - 1) / 2e0 AS rh FROM spear_pairs) r GROUP BY symbol"""
V["decay_rows"] = """SELECT symbol, entropy, clustering, coalesce(dd.duration_drift, 0e0) AS duration_drift, coalesce(correlation, 1e0) AS correlation,
  ((1 - least(entropy, 1e0)) + clustering + coalesce(dd.duration_drift, 0e0) + (1 - greatest(coalesce(correlation, 1e0), 0e0))) / 4 AS overall_risk
  FROM entropy_rows JOIN cluster_rows USING (symbol) LEFT JOIN (SELECT symbol, avg(abs(drift)) AS duration_drift FROM drift_rows GROUP BY symbol) dd USING (symbol)
  LEFT JOIN spear_rows USING (symbol)"""
V["decay_alert_rows"] = """SELECT symbol, 'entropy_collapse' AS alert_type, 'WARNING' AS severity, entropy AS current_value, 3e-1 AS threshold FROM decay_rows WHERE entropy < 3e-1
  UNION ALL SELECT symbol, 'probability_clustering', 'WARNING', clustering, 8e-1 FROM decay_rows WHERE clustering > 8e-1
  UNION ALL SELECT symbol, 'duration_drift', 'CRITICAL', duration_drift, 3e-1 FROM decay_rows WHERE duration_drift > 3e-1
  UNION ALL SELECT symbol, 'correlation_drift', 'CRITICAL', correlation, 5e-1 FROM decay_rows WHERE correlation < 5e-1"""


@query("prediction_entropy", "symbol entropy:6", "SELECT * FROM entropy_rows")
def _(t):
    return decay.entropy(t.preds, ["prob_up", "confidence"])


@query("probability_clustering", "symbol clustering:6", "SELECT * FROM cluster_rows")
def _(t):
    return decay.probability_clustering(t.preds, ["prob_up", "confidence"])


@query("label_rank_correlation", "symbol correlation:6", "SELECT * FROM spear_rows")
def _(t):
    old, new = halves(t)
    return decay.label_correlation(new, old)


def status(t):
    old, new = halves(t)
    return decay.decay_status(t.preds, ["prob_up", "confidence"], persistence.regime_durations(new),
                              persistence.regime_durations(old), new, old)


@query("decay_status", "symbol entropy:6 clustering:6 duration_drift:6 correlation:6 overall_risk:6 n_alerts:i is_healthy:b",
       """SELECT d.*, coalesce(n, 0) AS n_alerts, coalesce(n, 0) = 0 AS is_healthy FROM decay_rows d
       LEFT JOIN (SELECT symbol, count(*) AS n FROM decay_alert_rows GROUP BY symbol) a USING (symbol)""")
def _(t):
    return status(t).selectExpr("*", "size(alerts) AS n_alerts")


@query("decay_alerts", "symbol alert_type severity current_value:6 threshold:6", "SELECT * FROM decay_alert_rows")
def _(t):
    return decay.decay_alerts(status(t))


V["gov_base"] = f"""SELECT *, {sharpe_sql('ret', 126)} AS sharpe_6m, {sharpe_sql('ret', 30)} AS s30, count(ret) OVER {frame(30)} = 30 AS warm,
  count(ret) OVER {frame(126)} = 126 AS warm6, eq / max(eq) OVER {RUN} - 1 AS drawdown,
  CAST(sum(CASE WHEN trig THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS triggers_30d
  FROM (SELECT symbol, date, sret AS ret, product(1 + sret) OVER {RUN} AS eq, coalesce(regime = 'HOSTILE' AND lag(regime) OVER {W} <> 'HOSTILE', false) AS trig FROM gate_curves) x"""
V["gov_weak"] = f"""SELECT *, sum(CASE WHEN warm AND s30 < 5e-1 THEN 0 ELSE 1 END) OVER {RUN} AS island FROM gov_base"""
V["gov_rows"] = """SELECT *, sum(CASE WHEN warm AND s30 < 5e-1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, island ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weak_days FROM gov_weak"""


@query("governance_flags",
       "symbol date sharpe_6m:6 drawdown:6 triggers_30d:i weak_days:i flag_sharpe_6m flag_drawdown_25 flag_triggers flag_weak_sharpe flag_drawdown_15",
       """SELECT *, warm6 AND sharpe_6m < 0 AS flag_sharpe_6m, drawdown < -25e-2 AS flag_drawdown_25, triggers_30d >= 3 AS flag_triggers,
       weak_days >= 30 AS flag_weak_sharpe, drawdown < -15e-2 AS flag_drawdown_15 FROM gov_rows""")
def _(t):
    df = gated(t).selectExpr(
        "*", "coalesce(regime = 'HOSTILE' AND lag(regime) OVER (PARTITION BY symbol ORDER BY date) <> 'HOSTILE', false) AS is_trigger")
    return decay.governance_flags(df)
