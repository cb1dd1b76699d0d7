"""Derived views in DuckDB SQL: what the library's operators should produce, written independently."""

from __future__ import annotations

from workloads.sqlkit import W, change, div, frame, lag, lead, roll, roll_q, sdiv

ORACLE_VIEWS: dict[str, str] = {}
V = ORACLE_VIEWS

V["px_ret"] = f"""SELECT *, {change('close', 1)} AS r1, {lag('close')} AS pc FROM bars"""

V["px_tr"] = """SELECT *, close - pc AS delta, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
  CASE WHEN close - pc > 0 THEN close - pc ELSE 0e0 END AS gain,
  CASE WHEN close - pc < 0 THEN pc - close ELSE 0e0 END AS loss FROM px_ret"""

V["gate_vol_rows"] = f"""SELECT *, r1 AS ret, {roll('stddev_samp', 'r1', 20)} AS gate_vol FROM px_ret WHERE r1 IS NOT NULL"""
V["gate_cut"] = """SELECT symbol, quantile_cont(gate_vol, 0.7) AS gate_threshold FROM gate_vol_rows GROUP BY symbol"""
V["strategy_daily"] = """SELECT g.*, gate_threshold, CASE WHEN gate_vol < gate_threshold THEN 1 ELSE 0 END AS position,
  CASE WHEN gate_vol > gate_threshold THEN 'HOSTILE' ELSE 'NEUTRAL' END AS regime
  FROM gate_vol_rows g JOIN gate_cut USING (symbol)"""

V["adx_moves"] = f"""SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0e0 END AS plus_dm,
  CASE WHEN down > up AND down > 0 THEN down ELSE 0e0 END AS minus_dm
  FROM (SELECT *, high - {lag('high')} AS up, {lag('low')} - low AS down FROM px_tr) m"""
V["adx_index"] = f"""SELECT *, 100 * ({roll('avg', 'plus_dm', 14)}) / nullif({roll('avg', 'tr', 14)}, 0) AS pdi,
  100 * ({roll('avg', 'minus_dm', 14)}) / nullif({roll('avg', 'tr', 14)}, 0) AS mdi FROM adx_moves"""
V["adx_dx"] = """SELECT *, 100 * abs(pdi - mdi) / CASE WHEN pdi + mdi = 0 THEN 1e0 ELSE pdi + mdi END AS dx FROM adx_index"""
V["adx_rows"] = f"""SELECT *, coalesce({roll('avg', 'dx', 14)}, 0e0) AS adx,
  {div('abs(r1)', 'close * volume')} AS illiq FROM adx_dx"""
V["fwd_base"] = f"""SELECT *, {roll('stddev_samp', 'r1', 5)} AS v5, {roll('min', 'low', 5)} AS l5,
  {roll('avg', 'illiq', 5)} AS a5 FROM adx_rows"""
V["fwd_rows"] = f"""SELECT symbol, date, open, high, low, close, volume, {lead('v5', 5)} * sqrt(252e0) AS future_vol,
  ({lead('l5', 5)} - close) / close AS future_drawdown, {lead('adx', 5)} AS future_adx, {lead('a5', 5)} AS future_amihud
  FROM fwd_base"""
V["label_q"] = f"""SELECT *, {roll_q('future_vol', 0.75, 252)} AS q_vol, {roll_q('future_amihud', 0.85, 252)} AS q_liq FROM fwd_rows"""
V["label_thr"] = """SELECT *, first_value(q_vol IGNORE NULLS) OVER f AS vol_threshold, first_value(q_liq IGNORE NULLS) OVER f AS liq_threshold
  FROM label_q WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
V["label_rows"] = """SELECT symbol, date, open, high, low, close, volume,
  CASE WHEN coalesce(future_vol > vol_threshold, false) OR coalesce(future_drawdown < -5e-2, false) THEN 1 ELSE 0 END AS regime_vol,
  CASE WHEN future_adx > 25 THEN 1 ELSE 0 END AS regime_trend,
  CASE WHEN future_amihud > liq_threshold THEN 1 ELSE 0 END AS regime_liq FROM label_thr"""
V["lattice_rows"] = """SELECT *, CASE WHEN regime_vol = 1 OR regime_liq = 1 THEN 0 WHEN regime_trend = 1 THEN 2 ELSE 1 END AS lattice_state,
  CASE WHEN regime_vol = 1 OR regime_liq = 1 THEN 'HOSTILE' WHEN regime_trend = 1 THEN 'FAVORABLE' ELSE 'NEUTRAL' END AS state_name
  FROM label_rows"""
