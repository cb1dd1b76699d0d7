"""Option overlay, margin, and stream monitor queries (the monitors as their batch twins)."""

from __future__ import annotations

import math

from barloom.operators import killswitch, margin, options, regimes
from barloom.operators.regimes import vol_gate
from barloom.sources.options import normalize_chain
from barloom.streaming import monitors
from workloads.oracle import ORACLE_VIEWS as V
from workloads.q_operations import both_decisions
from workloads.registry import query
from workloads.sqlkit import RUN, W

V["quotes"] = "SELECT *, date_diff('day', as_of, expiration) AS days FROM option_quotes"


def picked_sql(cond: str, target: str, extra: str) -> str:
    return f"""SELECT underlying, as_of, expiration, days AS dte, strike, underlying_price, {extra} FROM (
    SELECT *, row_number() OVER (PARTITION BY underlying ORDER BY abs(strike - {target}), strike) AS rk FROM quotes q WHERE {cond}) x WHERE rk = 1"""


V["call_exp"] = """SELECT underlying, coalesce(min(expiration) FILTER (days BETWEEN 7 AND 30), min(expiration) FILTER (days <= 30)) AS e FROM quotes GROUP BY 1"""
V["put_exp"] = "SELECT underlying, min(expiration) FILTER (days >= 21) AS e FROM quotes GROUP BY 1"
V["call_picks"] = picked_sql("option_type = 'call' AND strike > underlying_price AND (underlying, expiration) IN (SELECT (underlying, e) FROM call_exp)",
                             "underlying_price * (1 + 3e-1 * 1e-1)", "CASE WHEN bid > 0 THEN bid ELSE last * 95e-2 END AS premium")
V["put_picks"] = picked_sql("option_type = 'put' AND (underlying, expiration) IN (SELECT (underlying, e) FROM put_exp)",
                            "underlying_price * (1 - 3e-1 * 15e-2)", "CASE WHEN bid > 0 THEN (ask + bid) / 2 ELSE ask END AS cost")


def quotes(t):
    return normalize_chain(t.option_quotes)


@query("option_pick_call", "underlying expiration dte:i strike:2 premium:6", "SELECT * FROM call_picks")
def _(t):
    return options.pick_call(quotes(t))


@query("option_pick_put", "underlying expiration dte:i strike:2 cost:6", "SELECT * FROM put_picks")
def _(t):
    return options.pick_put(quotes(t))


@query("option_pick_atm", "underlying expiration option_type strike:2 bid:6 ask:6",
       """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY underlying, expiration, option_type ORDER BY abs(strike - underlying_price), strike) AS rk FROM quotes) x WHERE rk = 1""")
def _(t):
    return options.pick_atm(quotes(t))


@query("iv_surface", "underlying expiration dte:i strike:2 moneyness:6 iv:6 option_type",
       """SELECT *, days AS dte, strike / underlying_price AS moneyness FROM (SELECT *, dense_rank() OVER (PARTITION BY underlying ORDER BY expiration) AS dr FROM quotes) x WHERE dr <= 6""")
def _(t):
    return options.iv_surface(quotes(t))


MOVES = [-0.2, -0.1, -0.05, -0.02, 0.0, 0.02, 0.05, 0.1, 0.2]
_moves = "(SELECT unnest([-2e-1, -1e-1, -5e-2, -2e-2, 0e0, 2e-2, 5e-2, 1e-1, 2e-1]) AS m) mv"
V["cc_pos"] = "SELECT underlying, 200 AS shares, underlying_price AS cost, strike AS call_strike, premium * 200 AS call_premium FROM call_picks"


@query("covered_call_positions", "underlying shares:i call_strike:2 call_premium:6 max_profit:6 breakeven:6",
       "SELECT *, call_premium + (call_strike - cost) * shares AS max_profit, cost - call_premium / 200 AS breakeven FROM cc_pos")
def _(t):
    return options.open_covered_calls(options.pick_call(quotes(t)), 200)


@query("covered_call_grid", "underlying underlying_return:3 covered_return:6 assigned upside_capped:4",
       f"""SELECT *, (CASE WHEN assigned THEN (call_strike - cost) * shares ELSE (f - cost) * shares END + call_premium) / (cost * shares) AS covered_return,
       CASE WHEN assigned THEN (f - call_strike) * shares ELSE 0e0 END AS upside_capped FROM (
       SELECT *, m AS underlying_return, cost * (1 + m) AS f, cost * (1 + m) >= call_strike AS assigned FROM cc_pos, {_moves}) x""")
def _(t):
    return options.covered_call_grid(options.open_covered_calls(options.pick_call(quotes(t)), 200), MOVES)


V["pp_pos"] = "SELECT underlying, 200 AS shares, strike AS put_strike, cost * 200 AS put_cost, (underlying_price - strike) / underlying_price AS protection_level FROM put_picks"


@query("protective_put_grid", "underlying underlying_return:3 protected_return:6 max_loss:6 put_pnl:6 total_cost_pct:6",
       f"""SELECT *, ((f - i) * shares + pp) / (i * shares) AS protected_return, ((put_strike - i) * shares - put_cost) / (i * shares) AS max_loss,
       pp / (i * shares) AS put_pnl, put_cost / (i * shares) AS total_cost_pct FROM (
       SELECT *, CASE WHEN f < put_strike THEN (put_strike - f) * shares ELSE 0e0 END - put_cost AS pp FROM (
       SELECT *, m AS underlying_return, put_strike / (1 - protection_level) AS i, put_strike / (1 - protection_level) * (1 + m) AS f FROM pp_pos, {_moves}) x) y""")
def _(t):
    return options.protective_put_grid(options.open_protective_puts(options.pick_put(quotes(t)), 200), MOVES)


V["condors"] = """SELECT *, short_put_strike - 5 AS long_put_strike, short_call_strike + 5 AS long_call_strike, 2 * sqrt(dte / 30e0) * 100 AS premium_received,
  500 - 2 * sqrt(dte / 30e0) * 100 AS max_loss FROM (SELECT underlying, underlying_price, dte, round_even(underlying_price * 95e-2, 0) AS short_put_strike, round_even(underlying_price * 105e-2, 0) AS short_call_strike FROM (
  SELECT underlying, max(underlying_price) AS underlying_price, min(days) FILTER (days BETWEEN 14 AND 45) AS dte FROM quotes GROUP BY 1) a WHERE dte IS NOT NULL) b"""


@query("condor_positions", "underlying dte:i short_put_strike:1 long_put_strike:1 short_call_strike:1 long_call_strike:1 premium_received:6 max_loss:6", "SELECT * FROM condors")
def _(t):
    return options.open_condors(quotes(t))


@query("condor_eligibility", "symbol date eligible reason",
       """SELECT *, reason = 'Conditions suitable' AS eligible FROM (SELECT symbol, date, CASE WHEN vix > 20 THEN concat('VIX too high: ', printf('%.1f', vix), ' > 20')
       WHEN state_name NOT IN ('NEUTRAL', 'FAVORABLE', 'RISK_ON') THEN concat('Regime not suitable: ', state_name) WHEN ivp > 5e-1 THEN 'IV percentile' ELSE 'Conditions suitable' END AS reason FROM (
       SELECT symbol, date, state_name, volume AS vix, percent_rank() OVER (PARTITION BY symbol ORDER BY high - low) AS ivp FROM lattice_rows) x) y""")
def _(t):
    df = regimes.lattice(regimes.label_regimes(t.bars)).selectExpr(
        "symbol", "date", "state_name", "volume AS vix", "percent_rank() OVER (PARTITION BY symbol ORDER BY high - low) AS ivp")
    out = options.condor_eligible(df, "vix", "state_name", "ivp")
    return out.selectExpr("* EXCEPT (reason)", "IF(reason LIKE 'IV percentile%', 'IV percentile', reason) AS reason")


@query("condor_grid", "underlying move:3 pnl:6 pnl_pct:6 breached breach_side",
       f"""SELECT *, pnl / (max_loss + premium_received) AS pnl_pct, breach_side IS NOT NULL AS breached FROM (SELECT *, m AS move, CASE WHEN f <= long_put_strike THEN -max_loss
       WHEN f <= short_put_strike THEN premium_received - (short_put_strike - f) * 100 WHEN f >= long_call_strike THEN -max_loss
       WHEN f >= short_call_strike THEN premium_received - (f - short_call_strike) * 100 ELSE premium_received END AS pnl,
       CASE WHEN f <= short_put_strike THEN 'put' WHEN f >= short_call_strike THEN 'call' END AS breach_side FROM (SELECT *, underlying_price * (1 + m) AS f FROM condors, {_moves}) x) y""")
def _(t):
    return options.condor_grid(options.open_condors(quotes(t)), MOVES)


def cdf_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2e0))"
    u = f"(1e0 / (1e0 + 3275911e-7 * {x}))"
    poly = f"(((((1061405429e-9 * {u} + -1453152027e-9) * {u} + 1421413741e-9) * {u} + -284496736e-9) * {u} + 254829592e-9) * {u})"
    return f"(5e-1 * (1 + CASE WHEN {z} >= 0 THEN 1e0 ELSE -1e0 END * (1 - {poly} * exp(-{x} * {x}))))"


@query("condor_probability_of_profit", "underlying probability_of_profit:6",
       f"""SELECT underlying, {cdf_sql('pz')} * {cdf_sql('cz')} AS probability_of_profit FROM (SELECT underlying, (mid - short_put_strike) / mv AS pz, (short_call_strike - mid) / mv AS cz FROM (
       SELECT *, mid * 25e-2 / sqrt(252e0) * sqrt(dte * 1e0) AS mv FROM (SELECT *, (short_put_strike + short_call_strike) / 2 AS mid FROM condors) a) b) c""")
def _(t):
    return options.condor_pop(options.open_condors(quotes(t)), "0.25D")


V["overlay_in"] = """SELECT symbol, date, ret, CASE state_name WHEN 'HOSTILE' THEN 'RISK_OFF' WHEN 'FAVORABLE' THEN 'RISK_ON' ELSE 'NEUTRAL' END AS signal
  FROM lattice_rows JOIN (SELECT symbol, date, ret FROM strategy_daily) s USING (symbol, date)"""


def overlay(t):
    gate = vol_gate(t.bars).select("symbol", "date", "ret")
    return regimes.lattice(regimes.label_regimes(t.bars)).join(gate, ["symbol", "date"]).selectExpr(
        "symbol", "date", "ret", "CASE state_name WHEN 'HOSTILE' THEN 'RISK_OFF' WHEN 'FAVORABLE' THEN 'RISK_ON' ELSE 'NEUTRAL' END AS signal")


@query("covered_call_overlay", "symbol total_return:4 calls_sold:i times_assigned:i upside_given_up:4 premiums_collected:4 net_return:4 avg_premium:4",
       f"""SELECT *, total_return + premiums_collected - upside_given_up AS net_return, premiums_collected / greatest(1, times_assigned + 1) AS avg_premium FROM (
       SELECT symbol, total_return, calls_sold, times_assigned, upside_given_up, calls_sold * premium * 100 AS premiums_collected FROM (
       SELECT symbol, sum(ret) * 10000 AS total_return, count(*) FILTER (held AND NOT coalesce(was, false)) AS calls_sold, count(*) FILTER (held AND ret > 1e-2) AS times_assigned,
       coalesce(sum(ret - 5e-3) FILTER (held AND ret > 1e-2), 0e0) * 10000 AS upside_given_up FROM (
       SELECT *, lag(held) OVER {W} AS was FROM (SELECT *, signal = 'RISK_ON' AS held FROM overlay_in) a) b GROUP BY symbol) c JOIN call_picks ON underlying = symbol) d""")
def _(t):
    premiums = options.open_covered_calls(options.pick_call(quotes(t))).selectExpr("underlying AS symbol", "call_premium AS premium")
    return options.overlay_calls(overlay(t), premiums, 100, 0.01, 0.005)


@query("protective_put_overlay", "symbol total_return:4 protection_events:i put_costs:4 protected_losses:4 net_return:4 cost_per_protection:4",
       f"""SELECT *, total_return - put_costs AS net_return, put_costs / greatest(1, protection_events) AS cost_per_protection FROM (
       SELECT symbol, sum(ret) * 10000 AS total_return, count(*) FILTER (held = 1 AND was = 0) AS protection_events, count(*) FILTER (held = 1 AND was = 0) * max(put_cost) AS put_costs,
       coalesce(sum(ret - greatest(ret, -lvl)) FILTER (held = 1 AND ret < -1e-2), 0e0) * 10000 AS protected_losses FROM (
       SELECT *, lag(held, 1, 0) OVER {W} AS was FROM (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER {RUN}, 0) AS held FROM (
         SELECT *, CASE signal WHEN 'RISK_OFF' THEN 1 WHEN 'RISK_ON' THEN 0 END AS s FROM overlay_in) a) b) c
       JOIN (SELECT underlying AS symbol, cost * 100 AS put_cost, (underlying_price - strike) / underlying_price / 5 AS lvl FROM put_picks) p USING (symbol) GROUP BY symbol) d""")
def _(t):
    costs = options.open_protective_puts(options.pick_put(quotes(t))).selectExpr("underlying AS symbol", "put_cost", "protection_level / 5 AS protection_level")
    return options.overlay_puts(overlay(t), costs, 100, -0.01)


V["mg"] = """SELECT *, CASE position_type WHEN 'long_call' THEN p WHEN 'covered_call' THEN n * 5e-1 WHEN 'protective_put' THEN n * 5e-1 + p WHEN 'short_call' THEN n * 2e-1 + p + greatest(0e0, underlying_price - strike) * 100
    WHEN 'short_put' THEN greatest(n * 1e-1, n * 2e-1 + p - greatest(0e0, strike - underlying_price) * 100) WHEN 'iron_condor' THEN 500 - p ELSE n END AS initial_margin,
  CASE position_type WHEN 'long_call' THEN 0e0 WHEN 'short_call' THEN (n * 2e-1 + p + greatest(0e0, underlying_price - strike) * 100) * 8e-1
    WHEN 'short_put' THEN greatest(n * 1e-1, n * 2e-1 + p - greatest(0e0, strike - underlying_price) * 100) * 8e-1 WHEN 'iron_condor' THEN 500e0 ELSE n * 25e-2 END AS maintenance_margin,
  CASE position_type WHEN 'long_call' THEN p WHEN 'covered_call' THEN n * 5e-1 - p WHEN 'protective_put' THEN n * 5e-1 + p WHEN 'short_call' THEN n * 2e-1 + p + greatest(0e0, underlying_price - strike) * 100
    WHEN 'short_put' THEN greatest(n * 1e-1, n * 2e-1 + p - greatest(0e0, strike - underlying_price) * 100) WHEN 'iron_condor' THEN 500e0 ELSE n END AS buying_power_impact
  FROM (SELECT *, underlying_price * 100 AS n, premium * 100 AS p FROM option_positions) x"""


@query("margin_requirements", "account_id opened l_orderkey l_linenumber position_type initial_margin:4 maintenance_margin:4 buying_power_impact:4", "SELECT * FROM mg")
def _(t):
    return margin.margin(t.option_positions)


@query("account_margin", "account_id positions:i margin_used:2 maintenance_required:2 margin_ratio:6 maintenance_excess:2 margin_call:2 shocked_ratio:6",
       """SELECT account_id, count(*) AS positions, sum(initial_margin) AS margin_used, sum(maintenance_margin) AS maintenance_required, sum(initial_margin) / 1e6 AS margin_ratio,
       1e6 - sum(initial_margin) - 5e3 AS maintenance_excess, greatest(0e0, sum(maintenance_margin) - 1e6) AS margin_call, sum(initial_margin) * 11e-1 / 1e6 AS shocked_ratio FROM mg GROUP BY 1""")
def _(t):
    return margin.account_margin(margin.margin(t.option_positions), 1_000_000.0, shock=0.1)


ADM = "opened, l_orderkey, l_partkey, l_linenumber, l_quantity, initial_margin"


@query("margin_admission", "account_id opened l_orderkey l_partkey l_linenumber margin_so_far:4 allowed",
       f"""SELECT *, margin_so_far / 1e6 <= 6e-1 AND 1e6 - margin_so_far >= 5e3 AS allowed FROM (
       SELECT *, sum(initial_margin) OVER (PARTITION BY account_id ORDER BY {ADM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS margin_so_far FROM mg) x""")
def _(t):
    return margin.admission(margin.margin(t.option_positions), ADM.split(", "), "CAST(date_format(opened, 'yyyyMM') AS INT)", 1_000_000.0)


@query("assignment_risk", "account_id l_orderkey l_linenumber option_type assignment_probability:6 risk cash_impact:4",
       """SELECT *, CASE WHEN option_type = 'call' THEN 1 ELSE -1 END * strike * 100 AS cash_impact, CASE WHEN NOT is_short THEN 'Long options cannot be assigned' WHEN itm <= 0 THEN concat(upper(option_type[1]), option_type[2:], ' is OTM')
       WHEN assignment_probability > 5e-1 THEN 'high' ELSE 'moderate' END AS risk FROM (
       SELECT *, CASE WHEN NOT is_short OR itm <= 0 THEN 0e0 ELSE least(CASE option_type WHEN 'call' THEN 95e-2 ELSE 9e-1 END, itm / underlying_price * CASE option_type WHEN 'call' THEN 10 ELSE 8 END * greatest(1e-1, 1 - dte / 30e0)) END AS assignment_probability
       FROM (SELECT *, CASE option_type WHEN 'call' THEN underlying_price - strike ELSE strike - underlying_price END AS itm FROM option_positions) a) b""")
def _(t):
    return options.assignment_risk(t.option_positions)


# ---- stream monitors, batch twins ----

V["ks_day"] = """SELECT *, (equity - s) / s * 100 AS daily_pnl_pct FROM (SELECT *, first_value(equity) OVER (PARTITION BY account_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS s FROM account_events) x"""
V["ks_early"] = "SELECT *, CASE WHEN daily_pnl_pct < -3 THEN 'daily_loss' WHEN confidence < 3e-1 THEN 'confidence_collapse' END AS early FROM ks_day"
V["ks_late"] = """SELECT *, CASE WHEN NOT api_success THEN row_number() OVER (PARTITION BY account_id, g ORDER BY ts, event_id) - CASE WHEN g = 0 THEN 0 ELSE 1 END ELSE 0 END AS errors FROM (
  SELECT *, sum(CASE WHEN api_success THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM ks_early WHERE early IS NULL) x"""
V["ks_all"] = """SELECT account_id, event_id, ts, daily_pnl_pct, early AS kind FROM ks_early WHERE early IS NOT NULL UNION ALL
  SELECT account_id, event_id, ts, daily_pnl_pct, CASE WHEN errors >= 3 THEN 'api_error' WHEN abs(slippage_bps) > 15 THEN 'slippage_breach'
  WHEN abs(position - expected_position) > greatest(1e0, abs(expected_position) * 5e-2) THEN 'unexpected_position' END FROM ks_late"""
V["ks_rows"] = """SELECT *, CASE WHEN halted THEN NULL ELSE kind END AS switch_type, CASE WHEN halted OR kind IN ('api_error', 'slippage_breach') THEN 'halt' WHEN kind IS NOT NULL THEN 'flatten' ELSE 'none' END AS action,
  halted OR kind IS NOT NULL AS triggered FROM (SELECT *, coalesce(sum(CASE WHEN kind IN ('api_error', 'slippage_breach') THEN 1 ELSE 0 END) OVER
  (PARTITION BY account_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS halted FROM ks_all) x"""


@query("kill_switch_actions", "account_id event_id ts daily_pnl_pct:6 switch_type action triggered halted", "SELECT * FROM ks_rows")
def _(t):
    return killswitch.kill_switch(t.account_events)


@query("kill_switch_by_account", "account_id events:i triggered:i flattened:i halted_at",
       "SELECT account_id, count(*) AS events, count(*) FILTER (triggered) AS triggered, count(*) FILTER (action = 'flatten') AS flattened, min(ts) FILTER (action = 'halt') AS halted_at FROM ks_rows GROUP BY 1")
def _(t):
    return killswitch.kill_switch_counts(killswitch.kill_switch(t.account_events))


@query("signals_deduplicated", "client_order_id symbol day side signal_id", "SELECT DISTINCT client_order_id, symbol, day, side, signal_id FROM order_ids")
def _(t):
    return monitors.dedupe_signals(t.signals)


@query("fill_monitor_daily", "day fills:i avg_slippage_bps:6 max_slippage_bps:6 breach",
       "SELECT CAST(fill_ts AS DATE) AS day, count(*) AS fills, avg(slippage_bps) AS avg_slippage_bps, greatest(max(slippage_bps), 0e0) AS max_slippage_bps, max(slippage_bps) > 50 AS breach FROM slip GROUP BY 1")
def _(t):
    return monitors.fill_monitor(t.fills)


@query("request_rate_breach", "account_id event_id ts requests_in_span:i",
       """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY account_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS requests_in_span FROM account_events) x WHERE requests_in_span > 4""")
def _(t):
    return monitors.rate_breach(t.account_events, 4, 86400)


@query("request_rate_windows", "account_id window_start requests:i",
       """SELECT account_id, make_timestamp(w * 10000000) AS window_start, count(*) AS requests FROM (
       SELECT account_id, unnest(range(epoch_us(ts) // 10000000 - 5, epoch_us(ts) // 10000000 + 1)) AS w FROM account_events) x GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    return monitors.rate_windows(t.account_events, 1)


@query("signal_counts_daily", "day signal route n:i", "SELECT day, signal, CASE WHEN signal = 'HOLD' THEN 'recorded' ELSE 'order' END AS route, count(*) AS n FROM signals GROUP BY 1, 2")
def _(t):
    return monitors.signal_counts(t.signals)


@query("decision_stream_join", "symbol expected_ts actual_ts expected_action actual_action is_aligned",
       "SELECT symbol, CAST(date AS TIMESTAMP) AS expected_ts, CAST(date AS TIMESTAMP) AS actual_ts, expected_action, actual_action, is_aligned FROM dec_match")
def _(t):
    return monitors.recon_stream(*both_decisions(t))
