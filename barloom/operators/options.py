"""Option overlays as position tables and scenario grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions import rolling as R
from barloom.functions.text import grid, normal_cdf
from barloom.operators.persistence import number_runs

_KEY = ["underlying", "as_of"]
_DTE = "datediff(expiration, as_of)"


def _first_expiry(quotes: DataFrame, choice: str) -> DataFrame:
    """Quotes of the first expiry that ``choice`` (an aggregate over ``expiration`` and dte) selects."""
    chosen = quotes.groupBy(*_KEY).agg(F.expr(f"{choice} AS _exp")).where("_exp IS NOT NULL")
    return quotes.join(chosen, _KEY).where("expiration = _exp").drop("_exp")


def _nearest(quotes: DataFrame, target: str, fields: list[str]) -> DataFrame:
    """The quote with the strike nearest to ``target``; the lower strike wins a tie. A plain aggregate, no sort."""
    row = f"struct(expiration, {_DTE} AS dte, strike, underlying_price, {', '.join(fields)})"
    picked = quotes.groupBy(*_KEY).agg(F.expr(f"min_by({row}, struct(abs(strike - {target}), strike)) AS _q"))
    return picked.select(*_KEY, "_q.*")


def pick_call(quotes: DataFrame, target_delta: float = 0.3, max_dte: int = 30, min_dte: int = 7) -> DataFrame:
    """Call to sell: first expiry in the band (else any within ``max_dte``), out of the money, near the target strike."""
    choice = (
        f"coalesce(min(IF({_DTE} BETWEEN {min_dte} AND {max_dte}, expiration, NULL)), min(IF({_DTE} <= {max_dte}, expiration, NULL)))"
    )
    calls = _first_expiry(quotes, choice).where("option_type = 'call' AND strike > underlying_price")
    return _nearest(calls, f"underlying_price * {1 + target_delta * 0.10!r}D", ["IF(bid > 0, bid, last * 0.95D) AS premium"])


def pick_put(quotes: DataFrame, target_delta: float = 0.3, min_dte: int = 21) -> DataFrame:
    """Put to buy: first expiry of at least ``min_dte`` days, near the target strike, at the mid price."""
    puts = _first_expiry(quotes, f"min(IF({_DTE} >= {min_dte}, expiration, NULL))").where("option_type = 'put'")
    return _nearest(puts, f"underlying_price * {1 - target_delta * 0.15!r}D", ["IF(bid > 0, (ask + bid) / 2, ask) AS cost"])


def pick_atm(quotes: DataFrame) -> DataFrame:
    """At-the-money call and put of every expiry."""
    row = "struct(strike, bid, ask, iv)"
    picked = quotes.groupBy(*_KEY, "expiration", "option_type").agg(
        F.expr(f"min_by({row}, struct(abs(strike - underlying_price), strike)) AS _q")
    )
    return picked.select(*_KEY, "expiration", "option_type", "_q.*")


def iv_surface(quotes: DataFrame, expiries: int = 6) -> DataFrame:
    """Implied volatility by moneyness and days to expiry over the first expiries of each underlying."""
    ranked = quotes.select(*_KEY, "expiration").distinct().selectExpr(
        "*", "row_number() OVER (PARTITION BY underlying, as_of ORDER BY expiration) AS _k"
    )
    near = ranked.where(f"_k <= {expiries}").drop("_k")
    return quotes.join(near, [*_KEY, "expiration"], "left_semi").selectExpr(
        *_KEY, "expiration", f"{_DTE} AS dte", "strike", "strike / underlying_price AS moneyness", "iv", "option_type"
    )


def open_covered_calls(picks: DataFrame, shares: int = 100) -> DataFrame:
    return picks.selectExpr(
        "underlying", f"{shares} AS shares", "underlying_price AS cost", "strike AS call_strike", "expiration AS call_expiration",
        f"premium * {shares // 100 * 100} AS call_premium",
        f"premium * {shares // 100 * 100} + (strike - underlying_price) * {shares} AS max_profit", "underlying_price - premium AS breakeven",
    )


def covered_call_grid(positions: DataFrame, returns: list[float]) -> DataFrame:
    """Payoff at expiry of every position in every return scenario."""
    df = positions.selectExpr("*", f"inline({grid([(float(r),) for r in returns], ['underlying_return'])})")
    df = df.selectExpr("*", "cost * (1 + underlying_return) AS _final").selectExpr("*", "_final >= call_strike AS assigned")
    return df.selectExpr(
        "* EXCEPT (_final)",
        "IF(assigned, (call_strike - cost) * shares + call_premium, (_final - cost) * shares + call_premium) / (cost * shares) AS covered_return",
        "IF(assigned, (_final - call_strike) * shares, 0D) AS upside_capped", "call_premium AS premium_kept",
    )


def open_protective_puts(picks: DataFrame, shares: int = 100) -> DataFrame:
    contracts = max(1, shares // 100)
    return picks.selectExpr(
        "underlying", f"{shares} AS shares", "strike AS put_strike", "expiration AS put_expiration", f"cost * {contracts * 100} AS put_cost",
        "(underlying_price - strike) / underlying_price AS protection_level",
    )


def protective_put_grid(positions: DataFrame, returns: list[float]) -> DataFrame:
    df = positions.selectExpr("*", f"inline({grid([(float(r),) for r in returns], ['underlying_return'])})")
    df = df.selectExpr("*", "put_strike / (1 - protection_level) AS _initial").selectExpr(
        "*", "_initial * (1 + underlying_return) AS _final", "_initial * shares AS _value"
    )
    df = df.selectExpr("*", "IF(_final < put_strike, (put_strike - _final) * shares, 0D) - put_cost AS _put")
    return df.selectExpr(
        "* EXCEPT (_initial, _final, _value, _put)", "((_final - _initial) * shares + _put) / _value AS protected_return",
        "((put_strike - _initial) * shares - put_cost) / _value AS max_loss", "_put / _value AS put_pnl", "put_cost / _value AS total_cost_pct",
    )


def open_condors(quotes: DataFrame, width: int = 5, contracts: int = 1, min_dte: int = 14, max_dte: int = 45) -> DataFrame:
    """Iron condors 5 % out of the money on both sides; strikes round half to even."""
    chosen = quotes.groupBy(*_KEY).agg(
        F.expr(f"min(IF({_DTE} BETWEEN {min_dte} AND {max_dte}, expiration, NULL)) AS expiration"), F.expr("max(underlying_price) AS underlying_price")
    ).where("expiration IS NOT NULL")
    df = chosen.selectExpr(
        "*", f"{_DTE} AS dte", "bround(underlying_price * 0.95D, 0) AS short_put_strike", "bround(underlying_price * 1.05D, 0) AS short_call_strike"
    )
    return df.selectExpr(
        "*", f"short_put_strike - {width} AS long_put_strike", f"short_call_strike + {width} AS long_call_strike",
        f"2 * sqrt(dte / 30D) * {contracts * 100} AS premium_received",
        f"{width * 100 * contracts} - 2 * sqrt(dte / 30D) * {contracts * 100} AS max_loss", f"{contracts} AS contracts",
    )


def condor_eligible(df: DataFrame, vix: str = "vix", regime: str = "regime", iv_percentile: str = "iv_percentile") -> DataFrame:
    """Whether conditions suit a condor, with the first reason against it."""
    reason = (
        f"CASE WHEN {vix} > 20 THEN concat('VIX too high: ', format_string('%.1f', {vix}), ' > 20') "
        f"WHEN {regime} NOT IN ('NEUTRAL', 'FAVORABLE', 'RISK_ON') THEN concat('Regime not suitable: ', {regime}) "
        f"WHEN {iv_percentile} > 0.5D THEN concat('IV percentile too high: ', format_string('%.0f', {iv_percentile} * 100), '% > 50%') "
        "ELSE 'Conditions suitable' END"
    )
    return df.selectExpr("*", f"{reason} AS reason").selectExpr("*", "reason = 'Conditions suitable' AS eligible")


def condor_grid(condors: DataFrame, moves: list[float]) -> DataFrame:
    """Profit at expiry by zone; a scenario is a move of the underlying."""
    df = condors.selectExpr("*", f"inline({grid([(float(m),) for m in moves], ['move'])})")
    df = df.selectExpr("*", "underlying_price * (1 + move) AS final_price", "(short_put_strike + short_call_strike) / 2 AS _mid")
    unit = "contracts * 100"
    df = df.selectExpr(
        "*", "(final_price - _mid) / _mid AS underlying_return",
        "CASE WHEN final_price <= long_put_strike THEN -max_loss "
        f"WHEN final_price <= short_put_strike THEN premium_received - (short_put_strike - final_price) * {unit} "
        "WHEN final_price >= long_call_strike THEN -max_loss "
        f"WHEN final_price >= short_call_strike THEN premium_received - (final_price - short_call_strike) * {unit} "
        "ELSE premium_received END AS pnl",
        "CASE WHEN final_price <= short_put_strike THEN 'put' WHEN final_price >= short_call_strike THEN 'call' END AS breach_side",
    )
    return df.selectExpr("* EXCEPT (_mid)", "pnl / (max_loss + premium_received) AS pnl_pct", "breach_side IS NOT NULL AS breached")


def condor_pop(condors: DataFrame, iv: str = "iv") -> DataFrame:
    """Probability of profit: the product of the normal probabilities of staying inside each short strike."""
    df = condors.selectExpr("*", "(short_put_strike + short_call_strike) / 2 AS _mid").selectExpr("*", f"_mid * {iv} / sqrt(252D) * sqrt(dte) AS _move")
    df = df.selectExpr("*", "(_mid - short_put_strike) / _move AS _pz", "(short_call_strike - _mid) / _move AS _cz")
    return df.selectExpr("* EXCEPT (_mid, _move, _pz, _cz)", f"{normal_cdf('_pz')} * {normal_cdf('_cz')} AS probability_of_profit")


def overlay_calls(df: DataFrame, premiums: DataFrame, shares: int = 100, big: float = 0.05, kept: float = 0.03) -> DataFrame:
    """Covered calls sold at the start of each RISK_ON spell. The moves for assignment are flat guesses, kept as published."""
    runs = number_runs(df.selectExpr("symbol", "date", "ret", "signal = 'RISK_ON' AS held"), "held")
    hit = f"held AND ret > {big}"
    agg = runs.groupBy("symbol").agg(
        F.expr(f"sum(ret) * {shares * 100} AS total_return"), F.expr("count(DISTINCT IF(held, run_id, NULL)) AS calls_sold"),
        F.expr(f"count_if({hit}) AS times_assigned"), F.expr(f"coalesce(sum(IF({hit}, ret - {kept}D, 0D)), 0D) * {shares * 100} AS upside_given_up"),
    )
    out = agg.join(premiums, "symbol").selectExpr("* EXCEPT (premium)", "calls_sold * premium AS premiums_collected")
    return out.selectExpr(
        "*", "total_return + premiums_collected - upside_given_up AS net_return",
        "premiums_collected / greatest(1, times_assigned + 1) AS avg_premium",
    )


def overlay_puts(df: DataFrame, costs: DataFrame, shares: int = 100, drop: float = -0.02) -> DataFrame:
    """Puts bought on RISK_OFF and held until RISK_ON; ``costs`` has ``put_cost`` and ``protection_level``."""
    state = "CASE signal WHEN 'RISK_OFF' THEN 1 WHEN 'RISK_ON' THEN 0 END"
    df = df.selectExpr("symbol", "date", "ret", f"{state} AS _s").selectExpr("*", f"coalesce({R.forward_fill('_s')}, 0) AS held")
    df = df.selectExpr("*", f"held = 1 AND lag(held, 1, 0) {R.over()} = 0 AS _opened").join(costs, "symbol")
    agg = df.groupBy("symbol").agg(
        F.expr(f"sum(ret) * {shares * 100} AS total_return"), F.expr("count_if(_opened) AS protection_events"),
        F.expr("max(put_cost) AS _cost"),
        F.expr(f"coalesce(sum(IF(held = 1 AND ret < {drop}, ret - greatest(ret, -protection_level), 0D)), 0D) * {shares * 100} AS protected_losses"),
    )
    out = agg.selectExpr("* EXCEPT (_cost)", "protection_events * _cost AS put_costs")
    return out.selectExpr("*", "total_return - put_costs AS net_return", "put_costs / greatest(1, protection_events) AS cost_per_protection")


def assignment_risk(positions: DataFrame) -> DataFrame:
    """Chance of assignment of short options from moneyness and time, and its cash effect."""
    itm = "IF(option_type = 'call', underlying_price - strike, strike - underlying_price)"
    df = positions.selectExpr("*", f"{itm} AS _itm")
    scaled = "_itm / underlying_price * IF(option_type = 'call', 10, 8) * greatest(0.1D, 1 - dte / 30D)"
    df = df.selectExpr(
        "*", f"CASE WHEN NOT is_short OR _itm <= 0 THEN 0D ELSE least(IF(option_type = 'call', 0.95D, 0.9D), {scaled}) END AS assignment_probability",
        "IF(option_type = 'call', 1, -1) * strike * contracts * 100 AS cash_impact",
    )
    return df.selectExpr(
        "* EXCEPT (_itm)",
        "CASE WHEN NOT is_short THEN 'Long options cannot be assigned' WHEN _itm <= 0 THEN concat(initcap(option_type), ' is OTM') "
        "WHEN assignment_probability > 0.5D THEN 'high' ELSE 'moderate' END AS risk",
    )
