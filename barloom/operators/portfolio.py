"""Allocation, exposure limits, correlation and eligibility on ``(portfolio_id, date, symbol)`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.config import RISK, RiskLimits
from barloom.functions import rolling as R
from barloom.functions.text import div

# The approved universe with its leverage flag, and the assets that are never eligible.
APPROVED_UNIVERSE = {"SPY": False, "GLD": False, "TLT": False, "QQQ": False, "IWM": False, "EFA": False}
EXCLUDED_ASSETS = ("TQQQ", "SQQQ", "UVXY", "VXX", "SPXS", "SPXL")


def allocate(
    signals: DataFrame, by: list[str] = ["date"], capital: float = 100_000.0, max_weight: float = 0.5,
    min_confidence: float = 0.4, target_vol: float = 0.15, reserve: float = 0.05,
) -> DataFrame:
    """Inverse-volatility weights scaled by confidence, normalised, capped, and scaled down if above one.

    Needs ``signal`` (text), ``confidence`` and ``volatility`` (default 0.20). Capped weight is not dealt out again.
    """
    key = ", ".join(by)
    entering = "signal IN ('ENTER_LONG', 'LONG')"
    vol = "coalesce(volatility, 0.2D)"
    raw = (
        f"IF({entering} AND confidence >= {min_confidence!r}D, "
        f"IF({vol} > 0, {target_vol!r}D / nullif({vol}, 0D), 1D) * confidence, 0D)"
    )
    df = signals.selectExpr("*", f"{raw} AS _raw")
    total = f"sum(_raw) OVER (PARTITION BY {key})"
    df = df.selectExpr("* EXCEPT (_raw)", f"least(coalesce({div('_raw', total)}, 0D), {max_weight!r}D) AS _capped")
    df = df.selectExpr("* EXCEPT (_capped)", f"_capped / greatest(sum(_capped) OVER (PARTITION BY {key}), 1D) AS weight")
    pct = "concat(CAST(CAST(round({} * 100, 0) AS INT) AS STRING), '%')"
    return df.selectExpr(
        "*", f"{capital * (1 - reserve)!r}D * weight AS notional",
        f"CASE WHEN weight > 0 THEN concat('Confidence ', {pct.format('confidence')}, ', Vol ', format_string('%.1f', {vol} * 100), '%') "
        f"WHEN NOT {entering} THEN concat('Signal is ', signal) "
        f"WHEN confidence < {min_confidence!r}D THEN concat('Confidence ', {pct.format('confidence')}, ' < {min_confidence:.0%}') "
        "ELSE 'Not allocated' END AS reason",
    )


def cash_reserve(allocated: DataFrame, by: list[str] = ["date"], capital: float = 100_000.0) -> DataFrame:
    return allocated.groupBy(*by).agg(
        F.expr("sum(notional) AS total_allocated"), F.expr(f"{capital!r}D - sum(notional) AS cash_reserve"),
        F.expr("count_if(weight > 0) AS n_assets"),
    )


def exposure_checks(positions: DataFrame, capital: float, limits: RiskLimits = RISK) -> DataFrame:
    """Total, single-asset and count limits as one row per portfolio, day and limit."""
    agg = positions.groupBy("portfolio_id", "date").agg(
        F.expr(f"sum(abs(value)) / {capital!r}D * 100 AS _total"), F.expr(f"max(abs(value)) / {capital!r}D * 100 AS _single"),
        F.expr("CAST(count_if(abs(value) > 0) AS DOUBLE) AS _count"),
    )
    return _check_rows(agg, [
        ("total_exposure", "_total", limits.max_total_exposure_pct, "reduce"),
        ("single_asset", "_single", limits.max_single_asset_pct, "reduce"),
        ("position_count", "_count", float(limits.max_assets), "reduce"),
    ])


def _check_rows(df: DataFrame, checks: list[tuple[str, str, float, str]]) -> DataFrame:
    rows = ", ".join(
        f"struct('{name}' AS limit_name, {value} AS current_value, {limit!r}D AS limit_value, {value} <= {limit!r}D AS passed, "
        f"IF({value} <= {limit!r}D, 'none', '{action}') AS action_required)"
        for name, value, limit, action in checks
    )
    return df.selectExpr("portfolio_id", "date", f"inline(array({rows}))")


def correlation_matrix(
    returns: DataFrame, lookback: int = 60, tile: int = 256, value: str = "ret", threshold: float | None = None
) -> DataFrame:
    """Pearson correlation of every symbol pair over the last ``lookback`` dates; null where they share fewer than two.

    Each symbol becomes one vector of at most ``lookback`` values. Symbols fall into as many blocks as ``tile`` symbols
    a block need, and blocks meet once in the tiles on and above the diagonal, by an equi-join on the tile number. Each pair
    is computed once and given in both directions. With ``threshold`` only pairs of different symbols above it leave the tile.
    """
    dates = returns.select("date").distinct().orderBy(F.desc("date")).limit(lookback)
    recent = returns.join(dates, "date", "left_semi")
    days = "datediff(date, DATE '1970-01-01')"
    vectors = recent.groupBy("symbol").agg(F.expr(f"map_from_entries(collect_list(struct({days} AS d, {value} AS v))) AS _m"))
    blocks = max(1, -(-returns.select("symbol").distinct().count() // tile))
    vectors = vectors.selectExpr("symbol", "_m", f"pmod(hash(symbol), {blocks}) AS _b")
    left = vectors.selectExpr("symbol AS symbol_a", "_m AS _ma", "_b AS _row", f"explode(sequence(_b, {blocks - 1})) AS _col")
    right = vectors.selectExpr("symbol AS symbol_b", "_m AS _mb", "_b AS _col", "explode(sequence(0, _b)) AS _row")
    pairs = left.join(right, ["_row", "_col"]).where("_row < _col OR symbol_a <= symbol_b")
    if threshold is not None:
        pairs = pairs.where("symbol_a <> symbol_b")
    pairs = pairs.selectExpr(
        "symbol_a", "symbol_b",
        "filter(transform(map_entries(_ma), e -> struct(e.value AS x, _mb[e.key] AS y)), p -> p.x IS NOT NULL AND p.y IS NOT NULL) AS _p",
    )
    # one fold gives all sums
    sums = "aggregate(_p, named_struct('x', 0D, 'y', 0D), (s, p) -> named_struct('x', s.x + p.x, 'y', s.y + p.y))"
    pairs = pairs.selectExpr("*", "size(_p) AS n", f"{sums} AS _s").selectExpr("*", "try_divide(_s.x, n) AS _mx", "try_divide(_s.y, n) AS _my")
    zero = "named_struct('xy', 0D, 'xx', 0D, 'yy', 0D)"
    step = "named_struct('xy', s.xy + (p.x - _mx) * (p.y - _my), 'xx', s.xx + (p.x - _mx) * (p.x - _mx), 'yy', s.yy + (p.y - _my) * (p.y - _my))"
    pairs = pairs.selectExpr("symbol_a", "symbol_b", "n", f"aggregate(_p, {zero}, (s, p) -> {step}) AS _s")
    pairs = pairs.selectExpr("symbol_a", "symbol_b", "n", f"IF(n > 1, {div('_s.xy', 'sqrt(_s.xx * _s.yy)')}, NULL) AS rho")
    if threshold is not None:
        pairs = pairs.where(f"rho > {threshold}")
    both = "array(struct(symbol_a, symbol_b), struct(symbol_b AS symbol_a, symbol_a AS symbol_b))"
    return pairs.selectExpr("n", "rho", f"inline(IF(symbol_a = symbol_b, slice({both}, 1, 1), {both}))").select("symbol_a", "symbol_b", "n", "rho")


def correlated_exposure(
    positions: DataFrame, correlations: DataFrame, capital: float, threshold: float = 0.7, limit: float = RISK.max_correlated_exposure_pct
) -> DataFrame:
    """Largest exposure of an asset plus everything that moves with it, per portfolio and day.

    ``correlations`` may be cut at ``threshold`` already; assets without a row there stand alone.
    """
    close = correlations.where(f"symbol_a <> symbol_b AND rho > {threshold}").selectExpr("symbol_a AS symbol", "symbol_b")
    own = positions.selectExpr("portfolio_id", "date", "symbol", "abs(value) AS _own")
    other = positions.selectExpr("portfolio_id", "date", "symbol AS symbol_b", "abs(value) AS _other")
    shared = own.join(close, "symbol").join(other, ["portfolio_id", "date", "symbol_b"]).groupBy("portfolio_id", "date", "symbol").agg(
        F.expr("sum(_other) AS _shared")
    )
    per_asset = own.join(shared, ["portfolio_id", "date", "symbol"], "left")
    out = per_asset.groupBy("portfolio_id", "date").agg(
        F.expr(f"max(_own + coalesce(_shared, 0D)) / {capital!r}D * 100 AS correlated_exposure_pct")
    )
    return out.selectExpr("*", f"correlated_exposure_pct <= {limit} AS passed")


def portfolio_equity(positions: DataFrame, returns: DataFrame, capital: float) -> DataFrame:
    """Equity per portfolio and day: start capital plus the running sum of position value times return."""
    pnl = positions.join(returns.select("symbol", "date", "ret"), ["symbol", "date"]).groupBy("portfolio_id", "date").agg(
        F.expr("sum(value * ret) AS pnl")
    )
    return pnl.selectExpr("portfolio_id", "date", f"{capital!r}D + sum(pnl) {R.running('portfolio_id')} AS equity")


def portfolio_state(positions: DataFrame, returns: DataFrame, capital: float, limits: RiskLimits = RISK) -> DataFrame:
    """Exposure, drawdown and the overall pass of a portfolio per day, with the failed limits."""
    peak = f"max(equity) {R.running('portfolio_id')}"
    curve = portfolio_equity(positions, returns, capital).selectExpr(
        "portfolio_id", "date", "equity", f"abs({div(f'equity - {peak}', peak)}) * 100 AS current_drawdown_pct"
    )
    dd = _check_rows(curve, [("portfolio_drawdown", "current_drawdown_pct", limits.max_drawdown_pct, "close")])
    checks = exposure_checks(positions, capital, limits).unionByName(dd)
    state = checks.groupBy("portfolio_id", "date").agg(
        F.expr("max(IF(limit_name = 'total_exposure', current_value, NULL)) AS total_exposure_pct"),
        F.expr("max(IF(limit_name = 'single_asset', current_value, NULL)) AS largest_position_pct"),
        F.expr("max(IF(limit_name = 'portfolio_drawdown', current_value, NULL)) AS current_drawdown_pct"),
        F.expr("CAST(max(IF(limit_name = 'position_count', current_value, NULL)) AS BIGINT) AS active_positions"),
        F.expr("every(passed) AS all_checks_passed"),
        F.expr("array_sort(collect_list(IF(passed, NULL, limit_name))) AS failed_checks"),
    )
    return state


def eligibility(
    bars: DataFrame, spreads: DataFrame, regimes: DataFrame, universe: dict[str, bool] | None = None,
    excluded: tuple[str, ...] = EXCLUDED_ASSETS, min_adv: float = 1e9, max_spread: float = 10.0, min_consistency: float = 0.6,
) -> DataFrame:
    """Eligibility scores and rejection reasons per symbol; ``spreads`` has ``spread_bps``, ``regimes`` ``regime``."""
    universe = APPROVED_UNIVERSE if universe is None else universe

    def listed(names) -> str:
        return "symbol IN (" + ", ".join(f"'{n}'" for n in names) + ")" if names else "false"

    leveraged = listed([s for s, lev in universe.items() if lev])
    adv = bars.groupBy("symbol").agg(F.expr("coalesce(avg(volume * close), 0D) AS avg_daily_volume"))
    spread = spreads.groupBy("symbol").agg(F.expr("avg(spread_bps) AS _spread"))
    same = f"IF(regime = {R.lag('regime')}, 1D, 0D)"
    steady = regimes.selectExpr("symbol", f"{same} AS _same").groupBy("symbol").agg(
        F.expr("IF(count(*) > 1, avg(_same), 0D) AS _steady")
    )
    df = adv.join(spread, "symbol", "left").join(steady, "symbol", "left").selectExpr(
        "symbol", "avg_daily_volume", "coalesce(_spread, 0D) AS avg_spread_bps", "coalesce(_steady, 0D) AS regime_consistency",
        "_steady IS NOT NULL AS _has_regimes", f"{listed(excluded)} AS _excluded", f"{listed(universe)} AS _approved",
    )
    reasons = (
        f"IF(avg_daily_volume < {min_adv!r}D AND avg_daily_volume > 0, concat('Insufficient liquidity: $', "
        f"format_string('%.2f', avg_daily_volume / 1e9D), 'B < ${min_adv / 1e9:.2f}B'), NULL), "
        f"IF(avg_spread_bps > {max_spread!r}D, concat('High spread: ', format_string('%.1f', avg_spread_bps), ' bps > {max_spread} bps'), NULL), "
        f"IF(_has_regimes AND regime_consistency < {min_consistency!r}D, concat('Low regime clarity: ', "
        "format_string('%.1f', regime_consistency * 100), '%'), NULL), "
        "IF(NOT _approved, 'Not in pre-approved universe', NULL)"
    )
    zero = "IF(_excluded, 0D, {}) AS {}"
    out = df.selectExpr(
        "symbol", "_excluded",
        zero.format(f"IF(avg_daily_volume > 0, least(1D, avg_daily_volume / {2 * min_adv!r}D), 0.5D)", "liquidity_score"),
        zero.format("IF(regime_consistency > 0, regime_consistency, 0.7D)", "regime_clarity_score"),
        zero.format(f"IF(avg_spread_bps > 0, greatest(0D, 1 - avg_spread_bps / {2 * max_spread!r}D), 0.7D)", "execution_score"),
        zero.format(f"IF(_approved, IF({leveraged}, 0.3D, 1D), 0.5D)", "complexity_score"),
        zero.format("avg_daily_volume", "avg_daily_volume"), zero.format("avg_spread_bps", "avg_spread_bps"),
        zero.format("regime_consistency", "regime_consistency"),
        f"IF(_excluded, array('Explicitly excluded (leveraged/decay asset)'), array_compact(array({reasons}))) AS rejection_reasons",
    )
    return out.selectExpr("* EXCEPT (_excluded)", "size(rejection_reasons) = 0 AS eligible")
